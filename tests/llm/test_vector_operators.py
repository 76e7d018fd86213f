"""Exact top-k search, hard negatives and centroid clustering, against plain forms of their contracts."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from compare import same
from pyspark.sql import functions as F

from tabloom.llm import clustering, exact_topk, negatives, queries
from tabloom.llm.vectors import first_k

SCHEMA = "vec_id long, embedding array<double>, label int, block string, x int, width string, `rank` int, cluster int"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    """rows (vec_id, embedding, label), with columns that have the operators' own names."""
    return spark.createDataFrame([(*r, "b", 1, "w", 2, 3) for r in rows], SCHEMA)


def rough(n, dims, seed, groups=3):
    """Vectors in groups with ties, repeated rows and ids, other lengths, and all that takes no part."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (groups, dims))
    rows = [(i, (middle[i % groups] + rng.integers(-4, 5, dims) / 16).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    rows += [(n + i, rows[0][1], i % 4) for i in range(40)]  # one vector many times
    rows += [rows[3], rows[3], rows[20], (20, rows[21][1], rows[20][2]), (60, rows[0][1], 0)]  # rows and ids again
    rows += [(1000 + 20 * i, rows[i][1][: dims - 1], i % 3) for i in range(5)]
    bad = [None, [], [None] * dims, [NAN] + [0.5] * (dims - 1), [INF] * dims, [1.0] * (dims - 1) + [None]]
    rows += [(2000 + 20 * i, v, 1) for i, v in enumerate(bad)]
    return rows + [(None, rows[0][1], 1), (3000, rows[1][1], None), (3020, [0.0] * dims, 2)]


def usable(rows, scale):
    out = []
    for i, v, label in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            out.append((i, tuple(int(np.floor(scale * x)) for x in v), label))
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def plain_topk(rows, k, every, scale):
    v, out = usable(rows, scale), set()
    for i in {i for i, _, _ in v if i % every == 0}:
        best = {}
        for a, x, _ in v:
            for b, y, _ in v:
                if a == i and b != i and len(x) == len(y):
                    best[b] = max(best.get(b, -(10**18)), dot(x, y))
        out |= {(i, r + 1, b, s) for r, (b, s) in enumerate(sorted(best.items(), key=lambda e: (-e[1], e[0]))[:k])}
    return out


@pytest.mark.parametrize("dims,k,parts", [(8, 5, 1), (7, 20, 5), (1, 3, 2)])
def test_exact_topk_is_brute_force(spark, dims, k, parts, monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK", 16)
    rows = rough(150, dims, seed=dims)
    got = exact_topk.search(frame(spark, rows).repartition(parts), k=k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert {tuple(r) for r in got.collect()} == plain_topk(rows, k, 20, 64)


def test_exact_topk_of_large_numbers_and_nothing(spark):
    rows = [(20 * i, [float(2**24 + i * 3), -float(2**24 - i)], 0) for i in range(6)]  # sums beyond 2^53
    assert {tuple(r) for r in exact_topk.search(frame(spark, rows), k=3).collect()} == plain_topk(rows, 3, 20, 64)
    assert exact_topk.search(frame(spark, [])).count() == 0
    assert exact_topk.search(frame(spark, [(20, [1.0], 0)])).count() == 0  # no candidate
    with pytest.raises(Exception, match="beyond"):
        exact_topk.search(frame(spark, [(20, [1e300], 0)])).count()


def test_cutoff_spares_most_entries(spark, sf):
    """Lists send a part of their entries after the cutoff, and the cutoff is reached by k rows of each query."""
    sent = []
    real = exact_topk._lists

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.floor(64 * np.stack(rows["embedding"]).astype(float)), rows["vec_id"].to_numpy()
    q = ids % 20 == 0
    block = lambda kind, own, part, cut: {"width": 64, "part": part, "row": 0, "col": 0, "kind": kind, "block": kind, "other": None, "ids": ids[own].tobytes(), "x": [exact_topk.packed(np.array_split(x[own], 2, axis=1)[part])], "more": cut}
    scores = (x[q] @ x.T).astype(np.int64)
    scores[np.arange(q.sum()), np.flatnonzero(q)] = -(2**40)
    twentieth = np.sort(scores, axis=1)[:, -20].astype(np.int64)
    import pyarrow as pa

    for part in (0, 1):
        cells = [block(0, np.ones(len(ids), bool), part, None), block(1, q, part, twentieth.tobytes())]
        batch = pa.RecordBatch.from_pylist(cells, pa.schema(list(zip(exact_topk._NAMES, exact_topk._TYPES, strict=True))))
        for out in real([batch], 20, 2, True):
            sent += [exact_topk._read_entries(e.as_py()) for e in out.column("more")]
    assert sum(len(e[0]) for e in sent) < 0.25 * q.sum() * len(ids)  # 20 of 500 rows reach it in full
    pairs = {(i, at) for e in sent for i, at in zip(e[0], e[1], strict=True)}
    assert {(i, at) for i, at in zip(*np.nonzero(scores >= twentieth[:, None]), strict=True)} <= pairs


def plain_negatives(rows, every, positives, negatives_, share, scale):
    one = {}
    for i, x, label in usable(rows, scale):
        if label is not None:
            one[i] = min(one.get(i, (9, 99, ())), (label, len(x), x))
    out = set()
    for a, (la, n, x) in one.items():
        if a % every:
            continue
        scored = sorted((-dot(x, y), b, lb == la) for b, (lb, m, y) in one.items() if b != a and m == n)
        for s, p, _ in [e for e in scored if e[2]][:positives]:
            fits = [(-t, b) for t, b, own in scored if not own and share[0] * -s <= -100 * t <= share[1] * -s]
            out |= {(a, p, r + 1, b, -s, t) for r, (t, b) in enumerate(fits[:negatives_])}
    return out


@pytest.mark.parametrize("dims,parts", [(8, 1), (3, 6)])
def test_hard_negatives_are_brute_force(spark, dims, parts, monkeypatch):
    for name, value in (("ROWS", 8), ("ANCHORS", 16), ("ZONES", 4), ("GROUP", 2)):
        monkeypatch.setattr(negatives, name, value)
    rows = rough(200, dims, seed=dims + 10)
    got = negatives.mine(frame(spark, rows).repartition(parts), every=10)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows, 10, 5, 3, (50, 95), 256)
    assert len(want) > 50 and {tuple(r) for r in got.collect()} == want


def test_hard_negatives_of_nothing(spark):
    assert negatives.mine(frame(spark, [])).count() == 0
    assert negatives.mine(frame(spark, [(50, [1.0, 2.0], 1), (51, [1.0, 2.0], 2), (52, None, 1)])).count() == 0  # no positive
    assert negatives.mine(frame(spark, [(50, [], 1), (51, [], 1), (52, [], 2)])).collect() == [(50, 51, 1, 52, 0, 0)]


def test_zone_maps_bound_scores_and_spare_blocks():
    """Bounds hold for every row; of clustered rows most blocks are out of a window's reach."""
    rng = np.random.default_rng(4)
    middle = rng.normal(0, 30, (40, 16))
    x = np.floor(middle[rng.integers(0, 40, 4000)] + rng.normal(0, 2, (4000, 16)))
    keys = negatives.curve_key(x, x.mean(axis=0), x.std(axis=0))
    x = x[sorted(range(len(x)), key=keys.__getitem__)]
    blocks = x.reshape(-1, 50, 16)
    low, high = blocks.min(axis=1), blocks.max(axis=1)
    q = x[::40]
    a = negatives._Anchors({"block": 0, "width": 16, "ids": np.arange(100).tobytes(), "labels": np.zeros(100, np.int64).tobytes(), "x": negatives.packed(q), "windows": None})
    least, most = a.bounds(low, high)
    scores = np.einsum("ad,brd->abr", q, blocks)
    assert (least <= scores.min(axis=2)).all() and (most >= scores.max(axis=2)).all()
    bar = np.sort(scores.reshape(100, -1), axis=1)[:, -5]
    assert (most >= bar[:, None]).mean() < 0.25


def test_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (5, 2), (6, 1)):
        cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        place = negatives.hilbert(cells, bits) @ (1 << np.arange(dims * bits)[::-1])
        assert sorted(place.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def plain_clusters(rows, k, rounds, scale, dims):
    v = [(i, tuple(int(np.floor(scale * x)) for x in e)) for i, e, _ in rows if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e)]
    c = [x for _, x in sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for i, x in v if i is not None)[:k]]
    far = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y, strict=True))
    near = lambda x: min((far(x, y), j) for j, y in enumerate(c))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x in v:
            groups[near(x)[1]].append(x)
        c = [tuple(sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)) if groups[j] else y for j, y in enumerate(c)]
    found = [(i, *near(x)[::-1]) for i, x in v]
    own = defaultdict(int)
    for _, j, d in found:
        own[j] += d
    name = [hashlib.sha256(",".join(map(str, y)).encode()).hexdigest() for y in c]
    return sorted(((i, j, d, own[j], sum(own.values()), name[j]) for i, j, d in found), key=str)


@pytest.mark.parametrize("parts,rows", [(1, 16_384), (5, 32)])
def test_clusters_are_brute_force(spark, parts, rows, monkeypatch):
    monkeypatch.setattr(clustering, "ROWS", rows)
    table = rough(200, 6, seed=2)
    got = clustering.cluster(frame(spark, table).repartition(parts), k=8, rounds=4, dims=6)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(table, 8, 4, 1024, 6)


def test_clusters_of_few_large_or_no_vectors(spark):
    few = [(i, [float(i), 2.0], 0) for i in range(3)]
    assert sorted(map(tuple, clustering.cluster(frame(spark, few), dims=2).collect()), key=str) == plain_clusters(few, 8, 10, 1024, 2)
    large = [(i, [float((-1) ** i * 2**20 + i), float(2**20)], 0) for i in range(30)]  # squares of 2^60
    assert sorted(map(tuple, clustering.cluster(frame(spark, large), k=3, dims=2).collect()), key=str) == plain_clusters(large, 3, 10, 1024, 2)
    assert clustering.cluster(frame(spark, [])).count() == 0
    assert clustering.cluster(frame(spark, [(1, [1.0], 0), (None, [1.0] * 64, 0)])).count() == 0


def test_dictionaries_are_lossless_and_join_repeating_dimensions():
    rng = np.random.default_rng(1)
    kinds = rng.integers(-50, 50, (20, 5))
    x = np.concatenate([kinds[rng.integers(0, 20, 1000)], rng.integers(-2000, 2000, (1000, 3))], axis=1)
    runs = list(clustering._runs(x))
    assert np.array_equal(np.concatenate([w[c] for w, c in runs], axis=1), x)
    assert [w.shape[1] for w, _ in runs] == [5, 1, 1, 1] and len(runs[0][0]) <= 20


def test_first_k_takes_an_id_once():
    q, ids, s = np.array([1, 1, 1, 0, 1]), np.array([5, 5, 7, 5, 2]), np.array([3, 9, 9, 1, 9])
    at = first_k(q, ids, s, 2)
    assert [(q[i], ids[i], s[i]) for i in at] == [(0, 5, 1), (1, 2, 9), (1, 5, 9)]


@pytest.mark.parametrize("name", ["op11_exact_topk", "op12_hard_negatives", "op13_centroid_clustering"])
def test_sql(spark, sf, duck, name):
    same(queries.QUERIES[name](spark, sf), duck, queries.ORACLES[name])


def test_sql_on_rough_rows(spark, tmp_path):
    import duckdb

    rows = [(i, [float(x) for x in v] if v else v, label) for i, v, label in rough(120, 64, seed=9) if i is not None and (v is None or None not in v)]
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("op11_exact_topk", "op12_hard_negatives", "op13_centroid_clustering"):
        same(queries.QUERIES[name](spark, str(tmp_path)), con, queries.ORACLES[name])


@pytest.mark.parametrize("k,groups,spread", [(500, 0, 1.0), (4096, 0, 1.0), (4096, 60, 0.3), (5000, 60, 0.01), (20_000, 60, 0.3), (3, 0, 1.0), (1, 0, 1.0)])
def test_walks_find_the_closest_centroid(k, groups, spread):
    """In 999 of 1,000 walks, on centroids without clusters, in clusters and among near copies; no centroid is held twice."""
    from tabloom.llm import ann

    rng = np.random.default_rng(1)
    middle = rng.normal(size=(max(groups, 1), 64)) * 2 * bool(groups)
    made = lambda n: (middle[rng.integers(0, len(middle), n)] + rng.normal(size=(n, 64)) * spread).astype(np.float32)
    c, q = made(k), made(1000)
    which, d = ann.walk(q, c, ann.graph_of(c), ann.WALK)
    best = ann._distances(q, c).min(axis=1)
    assert (d[:, 0] <= best * (1 + 1e-9) + 1e-12).mean() >= 0.999
    assert (np.diff(np.sort(which, axis=1), axis=1) > 0).all() and (np.diff(d, axis=1) >= 0).all() and which.shape[1] == min(ann.WALK, k)

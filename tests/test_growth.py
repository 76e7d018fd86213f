"""Trees grown by level, by histogram and in one task are the same trees; predictions keep their rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabloom.operators import growth, sampling, trees

LABELS = ["a", "b", "c", "d"]


def table(spark, n=600, p=5, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 1, (n, p)), 1)  # ties
    x[:, 3] = 2.5  # doesn't vary
    code = (x[:, 0] > 0).astype(int) + (x[:, 1] + rng.normal(0, 0.5, n) > 0.3) + (x[:, 4] > 1.5)
    return spark.createDataFrame([(i, int(c), r.tolist()) for i, (c, r) in enumerate(zip(code, x, strict=True))], "id long, code int, features array<double>").repartition(3)


def plain(rows, depth, leaf, split, classes=4):
    """The nodes of one tree by a direct reading of the rules."""
    def entropy(codes):
        share = np.bincount(codes, minlength=classes) / len(codes)
        return -sum(s * np.log2(s) for s in share if s > 0)

    def grow(rows, node, d):
        codes = np.array([c for _, c, _ in rows])
        counts = np.bincount(codes, minlength=classes)
        best = (0.0, -1, None)
        if d < depth and len(rows) >= split and (counts > 0).sum() > 1:
            for f in range(len(rows[0][2])):
                pairs = sorted((x[f], c) for _, c, x in rows)
                for i in range(leaf, len(pairs) - leaf + 1):
                    (a, la), (b, lb) = pairs[i - 1], pairs[i]
                    if a == b or la == lb:
                        continue
                    left, right = (np.array([c for _, c in part]) for part in (pairs[:i], pairs[i:]))
                    gain = round(entropy(codes) - i / len(pairs) * entropy(left) - (1 - i / len(pairs)) * entropy(right), 12)
                    if gain > best[0]:
                        best = (gain, f, (a + b) / 2)
        if best[0] < trees.LEAST_GAIN:
            return [(0, node, d, int(counts.argmax()), -1, None)]
        _, f, t = best
        sides = [r for r in rows if r[2][f] <= t], [r for r in rows if r[2][f] > t]
        return [(0, node, d, int(counts.argmax()), f, t)] + grow(sides[0], 2 * node + 1, d + 1) + grow(sides[1], 2 * node + 2, d + 1)

    return sorted(grow(rows, 0, 0))


def nodes(model):
    return [(t, n, d, p, f, None if v != v else round(v, 10)) for t, n, d, p, f, v in model.nodes[["tree", "node", "depth", "prediction", "feature", "threshold"]].itertuples(index=False)]


def test_a_tree_is_the_plain_one(spark):
    df = table(spark)
    want = [(*r[:5], None if r[5] is None else round(r[5], 10)) for r in plain([tuple(r) for r in df.collect()], 5, 4, 8)]
    assert nodes(trees.grow(df, LABELS, 5, least_leaf=4, least_split=8)) == want and len(want) > 20


@pytest.mark.parametrize("bins", [None, 16])
@pytest.mark.parametrize("subset", [None, 2])
def test_levels_and_tasks_grow_the_same_forest(spark, monkeypatch, bins, subset):
    """Every node by levels, large ones by levels, and all in one task."""
    df = table(spark)
    weights = sampling.bootstrap(df, "id", 3, 0.8, 5)
    found = []
    for most in (0, 500, 1 << 22):
        monkeypatch.setattr(growth, "LOCAL_VALUES", most)
        found.append(nodes(trees.grow(df, LABELS, 4, least_leaf=2, least_split=4, weights=weights, features_per_node=subset, seed=5, bins=bins)))
    assert found[0] == found[1] == found[2] and len(found[0]) > 30


def test_a_pass_reads_and_counts_the_lighter_child_only(spark, monkeypatch):
    """The histograms that a level sends are those of lighter children; the others come from their parents."""
    monkeypatch.setattr(growth, "LOCAL_VALUES", 0)
    aimed = []
    real = growth.Level.aim

    def aim(self, large, local, open_, histograms):
        real(self, large, local, open_, histograms)
        aimed.append((len(self.large), len(self.counted), sum(open_[(0, int(k))].sum() for k in self.counted), sum(c.sum() for c in open_.values())))

    monkeypatch.setattr(growth.Level, "aim", aim)
    trees.grow(table(spark), LABELS, 4, bins=16)
    assert aimed[0][:2] == (1, 1) and all(counted <= (large + 1) // 2 + 1 and own <= rows / 2 for large, counted, own, rows in aimed[1:])


def test_edge_tables(spark):
    df = table(spark, 40)
    one = trees.grow(df.where("code = 1"), LABELS, 3)
    assert nodes(one) == [(0, 0, 0, 1, -1, None)]
    with pytest.raises(ValueError, match="no training rows"):
        trees.grow(df.limit(0), LABELS, 3)
    with pytest.raises(ValueError, match="30"):
        trees.grow(df, LABELS, 31)
    same = df.withColumn("features", F.array(F.lit(1.0), F.lit(2.0)))
    assert len(trees.grow(same, LABELS, 3).nodes) == 1


def test_predictions_keep_rows_whose_ids_repeat(spark):
    df = table(spark, 120)
    model = trees.grow(df, LABELS, 4, weights=sampling.bootstrap(df, "id", 5, 0.8, 1))
    twice = df.unionByName(df).withColumn("id", F.floor(F.col("id") / 2)).unionByName(df.limit(1).withColumns({"id": F.lit(7777).cast("long"), "features": F.lit(None).cast("array<double>")}))
    got = model.predict(twice)
    assert got.count() == 241 and got.where("predicted_class IS NULL").select("id").collect() == [(7777,)]
    # each row against the votes of its trees
    votes = {tuple(r["features"]): r["v"] for r in df.withColumn("v", model.descend(F.col("features"))).collect()}
    want = sorted((x, LABELS[int(np.bincount(v, minlength=4).argmax())]) for x, v in votes.items())
    mine = {tuple(r["features"]): r["predicted_class"] for r in df.withColumn("code", F.col("code")).join(model.predict(df).select("id", "predicted_class"), "id").collect()}
    assert sorted(mine.items()) == want


@pytest.mark.parametrize("decimals", [1, 9])
def test_a_subtree_takes_little_memory_and_runs_change_nothing(monkeypatch, decimals):
    n, rng = 50_000, np.random.default_rng(8)
    code = rng.integers(0, 10, n).astype(np.int32)
    x = np.round(rng.normal(0, 1, (n, 16)) + 0.3 * code[:, None] * (np.arange(16) == 5), decimals)
    weight = rng.integers(1, 3, n).astype(float)
    rule = growth.Rule(10, 16, 3, 3, 6, 1e-7, 4, 42, None)
    piece = growth._state(x, code, np.arange(n), np.zeros(n), weight, np.zeros(n), kind=2, t=0, n=0)
    tracemalloc.start()
    grown = pa.Table.from_batches(growth._subtrees(iter([piece]), rule)).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(grown) > 1 and peak < 60e6
    monkeypatch.setattr(growth, "CELLS", 1 << 24)
    assert pa.Table.from_batches(growth._subtrees(iter([piece]), rule)).to_pylist() == grown

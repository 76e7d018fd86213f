"""Neighbours with repeated ids, parts and pruning, against brute force."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabloom.operators import knn, pruned_knn

SCHEMA = "id long, label string, features array<double>"


def clustered(n, dims, groups, seed, first=0):
    rng = np.random.default_rng(seed)
    middle = np.random.default_rng(99).uniform(-50, 50, (groups, dims))
    x = np.round(middle[rng.integers(0, groups, n)] + rng.normal(0, 1, (n, dims)), 1)
    return [(first + i, f"L{i % 3}", r.tolist()) for i, r in enumerate(x)]


def plain(train, queries, k):
    out = []
    for i, _, x in queries:
        near = sorted((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j, label) for j, label, y in train)[:k]
        out += [(i, r + 1, j, label, round(d, 6)) for r, (d, j, label) in enumerate(near)]
    return sorted(out)


def rows(df):
    return sorted((r["query_id"], r["rank"], r["train_id"], r["label"], round(r["distance"], 6)) for r in df.collect())


@pytest.mark.parametrize("groups,k,pivots", [(12, 5, 16), (1, 3, 4), (300, 40, 1)])
def test_pruned_is_brute_force(spark, monkeypatch, groups, k, pivots):
    for name, value in (("ROWS", 16), ("QUERIES", 8), ("GROUP", 4)):
        monkeypatch.setattr(pruned_knn, name, value)
    train, queries = clustered(300, 4, groups, 1), clustered(40, 4, groups, 2, 1000)
    train += [(400 + i, "copy", train[0][2]) for i in range(60)]  # a hot point
    queries += [(1000, "again", train[0][2]), (2000, "far", [1e4] * 4)]
    got = pruned_knn.topk(spark.createDataFrame(train, SCHEMA).repartition(3), spark.createDataFrame(queries, SCHEMA).repartition(2), k, pivots)
    assert rows(got) == plain(train, queries, k)


def test_pruned_edges(spark):
    some = spark.createDataFrame(clustered(10, 3, 2, 1), SCHEMA)
    none = some.limit(0)
    assert pruned_knn.topk(none, some, 3).count() == 0 and pruned_knn.topk(some, none, 3).count() == 0
    assert rows(pruned_knn.topk(some, some, 50)) == rows(knn.topk(some, some, 50))  # fewer rows than k
    with pytest.raises(ValueError, match="positive"):
        pruned_knn.topk(some, some, 0)


def measured(spark, train, queries, k):
    """Share of all pairs that the second round compares."""
    found = pruned_knn.Search(spark.createDataFrame(train, SCHEMA))
    plans = []
    real = pruned_knn.Search.plan
    try:
        pruned_knn.Search.plan = lambda self, *a: plans.append(real(self, *a)) or plans[-1]
        found.neighbours(spark.createDataFrame(queries, SCHEMA), k)
    finally:
        pruned_knn.Search.plan = real
    bits = F.udf(lambda b: sum(bin(x).count("1") for x in b), "int")
    return [p.join(found.blocks, "block").agg(F.sum(bits("needed") * F.col("n"))).first()[0] / (len(train) * len(queries)) for p in plans]


def test_clustered_rows_spare_most_distances(spark, monkeypatch):
    monkeypatch.setattr(pruned_knn, "ROWS", 32)
    first, second = measured(spark, clustered(3000, 8, 40, 3), clustered(200, 8, 40, 4, 9000), 5)
    assert first + second < 1 / 3


def shuffled(spark, run):
    """Bytes that the stages of run() write to shuffles."""
    gateway = spark.sparkContext._gateway
    java = gateway.jvm.java.util.ArrayList
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), java())
    each = lambda: {s.apply(i).stageId(): s.apply(i).shuffleWriteBytes() for s in [stages()] for i in range(s.size())}
    before = each()
    run()
    return sum(n for i, n in each().items() if i not in before)


def test_where_nothing_is_spared_blocks_travel_once_a_cell(spark, monkeypatch):
    for name in ("ROWS", "QUERIES"):
        monkeypatch.setattr(pruned_knn, name, 32)
    rng = np.random.default_rng(5)
    train, queries = ([(first + i, "L", r) for i, r in enumerate(rng.normal(0, 1, (n, 16)).tolist())] for first, n in ((0, 4000), (9000, 2000)))
    t, q = spark.createDataFrame(train, SCHEMA), spark.createDataFrame(queries, SCHEMA)
    got = []
    assert shuffled(spark, lambda: got.extend(rows(pruned_knn.topk(t, q, 3)))) < 14e6  # 9.2e6; 21.3e6 with a block for each pair
    assert got == rows(knn.topk(t, q, 3))


def test_repeated_query_ids_have_neighbours_of_their_own(spark):
    train = clustered(50, 3, 4, 5)
    queries = [(7, "a", train[0][2]), (7, "b", train[30][2])]
    t, q = spark.createDataFrame(train, SCHEMA), spark.createDataFrame(queries, SCHEMA)
    assert rows(knn.topk(t, q, 4)) == plain(train, queries, 4)
    assert sorted((r["id"], r["true_class"]) for r in knn.predict(t, q, 4).collect()) == [(7, "a"), (7, "b")]
    assert knn.predict_many(t, q, (1, 3)).count() == 4


def test_parts_are_training_tables_of_their_own(spark):
    one, two = clustered(40, 3, 4, 6), clustered(30, 3, 4, 7)
    queries = clustered(9, 3, 4, 8, 500)
    both = spark.createDataFrame([(*r, 1) for r in one] + [(*r, 2) for r in two], SCHEMA + ", number int")
    q = spark.createDataFrame(queries, SCHEMA)
    near = knn.neighbours(both, q, 3, by="number")
    for number, train in ((1, one), (2, two)):
        assert rows(near.where(F.col("number") == number)) == plain(train, queries, 3)
    assert knn.predict(both, q, 3, by="number").groupBy("number").count().orderBy("number").collect() == [(1, 9), (2, 9)]


def test_a_pair_of_blocks_takes_little_memory():
    x = np.random.default_rng(6).normal(0, 1, (2048, 4))
    row = {"row": 0, "col": 0, "part": 0, "block": 1, "ids": np.arange(2048).tobytes(), "labels": ["L"] * 2048, "x": x.tobytes()}
    batch = pa.RecordBatch.from_pylist([row | {"is_query": False}, row | {"is_query": True}])
    tracemalloc.start()
    found = pa.Table.from_batches(knn._block_topk(iter([batch]), 3)).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6  # all distances at once: 100 MB and more
    own = [i for i, d in zip(found["train_id"], found["distance"], strict=True) if d == 0]
    assert len(found["query"]) == 3 * 2048 and sorted(own) == list(range(2048))

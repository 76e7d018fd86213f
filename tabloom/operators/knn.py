"""Nearest neighbours: exact top-k in blocks, votes, and several k from one pass.

Rows are (id long, label string, features array<double>).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.sources.tables import kept

#: Rows of a block (2^12 at most), and of a query block compared at once: a task holds a few times CHUNK * BLOCK distances.
BLOCK, CHUNK = 2048, 512
#: Blocks of either kind in a group of the grid, at most (on average).
GROUP = 16


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of up to BLOCK rows of one part."""
    for batch in batches:
        parts = np.asarray(batch.column("part"))
        for p in np.unique(parts):
            own = batch.take(pa.array(np.flatnonzero(parts == p)))
            for lo in range(0, own.num_rows, BLOCK):
                part = own.slice(lo, BLOCK)
                x = np.asarray(part.column("features").flatten().cast(pa.float64()))
                ids = np.asarray(part.column("id").cast(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([part.column("label").to_pylist()], pa.list_(pa.string())), pa.array([x.tobytes()], pa.binary())], ["part", "ids", "labels", "x"])


def _first(at: np.ndarray, ids: np.ndarray, distance: np.ndarray, k: int) -> np.ndarray:
    """Of pairs the k nearest of each query, ties to the smaller id."""
    order = np.lexsort((ids, distance, at))
    first = np.searchsorted(at[order], at[order])
    return order[np.arange(len(order)) - first < k]


def _nearest(q: np.ndarray, t: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row of t, distance): the k nearest of two blocks."""
    d = (q**2).sum(1)[:, None] + (t**2).sum(1)[None, :]
    d -= 2 * q @ t.T
    some = min(len(t), k)
    edge = np.partition(d, some - 1, axis=1)[:, some - 1].copy()
    # the expanded form loses digits: all near the edge are measured again, directly
    slack = 1e-9 * (1 + np.maximum(d.max(axis=1), -d.min(axis=1)))
    at, to = np.nonzero(d <= (edge + slack)[:, None])
    exact = np.zeros(len(at))
    for j in range(q.shape[1]):
        exact += (q[at, j] - t[to, j]) ** 2
    keep = _first(at, ids[to], exact, some)
    return at[keep], to[keep], exact[keep]


FOUND = "query long, query_id long, true_class string, part int, train_id long, label string, distance double"


def found(block: int, ids: np.ndarray, labels: Sequence[str], part: int, at: np.ndarray, to: np.ndarray, of: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    """Neighbours of the queries at places `at` of a block; a query's number is its block's and its place."""
    own = pa.array(labels, pa.string())
    columns = [pa.array(at + (block << 12)), pa.array(ids[at]), own.take(pa.array(at)), pa.array(np.full(len(at), part, np.int32)), pa.array(to), pa.array(of, pa.string()), pa.array(d)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FOUND.split(", ")])


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows that hold blocks, as Python objects one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
        del batch  # before the next is read


def _block_topk(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (row, col, is_query): a group's training blocks are held until its query blocks have passed."""
    key, held = None, {}
    for row in one_by_one(batches):
        if (row["row"], row["col"]) != key:
            key, held = (row["row"], row["col"]), {}
        ids = np.frombuffer(row["ids"], np.int64)
        x = np.frombuffer(row["x"]).reshape(len(ids), -1)
        if not row["is_query"]:
            held.setdefault(row["part"], []).append((ids, np.array(row["labels"], object), x))
            continue
        for part, blocks in held.items():
            for lo in range(0, len(x), CHUNK):
                each = [(at + lo, tid[to], labels[to], d) for tid, labels, t in blocks for at, to, d in [_nearest(x[lo : lo + CHUNK], t, tid, k)]]
                at, to, labels, d = (np.concatenate(c) for c in zip(*each, strict=True))
                keep = _first(at, to, d, k)
                yield found(row["block"], ids, row["labels"], part, at[keep], to[keep], labels[keep], d[keep])


def neighbours(train: DataFrame, queries: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """(query, query_id, true_class, by, rank, train_id, label, distance): the k nearest training rows of each query row.

    query numbers the rows of queries, so that repeated ids stay apart. by: an int column of train; each of its values is a training table of
    its own, and the k nearest of each are found. Each block of queries meets each block of training rows: both are dealt to
    a grid of groups of up to GROUP blocks, a query block once to each column, a training block once to each row. A group
    sends the k best; the rest is a merge."""
    if k <= 0:
        raise ValueError("k must be positive")
    schema = "part int, ids binary, labels array<string>, x binary"
    part = F.col(by).cast("int") if by else F.lit(0)
    rows = train.select("id", "label", "features", part.alias("part")), queries.select("id", "label", "features", F.lit(0).alias("part"))
    t, q = (kept(df.mapInArrow(_blocks, schema).withColumn("block", F.monotonically_increasing_id()), "blocks") for df in rows)
    tn, qn = t.count(), q.count()
    group = GROUP
    while group > 1 and -(-tn // group) * -(-qn // group) < 2 * train.sparkSession.sparkContext.defaultParallelism:
        group //= 2
    rows, columns = max(1, -(-qn // group)), max(1, -(-tn // group))
    own = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumns({"is_query": F.lit(True), "row": own(rows)}).withColumn("col", every(columns))
    t = t.withColumns({"is_query": F.lit(False), "col": own(columns)}).withColumn("row", every(rows))
    met = q.unionByName(t).repartition(max(rows * columns, 1), "row", "col").sortWithinPartitions("row", "col", "is_query")
    return ranked(met.mapInArrow(partial(_block_topk, k=k), FOUND), k, by)


def ranked(near: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """The k nearest of each query (and part) among what blocks have found; ties to the smaller id."""
    rank = F.row_number().over(Window.partitionBy("query", "part").orderBy("distance", "train_id"))
    keys = ["query", "query_id", "true_class", *([F.col("part").alias(by)] if by else [])]
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select(*keys, "rank", "train_id", "label", "distance")


def topk(train: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, train_id, label, distance): the k nearest training rows of each query row, ties to the smaller id; fewer
    if there are fewer."""
    return neighbours(train, queries, k).select("query_id", "rank", "train_id", "label", "distance")


def votes(neighbours: DataFrame, by: Sequence[str] = (), query: str = "query_id") -> DataFrame:
    """(query, by, predicted_class): most votes; then the smaller sum of distances; then the larger label."""
    counts = neighbours.groupBy(query, *by, "label").agg(F.count("*").alias("n"), F.round(F.sum("distance"), 9).alias("d"))
    best = F.max(F.struct("n", (-F.col("d")).alias("d"), "label")).alias("best")
    return counts.groupBy(query, *by).agg(best).select(query, *by, F.col("best.label").alias("predicted_class"))


def predict(train: DataFrame, queries: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """(id, true_class, predicted_class) of each row of queries; with by once for each of its values, in that column."""
    won = votes(neighbours(train, queries, k, by), ["query_id", "true_class", *([by] if by else [])], "query")
    return won.select(F.col("query_id").alias("id"), *([by] if by else []), "true_class", "predicted_class")


def predict_many(train: DataFrame, queries: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(id, k, true_class, predicted_class) for each k, from one pass with the largest."""
    ks = sorted(set(ks))
    near = neighbours(train, queries, ks[-1])
    each = near.withColumn("k", F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: k >= F.col("rank"))))
    won = votes(each, ["query_id", "true_class", "k"], "query")
    return won.select(F.col("query_id").alias("id"), "k", "true_class", "predicted_class")


def best_k(accuracies: DataFrame) -> DataFrame:
    """One row: the k of the best accuracy, the smallest of equals."""
    return accuracies.agg(F.max(F.struct("accuracy", (-F.col("k")).alias("k"))).alias("b")).select((-F.col("b.k")).alias("k"), F.col("b.accuracy").alias("accuracy"))

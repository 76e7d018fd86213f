"""Centroid clustering (13) over subvector dictionaries.

Components are whole numbers. The table is written once as blocks of vectors; in a block the dimensions are cut into runs, and
each run is encoded without loss: a dictionary of the run's distinct subvectors and a code for each vector. A run takes one more
dimension as long as its dictionary stays a small part of the block's rows, so dimensions that repeat together share codes. Every
round measures the distances of the dictionaries' subvectors to all centroids, once for each subvector, and a vector's
distance is the sum of these by its codes. Sums of clusters come from code counts the same way. All numbers are integers, so
results are exact and don't depend on blocks, partitions or order.

A dictionary belongs to its block, as a page of a file has its own: nothing that grows with the table is broadcast or held by the
driver, which sees k centroids and their sums alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import cut
from tabloom.llm.vectors import rows_of, usable

#: Vectors of a block; a dictionary of several dimensions holds this part of a block's rows at most.
ROWS, SHARE = 16_384, 8
#: Largest sum of squares of a block's numbers for which 64-bit arithmetic is exact; beyond it Python's integers are used.
_EXACT = 2**62


def _runs(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct subvectors, code of each row) for runs of dimensions."""
    most = max(1, len(x) // SHARE)
    lo = 0
    while lo < x.shape[1]:
        words, codes = np.unique(x[:, lo : lo + 1], axis=0, return_inverse=True)
        codes, hi = codes.ravel(), lo + 1
        while hi < x.shape[1] and len(words) < most:
            _, own = np.unique(x[:, hi], return_inverse=True)
            both, first, joint = np.unique(codes * (own.max() + 1) + own, return_index=True, return_inverse=True)
            if len(both) > most:
                break
            codes, hi = joint.ravel(), hi + 1
            words = x[first, lo:hi]
        yield words, codes
        lo = hi


def _encoded(batches: Iterator[pa.RecordBatch], dims: int, scale: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(vec_id, v) -> blocks (ids, named, words, sizes, codes); named: which rows have an id."""
    ids, named, x = np.empty(0, np.int64), np.empty(0, bool), np.empty((0, dims))

    def made(ids: np.ndarray, named: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        words, sizes, codes = [], [], []
        for w, c in _runs(x.astype(np.int64)):
            words.append(w.astype(np.int32).tobytes())
            sizes.append(w.shape[1])
            codes.append(c.astype(np.uint16).tobytes())
        cols = [pa.array([ids.tobytes()], pa.binary()), pa.array([named.tobytes()], pa.binary()), pa.array([words], pa.list_(pa.binary())), pa.array([sizes], pa.list_(pa.int32())), pa.array([codes], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(cols, ["ids", "named", "words", "sizes", "codes"])

    for batch in batches:
        id_col = batch.column("vec_id")
        for width, at, values in usable(batch.column("v"), scale):
            if width != dims:
                continue
            own = id_col.take(pa.array(at))
            ids = np.concatenate([ids, own.fill_null(0).to_numpy(zero_copy_only=False)])
            named, x = np.concatenate([named, own.is_valid().to_numpy(zero_copy_only=False)]), np.concatenate([x, values])
            while len(ids) >= rows:
                yield made(ids[:rows], named[:rows], x[:rows])
                ids, named, x = ids[rows:], named[rows:], x[rows:]
    if len(ids):
        yield made(ids, named, x)


class _Encoded:
    """A block read back: its dictionaries and codes, in longs or, for large numbers, in Python's integers."""

    def __init__(self, row: dict, centroids: np.ndarray):
        self.ids, self.named = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["named"], bool)
        self.runs = [(np.frombuffer(w, np.int32).reshape(-1, n), np.frombuffer(c, np.uint16)) for w, n, c in zip(row["words"], row["sizes"], row["codes"], strict=True)]
        most = max(int(np.abs(w.astype(np.int64)).max()) for w, _ in self.runs) + max(map(abs, map(int, centroids.ravel())))
        self.kind = np.int64 if most**2 * centroids.shape[1] < _EXACT else object

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each vector; ties to the smaller number."""
        total, lo = np.zeros((len(self.ids), len(centroids)), self.kind), 0
        for words, codes in self.runs:
            c = centroids[:, lo : lo + words.shape[1]].astype(self.kind)
            far = ((words.astype(self.kind)[:, None, :] - c[None]) ** 2).sum(axis=2)  # once for each subvector
            total += far[codes]
            lo += words.shape[1]
        at = total.argmin(axis=1)
        return at, total[np.arange(len(at)), at]

    def sums(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(sums of the vectors of each cluster, how many), from counts of codes."""
        out = []
        for words, codes in self.runs:
            counts = np.bincount(at * len(words) + codes, minlength=k * len(words)).reshape(k, len(words))
            out.append(counts @ words.astype(np.int64))  # under 2^31 * ROWS
        return np.concatenate(out, axis=1), np.bincount(at, minlength=k)


def _round(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each cluster and block: cluster, n, sums."""
    k = len(centroids)
    for row in rows_of(batches):
        block = _Encoded(row, centroids)
        sums, n = block.sums(block.nearest(centroids)[0], k)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for row in rows_of(batches):
        block = _Encoded(row, centroids)
        at, far = block.nearest(centroids)
        if block.kind is object and max(far) >= 2**63:
            raise ValueError("a squared distance doesn't fit a long")
        ids = pa.array(block.ids, mask=~block.named)
        yield pa.RecordBatch.from_arrays([ids, pa.array(at.astype(np.int32)), pa.array(far.astype(np.int64))], ["vec_id", "cluster", "distance"])


def _seeds(rows: DataFrame, k: int, dims: int, scale: int) -> np.ndarray:
    """The k usable vectors whose ids have the smallest hashes, ties by components; fewer if there are fewer."""
    shape = F.col("v").isNotNull() & (F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    first = rows.where(shape & F.col("vec_id").isNotNull()).withColumn("h", F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256))
    some = first.orderBy("h", "v").limit(k).select("v").collect()
    return np.array([np.floor(scale * np.array(r["v"], np.float64)) for r in some]).reshape(-1, dims).astype(np.int64)


def rounds_of(blocks: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after so many rounds: floors of exact means; an empty cluster keeps its centroid."""
    for _ in range(rounds):
        parts = blocks.mapInArrow(partial(_round, centroids=centroids), "cluster int, n long, sums array<long>")
        wide = T.DecimalType(38, 0)
        n = parts.groupBy("cluster").agg(F.sum("n").alias("n"))
        sums = parts.select("cluster", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum(F.col("s").cast(wide)).alias("s"))
        new = centroids.copy()
        for r in sums.join(F.broadcast(n), "cluster").collect():  # k * dims numbers
            new[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
        if (new == centroids).all():  # all further rounds give the same
            break
        centroids = new
    return centroids


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each usable vector.

    A component x is floor(scale * x). Vectors that are null, have another length than dims or hold null or non-finite components
    have no row; components beyond 2**31 after scaling raise. Centroids start as the k vectors whose ids hash smallest, in
    that order (all vectors, if there are fewer); repeated rows are counted as often as they stand, also as centroids; a
    null id has a row and is no start. Without vectors, or with null ids alone, there are no rows. Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    schema = "ids binary, named binary, words array<binary>, sizes array<int>, codes array<binary>"
    blocks = cut(rows.mapInArrow(partial(_encoded, dims=dims, scale=scale, rows=ROWS), schema), "encoded")
    centroids = _seeds(rows, k, dims, scale)
    out = "vec_id long, cluster int, distance long"
    if not len(centroids):
        empty = vectors.sparkSession.createDataFrame([], out)
        return empty.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    centroids = rounds_of(blocks, centroids, rounds)
    found = cut(blocks.mapInArrow(partial(_assigned, centroids=centroids), out), "assigned")
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    each = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(F.broadcast(vectors.sparkSession.createDataFrame(names, "cluster int, centroid_sha256 string")), "cluster")
    whole = each.agg(F.sum("cluster_inertia").alias("inertia"))
    return found.join(F.broadcast(each.crossJoin(F.broadcast(whole))), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64) -> str:
    """The same in DuckDB's SQL, a round after the other, over the view embeddings."""
    far = "CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    near = f"SELECT v.n, v.vec_id, v.x, arg_min(c.cluster, ({far}, c.cluster)) AS cluster, min({far}) AS distance FROM v, {{0}} c GROUP BY ALL"
    out = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
      WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
      f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS cluster, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {k}))"]
    for r in range(rounds):
        out.append(f"a{r} AS MATERIALIZED ({near.format(f'c{r}')})")
        out.append(f"d{r} AS (SELECT cluster, i, sum(x[i]) AS s, count(*) AS m FROM a{r}, range(1, {dims + 1}) d(i) GROUP BY ALL)")
        out.append(f"m{r} AS (SELECT cluster, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY i) AS x FROM d{r} GROUP BY cluster)")
        out.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} USING (cluster))")
    out.append(f"a AS MATERIALIZED ({near.format(f'c{rounds}')})")
    return f"""WITH {", ".join(out)}
    SELECT a.vec_id, CAST(a.cluster AS INT) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
      CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a JOIN c{rounds} c USING (cluster)"""

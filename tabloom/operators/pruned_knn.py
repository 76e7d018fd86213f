"""Exact nearest neighbours that skip blocks by distances to pivots.

Training rows go to the Voronoi cell of their closest pivot, stand in it by their distance, and are cut into blocks: shells of a cell.
A block knows the least and largest distance of its rows to every pivot. For a query at distance D from a pivot, no row of a
block is closer than D - largest or least - D, by the triangle inequality; the best of these bounds over all pivots counts.

Two rounds of joins. The first reads for each query the blocks of least bound that hold k rows or more: the k-th distance
found is an upper bound. The second reads every block whose lower bound doesn't exceed it. So the result is that of a full
comparison; what is saved depends on the rows: nearly all on clustered ones, nothing where all distances are alike.

Blocks are numbered in order, and GROUP training and ASKED query blocks that follow each other are a cell, to which each block that
a pair of it needs is sent once: where nothing is spared, training rows travel once for each ASKED * QUERIES queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators import knn
from tabloom.sources import tables
from tabloom.sources.tables import kept

#: Pivots; rows of a training block and of a query block (2^12 at most); training blocks and query blocks of a cell, at most.
PIVOTS, ROWS, QUERIES, GROUP, ASKED = 64, 256, 256, 64, 128
#: Training blocks whose bounds are one row; queries compared at once; neighbours that a cell gathers before it merges them.
ZONES, CHUNK, GATHERED = 1024, 4096, 1 << 18
#: Relative slack of bounds, for rounding.
SLACK = 1e-9
_BLOCK = "cell int, n int, ids binary, labels array<string>, x binary, low binary, high binary"


def _x(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("features").flatten().cast(pa.float64())).reshape(batch.num_rows, -1)


def _distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x[:, None, :] - to[None]) ** 2).sum(axis=2), 0)) if x.size * len(to) < 1 << 22 else np.concatenate([_distances(part, to) for part in np.array_split(x, 2)])


def _cells(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            d = _distances(_x(batch), pivots)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], [*batch.schema.names, "cell", "far"])


def _blocks(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, rows: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of (cell, far): a row for each run of up to `rows` of one cell."""
    cell, ids, labels, x = None, [], [], []

    def made() -> pa.RecordBatch:
        own = np.concatenate(x)
        d = _distances(own, pivots)
        parts = [pa.array([cell], pa.int32()), pa.array([len(own)], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([sum(labels, [])], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*parts, *[pa.array([b.tobytes()], pa.binary()) for b in (own, d.min(axis=0), d.max(axis=0))]], [c.split()[0] for c in _BLOCK.split(", ")])

    for batch in batches:
        cells = np.asarray(batch.column("cell"))
        lo = 0
        while lo < len(cells):
            if cell is not None and (cells[lo] != cell or sum(map(len, ids)) == rows):
                yield made()
                ids, labels, x = [], [], []
            cell = int(cells[lo])
            run = lo + int((cells[lo:] != cell).argmax() if (cells[lo:] != cell).any() else len(cells) - lo)
            hi = min(run, lo + rows - sum(map(len, ids)))
            part = batch.slice(lo, hi - lo)
            ids.append(np.asarray(part.column("id").cast(pa.int64())))
            labels.append(part.column("label").to_pylist())
            x.append(_x(part))
            lo = hi
    if ids:
        yield made()


def _zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to ZONES blocks' numbers, sizes and bounds in a row."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ZONES):
            part = batch.slice(lo, ZONES)
            joined = [np.asarray(part.column("block")).tobytes(), np.asarray(part.column("n")).tobytes(), *[b"".join(part.column(c).to_pylist()) for c in ("low", "high")]]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in joined], ["blocks", "sizes", "low", "high"])


def lower_bounds(d: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of queries at distances d from the pivots: what rows of blocks with these distances are away at least."""
    out = np.zeros((len(d), len(low)))
    for j in range(d.shape[1]):
        np.maximum(out, d[:, j, None] - high[None, :, j], out=out)
        np.maximum(out, low[None, :, j] - d[:, j, None], out=out)
    return out


def _off_middle(d: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How far queries are from the middles of blocks, at the pivot where that is most."""
    out = np.zeros((len(d), len(low)))
    for j in range(d.shape[1]):
        np.maximum(out, np.abs(d[:, j, None] - (low[None, :, j] + high[None, :, j]) / 2), out=out)
    return out


_PLAN = "row int, col int, is_query boolean, block long, x binary, n int, reach binary, blocks binary, sizes binary, low binary, high binary"


def _planned(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """(queries, block, needed: bits) of blocks that queries must read. Without a reach, of each pack the first blocks by bound
    that hold k rows; with one, all within it."""
    key, zones = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["row"], row["col"]) != key:
                key, zones = (row["row"], row["col"]), []
            if not row["is_query"]:
                zones.append((np.frombuffer(row["blocks"], np.int64), np.frombuffer(row["sizes"], np.int32), *[np.frombuffer(row[c]).reshape(-1, len(pivots)) for c in ("low", "high")]))
                continue
            if len(zones) > 1:
                zones = [tuple(map(np.concatenate, zip(*zones, strict=True)))]
            d = _distances(np.frombuffer(row["x"]).reshape(row["n"], -1), pivots)
            for blocks, sizes, low, high in zones:
                bound = lower_bounds(d, low, high)
                if row["reach"] is None:
                    # equal bounds, as of all blocks around a query: the closest middle first
                    order = np.lexsort((_off_middle(d, low, high), bound), axis=1)
                    before = np.cumsum(sizes[order], axis=1) - sizes[order]
                    needed = np.zeros(bound.shape, bool)
                    np.put_along_axis(needed, order, before < k, axis=1)
                else:
                    needed = bound <= np.frombuffer(row["reach"])[:, None] * (1 + SLACK) + SLACK
                some = np.flatnonzero(needed.any(axis=0))
                if len(some):
                    bits = [b.tobytes() for b in np.packbits(needed[:, some].T, axis=1)]
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(some)), pa.array(blocks[some]), pa.array(bits, pa.binary())], ["queries", "block", "needed"])


class _Cell:
    """Query blocks, and the k best rows found of each query so far; none beyond its reach."""

    def __init__(self, k: int):
        self.k, self.blocks, self.first, self.n = k, [], {}, 0
        self.new, self.gathered, self.best = [], 0, 0

    def ask(self, row: dict) -> None:
        ids = np.frombuffer(row["ids"], np.int64)
        reach = np.full(len(ids), np.inf) if row["reach"] is None else np.frombuffer(row["reach"])
        self.blocks.append((row["block"], ids, row["labels"], np.frombuffer(row["x"]).reshape(len(ids), -1), reach**2 * (1 + SLACK) + SLACK))
        self.first[row["block"]] = self.n, len(ids)
        self.n += len(ids)

    def read(self, row: dict) -> None:
        if not self.new and not self.best:
            self.x, self.most = (np.concatenate([b[i] for b in self.blocks]) for i in (3, 4))
        ids, labels = np.frombuffer(row["ids"], np.int64), np.array(row["labels"], object)
        x = np.frombuffer(row["x"]).reshape(len(ids), -1)
        who = []
        for r in row["needed"]:
            first, n = self.first[r["queries"]]
            who.append(first + np.flatnonzero(np.unpackbits(np.frombuffer(r["needed"], np.uint8), count=n)))
        who = np.concatenate(who)
        for lo in range(0, len(who), CHUNK):
            some = who[lo : lo + CHUNK]
            at, to, d = knn._nearest(self.x[some], x, ids, self.k)
            near = d <= self.most[some[at]]
            at, to, d = some[at[near]], to[near], d[near]
            self.new.append((at, ids[to], labels[to], d))
            self.gathered += len(at)
        if self.gathered > max(GATHERED, 2 * self.best):
            self.merge()

    def merge(self) -> None:
        at, to, labels, d = (np.concatenate(c) for c in zip(*self.new, strict=True))
        keep = knn._first(at, to, d, self.k)  # in order of query and distance
        at, to, labels, d = at[keep], to[keep], labels[keep], d[keep]
        last = np.flatnonzero(np.bincount(at, minlength=self.n)[at] == self.k)[self.k - 1 :: self.k]
        self.most[at[last]] = d[last]
        self.new, self.best, self.gathered = [(at, to, labels, d)], len(at), len(at)

    def found(self) -> Iterator[pa.RecordBatch]:
        if not self.new:
            return
        self.merge()
        at, *rest = self.new[0]
        for block, ids, labels, _, _ in self.blocks:
            first, n = self.first[block]
            lo, hi = np.searchsorted(at, (first, first + n))
            if hi > lo:
                yield knn.found(block, ids, labels, 0, at[lo:hi] - first, *[c[lo:hi] for c in rest])


_MET = "asked long, group long, kind int, block long, ids binary, labels array<string>, x binary, reach binary, needed array<struct<queries:long,needed:binary>>"


def _read(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of each cell the query blocks (kind 0), which are held, then the training blocks that they need (1): the k best of each query."""
    key, cell = None, _Cell(k)
    for row in knn.one_by_one(batches):
        if (row["asked"], row["group"]) != key:
            yield from cell.found()
            key, cell = (row["asked"], row["group"]), _Cell(k)
        (cell.read if row["kind"] else cell.ask)(row)
    yield from cell.found()


def _reach(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(block, reach): the k-th distance found of each query of a block; infinite where fewer were."""
    for batch in batches:
        for row in batch.to_pylist():
            reach = np.full(row["n"], np.inf)
            for r in row["found"] or ():
                if r["rank"] == k:
                    reach[r["query"] & 4095] = np.sqrt(r["distance"])
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([reach.tobytes()], pa.binary())], ["block", "reach"])


class Search:
    """Training rows in blocks with bounds, asked any number of times."""

    def __init__(self, train: DataFrame, pivots: int = PIVOTS):
        """pivots: a bounded sample of the rows, by hash of their ids."""
        rows = train.select("id", "label", "features")
        picked = rows.orderBy(F.xxhash64("id"), "id", "features").limit(pivots).select("features").collect()
        self.pivots = np.array([r["features"] for r in picked], np.float64)
        self.spark, self.n = train.sparkSession, 0
        if not len(picked):
            return
        self.blocks = kept(self._sorted(rows, ROWS), "shells")
        packs = self.blocks.select("block", "n", "low", "high").repartition(F.floor(F.col("block") / ZONES)).sortWithinPartitions("block")
        self.zones = kept(packs.mapInArrow(_zones, "blocks binary, sizes binary, low binary, high binary").withColumn("block", F.monotonically_increasing_id()), "zones")
        self.n = self.zones.count()

    def _sorted(self, rows: DataFrame, size: int) -> DataFrame:
        """Blocks of rows close to each other, numbered in order; a hot cell is cut by distance and id, so no partition grows with it."""
        placed = rows.mapInArrow(partial(_cells, pivots=self.pivots), "id long, label string, features array<double>, cell int, far double")
        parts = max(2 * self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        ranged = placed.repartitionByRange(parts, "cell", "far", "id").sortWithinPartitions("cell", "far", "id")
        made = ranged.mapInArrow(partial(_blocks, pivots=self.pivots, rows=size), _BLOCK)
        return tables._numbered(kept(made.withColumns({"__at": F.monotonically_increasing_id(), "__part": F.spark_partition_id()}), "sorted"), ["__part"], "block")

    def plan(self, asked: DataFrame, k: int) -> DataFrame:
        """(queries, block, needed) for blocks of queries with reach (null: the first round)."""
        qn, spread = asked.count(), 2 * self.spark.sparkContext.defaultParallelism
        rows, columns = max(1, min(qn, spread)), max(1, -(-self.n // 16))
        none = lambda *names: [F.lit(None).cast("binary").alias(n) for n in names]
        place = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        z = self.zones.withColumn("col", place(columns)).withColumn("row", every(rows)).select("row", "col", F.lit(False).alias("is_query"), "block", *none("x"), F.lit(None).cast("int").alias("n"), *none("reach"), "blocks", "sizes", "low", "high")
        q = asked.withColumn("row", place(rows)).withColumn("col", every(columns)).select("row", "col", F.lit(True).alias("is_query"), "block", "x", "n", "reach", *none("blocks", "sizes", "low", "high"))
        met = z.unionByName(q).repartition(rows * columns, "row", "col").sortWithinPartitions("row", "col", "is_query")
        planned = met.mapInArrow(partial(_planned, pivots=self.pivots, k=k), "queries long, block long, needed binary")
        return kept(planned, "plan")

    def read(self, asked: DataFrame, plan: DataFrame, k: int) -> DataFrame:
        """The k best rows of each query among the blocks of its plan, as knn.neighbours gives them."""
        tn, qn, group, ask = self.blocks.count(), asked.count(), GROUP, ASKED
        while max(group, ask) > 1 and -(-tn // group) * -(-qn // ask) < 2 * self.spark.sparkContext.defaultParallelism:
            group, ask = max(1, group // 2), max(1, ask // 2)
        cells = plan.select("*", F.floor(F.col("queries") / ask).alias("asked"), F.floor(F.col("block") / group).alias("group"))
        who = cells.select("asked", "group", "queries").distinct().join(asked.withColumnRenamed("block", "queries"), "queries")
        who = who.select("asked", "group", F.lit(0).alias("kind"), F.col("queries").alias("block"), "ids", "labels", "x", "reach", F.lit(None).cast("array<struct<queries:long,needed:binary>>").alias("needed"))
        need = cells.groupBy("asked", "group", "block").agg(F.collect_list(F.struct("queries", "needed")).alias("needed")).join(self.blocks, "block")  # ASKED at most
        need = need.select("asked", "group", F.lit(1).alias("kind"), "block", "ids", "labels", "x", F.lit(None).cast("binary").alias("reach"), "needed")
        parts = max(1, -(-tn // group) * -(-qn // ask))
        met = who.unionByName(need).repartition(parts, "asked", "group").sortWithinPartitions("asked", "group", "kind", "block")
        return knn.ranked(met.mapInArrow(partial(_read, k=k), knn.FOUND), k)

    def neighbours(self, queries: DataFrame, k: int) -> DataFrame:
        """As knn.neighbours without by: (query, query_id, true_class, rank, train_id, label, distance)."""
        if k <= 0:
            raise ValueError("k must be positive")
        if not self.n:
            return knn.ranked(self.spark.createDataFrame([], knn.FOUND), k)
        asked = kept(self._sorted(queries.select("id", "label", "features"), QUERIES).withColumn("reach", F.lit(None).cast("binary")), "asked")
        near = self.read(asked, self.plan(asked, k), k)
        some = near.groupBy(F.shiftright("query", 12).alias("block")).agg(F.collect_list(F.struct("query", "rank", "distance")).alias("found"))  # k for each of QUERIES rows
        reach = asked.select("block", "n").join(some, "block", "left").mapInArrow(partial(_reach, k=k), "block long, reach binary")
        asked = kept(asked.drop("reach").join(reach, "block"), "asked")
        return self.read(asked, self.plan(asked, k), k)


def topk(train: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, train_id, label, distance): what knn.topk gives, without reading blocks that are too far."""
    return Search(train, pivots).neighbours(queries, k).select("query_id", "rank", "train_id", "label", "distance")

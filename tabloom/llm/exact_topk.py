"""Exact top-k search (11) by a three-phase uniform threshold over lists of partial scores.

The components of all vectors are cut into LISTS parts; a part's inner products with a query are one list of local scores, and a
score is the sum over the lists.

1. Each cell of the grid (some query blocks, some row blocks, one part) sends the k best of its list for each query. What they
   name is scored in full; the k-th best of these scores, c, is a safe cutoff: k rows reach it.
2. A row of score c or more has a local score of c / LISTS or more in some list, as the sum were smaller otherwise. The cutoff
   goes out with the query's block, and each cell sends all entries from there on.
3. The entries of all lists meet. Each has an upper bound (its known parts, and less than the cutoff for others); those that can't reach
   the k-th best full score known so far go, the others' missing parts are resolved from the vectors.

Scores are whole numbers, so bounds and ties are exact. There are as many cutoffs as queries, so they travel with the query blocks
and aren't broadcast to all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import cut
from tabloom.llm.vectors import BLOCK, blocks_of, dealt, exact, first_k, grid, integers, packed, paired, products, rows_of, unpacked

#: Parts of the components. Two keep the most of a cutoff in each list where components don't depend on each other.
LISTS = 2
_NONE = -(2**62)
_CELL = ("width", "part", "row", "col")
_MET = "width int, part int, row int, col int, kind int, block long, other long, ids binary, x array<binary>, more binary"
_TYPES = [pa.int32()] * 5 + [pa.int64()] * 2 + [pa.binary(), pa.list_(pa.binary()), pa.binary()]
_NAMES = [f.split()[0] for f in _MET.split(", ")]


class _Block:
    """Ids, components (of one part, or of all) and cutoffs of a block."""

    def __init__(self, row: dict, widths: list[int]):
        self.block, self.ids = row["block"], np.frombuffer(row["ids"], np.int64)
        self.x = np.concatenate([unpacked(x, len(self.ids), w) for x, w in zip(row["x"], widths, strict=True)], axis=1)
        self.cutoffs = np.frombuffer(row["more"], np.int64) if row["more"] else np.full(len(self.ids), _NONE)

    def bars(self, lists: int) -> np.ndarray:
        """What an entry must reach in some list."""
        return np.where(self.cutoffs == _NONE, _NONE // 2, -(-self.cutoffs // lists))


def _widths(width: int, lists: int) -> list[int]:
    return [len(p) for p in np.array_split(np.arange(width), lists)]


def _entries(q: np.ndarray, at: np.ndarray, s: np.ndarray) -> bytes:
    """How many, their places in both blocks, and local scores in the smallest type."""
    scores = s.astype(np.int64).tobytes() if np.abs(s).max() >= 2**31 else packed(s)
    return np.int64(len(s)).tobytes() + q.astype(np.int16).tobytes() + at.astype(np.int16).tobytes() + scores


def _read_entries(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    each = (len(data) - 8 - 4 * n) // n
    places = np.frombuffer(data, np.int16, 2 * n, 8).astype(int)
    return places[:n], places[n:], np.frombuffer(data, f"i{each}", n, 8 + 4 * n).astype(np.int64)


def _scores(q: _Block, t: _Block) -> np.ndarray:
    """Local scores; a query's own id gets none."""
    s = products(q.x, t.x)
    for i in np.flatnonzero(np.isin(q.ids, t.ids)):
        s[i, t.ids == q.ids[i]] = _NONE
    return s


def _lists(batches: Iterator[pa.RecordBatch], k: int, lists: int, cutoffs: bool) -> Iterator[pa.RecordBatch]:
    """Entries of the cells' lists: each query's k best, or with cutoffs all that reach its cutoff.

    One row for each pair of blocks that has entries: (width, row, col, block of queries, other: block of rows, more: places of
    queries and rows, and local scores)."""
    key, held = None, []
    for row in rows_of(batches):
        if tuple(row[c] for c in _CELL) != key:
            key, held = tuple(row[c] for c in _CELL), []
        b = _Block(row, [_widths(row["width"], lists)[row["part"]]])
        if row["kind"] == 0:
            held.append(b)
            continue
        found = []
        bars = b.bars(lists)
        for n, t in enumerate(held):
            s = _scores(b, t)
            if cutoffs:
                q, at = np.nonzero(s >= bars[:, None])
            else:
                some = min(k, s.shape[1])
                top = np.argpartition(-s, some - 1, axis=1)[:, :some]
                q, at = np.repeat(np.arange(len(s)), some), top.ravel()
                real = s[q, at] > _NONE
                q, at = q[real], at[real]
            found.append((np.full(len(q), n), q, at, exact(s[q, at])))
        if not found:
            continue
        n, q, at, s = (np.concatenate(c) for c in zip(*found, strict=True))
        if not cutoffs:  # the best of the cell's blocks together
            best = first_k(q, n * BLOCK + at, s, k)
            n, q, at, s = n[best], q[best], at[best], s[best]
        out = []
        for i, t in enumerate(held):
            own = n == i
            if own.any():
                out.append((row["width"], row["part"], row["row"], row["col"], 2, row["block"], t.block, None, None, _entries(q[own], at[own], s[own])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)


def _resolve(batches: Iterator[pa.RecordBatch], k: int, lists: int, cutoffs: bool) -> Iterator[pa.RecordBatch]:
    """Each cell's best in full: its row blocks and query blocks are held, then the entries of all lists come by pair of blocks.

    Returns (block of queries, more: places of queries, vec_ids, scores), k for each query at most."""
    key, rows, asked = None, {}, {}
    now, entry = None, []
    best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    low: dict[int, np.ndarray] = {}

    def pair() -> None:
        """Resolves what the lists have sent of the pair of blocks `now`."""
        if now is None:
            return
        q, t = asked[now[0]], rows[now[1]]
        floor = low.setdefault(now[0], q.cutoffs.copy())
        known, seen = np.zeros((len(q.ids), len(t.ids)), np.int64), np.zeros((len(q.ids), len(t.ids)), np.int8)
        for i, at, s in entry:
            known[i, at] += s
            seen[i, at] += 1
        i, at = np.nonzero(seen)
        score, missing = known[i, at], lists - seen[i, at]
        if cutoffs:  # what a list hasn't sent is under its cutoff
            able = (q.cutoffs[i] == _NONE) | (score + missing * (q.bars(lists)[i] - 1) >= floor[i])
            i, at, score, missing = i[able], at[able], score[able], missing[able]
        open_ = np.flatnonzero(missing > 0)
        for lo in range(0, len(open_), 65_536):
            some = open_[lo : lo + 65_536]
            score[some] = paired(q.x[i[some]], t.x[at[some]])
        fine = score >= floor[i]
        old = best.get(now[0], (np.empty(0, int), np.empty(0, np.int64), np.empty(0, np.int64)))
        merged = [np.concatenate(c) for c in zip(old, (i[fine], t.ids[at[fine]], score[fine]), strict=True)]
        first = first_k(*merged, k)
        best[now[0]] = tuple(c[first] for c in merged)
        who, count = np.unique(merged[0][first], return_counts=True)
        full = who[count >= k]
        last = np.searchsorted(merged[0][first], full, "right") - 1
        floor[full] = np.maximum(floor[full], merged[2][first][last])

    def made() -> Iterator[pa.RecordBatch]:
        pair()
        for block, (q, ids, s) in best.items():
            if len(q):
                data = np.stack([q, ids, s]).astype(np.int64).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([asked[block].ids.tobytes()], pa.binary()), pa.array([data], pa.binary())], ["block", "ids", "more"])

    for row in rows_of(batches):
        cell = row["width"], row["row"], row["col"]
        if cell != key:
            yield from made()
            key, rows, asked, now, entry, best, low = cell, {}, {}, None, [], {}, {}
        if row["kind"] == 0:
            rows[row["block"]] = _Block(row, _widths(row["width"], lists))
        elif row["kind"] == 1:
            asked[row["block"]] = _Block(row, _widths(row["width"], lists))
        else:
            if (row["block"], row["other"]) != now:
                pair()
                now, entry = (row["block"], row["other"]), []
            entry.append(_read_entries(row["more"]))
    yield from made()


def _best(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of rows (block, ids, more) in order of block: (block, its ids, the k best entries of each place over all cells)."""
    block, ids, held = None, None, np.empty((3, 0), np.int64)
    for row in rows_of(batches):
        if row["block"] != block:
            if block is not None:
                yield block, ids, held
            block, ids, held = row["block"], np.frombuffer(row["ids"], np.int64), np.empty((3, 0), np.int64)
        held = np.concatenate([held, np.frombuffer(row["more"], np.int64).reshape(3, -1)], axis=1)
        held = held[:, first_k(held[0], held[1], held[2], k)]
    if block is not None:
        yield block, ids, held


def _cutoffs(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(block, more): the k-th best score of each query of the block, _NONE where there are fewer."""
    for block, ids, (q, _, s) in _best(batches, k):
        out = np.full(len(ids), _NONE)
        who, start, count = np.unique(q, return_index=True, return_counts=True)
        out[who[count >= k]] = s[start[count >= k] + k - 1]
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([out.tobytes()], pa.binary())], ["block", "cutoffs"])


def _answers(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for _, ids, (q, vec, s) in _best(batches, k):
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(vec), pa.array(s)], ["query_id", "vec_id", "score"])


def search(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", lists: int = LISTS) -> DataFrame:
    """The k rows of highest score for each row whose id is divisible by `every`: query_id, rank (from 1), vec_id, score long.

    A component x is floor(scale * x); a score is the inner product of such integers; ties go to the smaller vec_id; all
    rows but those of the query's id are candidates, all of them if there are fewer than k. Vectors that are null or hold null
    or non-finite components take no part, nor do null ids; components beyond 2**31 after scaling raise. A query meets vectors of
    its own length alone, as an inner product needs one length. Of several rows with one id all take part, as one candidate or
    query with its best score. Of equal vectors only the k + 1 smallest ids are searched, as no more can be in an answer.
    An empty table gives an empty table; other columns, whatever their names, are not read.
    """
    rows = cut(integers(vectors, scale, id_col, vec_col).distinct(), "integers")
    place = F.row_number().over(Window.partitionBy("width", "x").orderBy("vec_id"))
    few = rows.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    schema = "width int, ids binary, parts array<binary>"
    pack = partial(blocks_of, lists=lists, rows=BLOCK)
    numbered = lambda df, name: cut(df.mapInArrow(pack, schema).withColumn("block", F.monotonically_increasing_id()), name)
    t, q = numbered(few, "rows"), numbered(rows.where(F.col("vec_id") % every == 0), "queries")
    r, c = grid(q.count(), t.count(), vectors.sparkSession.sparkContext.defaultParallelism)

    def placed(blocks: DataFrame, kind: int, split: bool) -> DataFrame:
        """Blocks of rows (kind 0) or queries (1) in the grid, whole or once for each part."""
        own, size, other, others = ("col", c, "row", r) if kind == 0 else ("row", r, "col", c)
        x = F.posexplode(F.transform("parts", lambda p: F.array(p))).alias("part", "x")
        each = blocks.select("width", "block", "ids", "cutoffs", x) if split else blocks.select("width", "block", "ids", "cutoffs", F.lit(0).alias("part"), F.col("parts").alias("x"))
        out = dealt(each, own, size, other, others)
        return out.select("width", "part", "row", "col", F.lit(kind).alias("kind"), "block", F.lit(None).cast("long").alias("other"), "ids", "x", F.col("cutoffs").alias("more"))

    def best_of_cells(queries: DataFrame, cutoffs: bool) -> DataFrame:
        """The lists of all cells by part, then what they name in full."""
        rows = t.withColumn("cutoffs", F.lit(None).cast("binary"))
        met = placed(rows, 0, True).unionByName(placed(queries, 1, True))
        met = met.repartition(r * c * lists, *_CELL).sortWithinPartitions(*_CELL, "kind", "block")
        found = met.mapInArrow(partial(_lists, k=k, lists=lists, cutoffs=cutoffs), _MET)
        met = placed(rows, 0, False).unionByName(placed(queries, 1, False)).unionByName(found)
        met = met.repartition(r * c, "width", "row", "col").sortWithinPartitions("width", "row", "col", "kind", "block", "other", "part")
        best = met.mapInArrow(partial(_resolve, k=k, lists=lists, cutoffs=cutoffs), "block long, ids binary, more binary")
        return best.repartition("block").sortWithinPartitions("block")

    first = best_of_cells(q.withColumn("cutoffs", F.lit(None).cast("binary")), False)
    cutoffs = first.mapInArrow(partial(_cutoffs, k=k), "block long, cutoffs binary")
    found = best_of_cells(cut(q.join(cutoffs, "block", "left"), "cutoffs"), True).mapInArrow(partial(_answers, k=k), "query_id long, vec_id long, score long")
    each = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sql(k: int = 20, every: int = 20, scale: int = 64) -> str:
    """The same in DuckDB's SQL, over the view embeddings."""
    return f"""
    WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, t.vec_id, max(CAST(coalesce(list_sum(list_transform(list_zip(q.x, t.x), lambda p: p[1] * p[2])), 0) AS BIGINT)) AS score
      FROM v q JOIN v t ON q.vec_id <> t.vec_id AND len(q.x) = len(t.x) WHERE q.vec_id % {every} = 0 GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""

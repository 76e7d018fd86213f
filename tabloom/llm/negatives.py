"""Hard-negative mining (12) over Hilbert-ordered blocks with zone maps.

Candidates are sorted by length, label and place on a Hilbert curve through their components, cut into blocks of ROWS rows of one
label and written as Parquet, a row for each block: ids and components, and the least and largest value of each dimension
(its zone map). For an anchor a, interval arithmetic over a zone map bounds all inner products with the block's rows: from
the sum of the smaller of a_d * least_d and a_d * largest_d to the sum of the larger.

Both searches take two steps. The first reads for each anchor a few promising blocks; the scores found there, k of them, are a bar. The
second reads every block whose bounds allow a score at the bar or above it within the window sought:

* positives: blocks of the anchor's label; the bar is the last of the best found so far;
* negatives: blocks of other labels that meet the score window of one of the anchor's positives; a bar for each window.

Which blocks an anchor needs is planned from the zone maps alone; only needed blocks are joined and sent, once to each group of anchors
that needs them. Scores are whole numbers and bounds are exact, so no row is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import cut
from tabloom.llm.vectors import dealt, exact, first_k, grid, integers, packed, products, read_ints, rows_of, unpacked

#: Rows of a candidate block; anchors of a block; zone maps that are planned together; candidate blocks of a group.
ROWS, ANCHORS, ZONES, GROUP = 128, 256, 512, 64
#: Blocks that the first step reads for each anchor and pack of zone maps; bits of the curve in each dimension.
FIRST, BITS = 2, 2
_NONE = -(2**62)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of cells (rows x dims, numbers of `bits` bits), as rows of 0 and 1, most significant first.

    Each level looks at one bit of all dimensions: a dimension with the bit set turns the lower bits of the first one over, one
    without it exchanges them with the first one's. What the turns leave is a Gray code over dimensions and levels.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    if not dims:
        return np.zeros((len(cells), 0), np.int64)
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for d in range(dims):
            on = (x[d] >> level & 1).astype(bool)
            swap = np.where(on, 0, (x[0] ^ x[d]) & below)
            x[0] ^= np.where(on, below, swap)
            x[d] ^= swap
    planes = np.stack([x[d] >> level & 1 for level in range(bits - 1, -1, -1) for d in range(dims)], axis=1)
    # the parity of all bits before: the Gray code read as a number
    return np.bitwise_xor.accumulate(planes, axis=1)


def curve_key(x: np.ndarray, middle: np.ndarray, spread: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Keys that sort vectors along the curve: the grid's cells are quarters of a bell curve around each dimension's middle."""
    edges = np.array([-0.6745, 0.0, 0.6745])  # quartiles
    cells = (((x - middle) / np.where(spread > 0, spread, 1))[:, :, None] > edges).sum(axis=2)
    return [r.tobytes() for r in np.packbits(hilbert(cells, bits).astype(np.uint8), axis=1)]


def _keyed(batches: Iterator[pa.RecordBatch], shapes: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        widths = np.asarray(batch.column("width"))
        for width in np.unique(widths):
            rows = batch.take(pa.array(np.flatnonzero(widths == width)))
            keys = curve_key(read_ints(rows.column("x"), int(width)), *shapes[int(width)])
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(keys, pa.binary())], [*rows.schema.names, "key"])


_BLOCK = "width int, label long, ids binary, x binary, low binary, high binary"


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (width, label, key): a row for each run of up to `rows` of one width and label."""
    key, ids, x = None, np.empty(0, np.int64), np.empty((0, 0))

    def made(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        values = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64())]
        values += [pa.array([b], pa.binary()) for b in (ids.tobytes(), packed(x), packed(x.min(axis=0)), packed(x.max(axis=0)))]
        return pa.RecordBatch.from_arrays(values, [c.split()[0] for c in _BLOCK.split(", ")])

    for batch in batches:
        widths, labels, all_ids = (np.asarray(batch.column(c)) for c in ("width", "label", "vec_id"))
        changes = np.flatnonzero((widths[1:] != widths[:-1]) | (labels[1:] != labels[:-1])) + 1
        for lo, hi in zip([0, *changes], [*changes, len(widths)], strict=True):
            if lo == hi:
                continue
            if (widths[lo], labels[lo]) != key:
                if len(ids):
                    yield made(ids, x)
                key, ids, x = (widths[lo], labels[lo]), np.empty(0, np.int64), np.empty((0, widths[lo]))
            ids, x = np.concatenate([ids, all_ids[lo:hi]]), np.concatenate([x, read_ints(batch.column("x").slice(lo, hi - lo), int(widths[lo]))])
            while len(ids) >= rows:
                yield made(ids[:rows], x[:rows])
                ids, x = ids[rows:], x[rows:]
    if len(ids):
        yield made(ids, x)


def _anchor_blocks(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    """(width, ids, labels, x) of up to ANCHORS anchors each, in the candidates' order."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

    def made(width: int) -> pa.RecordBatch:
        ids, labels, x = (np.concatenate(c) for c in zip(*held.pop(width), strict=True))
        cols = [pa.array([width], pa.int32())] + [pa.array([b], pa.binary()) for b in (ids.tobytes(), labels.tobytes(), packed(x))]
        return pa.RecordBatch.from_arrays(cols, ["width", "ids", "labels", "x"])

    for row in rows_of(batches):
        ids = np.frombuffer(row["ids"], np.int64)
        own = ids % every == 0
        if own.any():
            parts = held.setdefault(row["width"], [])
            parts.append((ids[own], np.full(own.sum(), row["label"]), unpacked(row["x"], len(ids), row["width"])[own]))
            if sum(len(p[0]) for p in parts) >= ANCHORS - ROWS:
                yield made(row["width"])
    for width in list(held):
        yield made(width)


class _Anchors:
    """A block of anchors; windows: (anchor, positive_id, positive_score, low, high), in order of anchors."""

    def __init__(self, row: dict):
        self.block, self.width, self.ids = row["block"], row["width"], np.frombuffer(row["ids"], np.int64)
        self.labels = np.frombuffer(row["labels"], np.int64)
        self.x = unpacked(row["x"], len(self.ids), row["width"])
        self.windows = np.frombuffer(row["windows"] or b"", np.int64).reshape(-1, 5).T

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        up, down = np.maximum(self.x, 0), np.minimum(self.x, 0)
        return exact(products(up, low)) + exact(products(down, high)), exact(products(up, high)) + exact(products(down, low))


def _zone_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Zone maps of up to ZONES blocks of one width in a row: (width, blocks, labels, low, high)."""
    held: dict[int, list[dict]] = {}

    def made(width: int) -> pa.RecordBatch:
        rows = held.pop(width)
        bound = lambda c: np.concatenate([unpacked(r[c], 1, width) for r in rows])
        cols = [pa.array([width], pa.int32())] + [pa.array([b], pa.binary()) for b in (np.array([r["block"] for r in rows]).tobytes(), np.array([r["label"] for r in rows]).tobytes(), packed(bound("low")), packed(bound("high")))]
        return pa.RecordBatch.from_arrays(cols, ["width", "blocks", "labels", "low", "high"])

    for row in rows_of(batches):
        rows = held.setdefault(row["width"], [])
        rows.append(row)
        if len(rows) == ZONES:
            yield made(row["width"])
    for width in list(held):
        yield made(width)


def _needs(a: _Anchors, zone_labels: np.ndarray, low: np.ndarray, high: np.ndarray, positive: bool, first: bool) -> np.ndarray:
    """Which zones each anchor needs: anchors x zones."""
    least, most = a.bounds(low, high)
    same = a.labels[:, None] == zone_labels[None, :]
    able = np.zeros(same.shape, bool)
    for i, _, _, lo, hi in a.windows.T if len(a.windows) else ():
        able[i] |= (most[i] >= lo) & (least[i] <= hi)
    able &= same if positive else ~same
    if first:  # the most promising: the score of a zone's middle
        middle = np.where(able, (least + most).astype(float), -np.inf)
        some = min(FIRST, middle.shape[1])
        keep = np.zeros(able.shape, bool)
        np.put_along_axis(keep, np.argpartition(-middle, some - 1, axis=1)[:, :some], True, axis=1)
        able &= keep
    return able


_PLAN = "row int, col int, kind int, width int, block long, ids binary, labels binary, x binary, windows binary, blocks binary, low binary, high binary"


def _planned(batches: Iterator[pa.RecordBatch], positive: bool, first: bool) -> Iterator[pa.RecordBatch]:
    """Cells of packs of zone maps (kind 0) and blocks of anchors (1): a row (anchors, block, needed: bits) for each block that
    anchors of a block need."""
    key, zones = None, []
    for row in rows_of(batches):
        if (row["width"], row["row"], row["col"]) != key:
            key, zones = (row["width"], row["row"], row["col"]), []
        if row["kind"] == 0:
            n = len(row["blocks"]) // 8
            zones.append((np.frombuffer(row["blocks"], np.int64), np.frombuffer(row["labels"], np.int64), unpacked(row["low"], n, row["width"]), unpacked(row["high"], n, row["width"])))
            continue
        a = _Anchors(row)
        for blocks, labels, low, high in zones:
            needed = _needs(a, labels, low, high, positive, first)
            some = np.flatnonzero(needed.any(axis=0))
            if len(some):
                bits = [b.tobytes() for b in np.packbits(needed[:, some].T, axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array([a.block] * len(some)), pa.array(blocks[some]), pa.array(bits, pa.binary())], ["anchors", "block", "needed"])


_READ = "anchors long, group long, kind int, block long, width int, ids binary, labels binary, x binary, windows binary, needed binary"


def _scored(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """For each block of anchors (kind 0) and the blocks it needs of a group (1): the k best rows of each window,
    (anchors, window, vec_id, score)."""
    a, found, held = None, [], 0

    def best() -> list[np.ndarray]:
        w, ids, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        first = first_k(w, ids, score, k)
        return [w[first], ids[first], score[first]]

    def made() -> Iterator[pa.RecordBatch]:
        w, ids, score = best()
        if len(w):
            yield pa.RecordBatch.from_arrays([pa.array([a.block] * len(w)), pa.array(w), pa.array(ids), pa.array(score)], ["anchors", "window", "vec_id", "score"])

    for row in rows_of(batches):
        if row["kind"] == 0:
            if a is not None:
                yield from made()
            a, found, held = _Anchors(row | {"block": row["anchors"]}), [], 0
            continue
        ids = np.frombuffer(row["ids"], np.int64)
        needed = np.unpackbits(np.frombuffer(row["needed"], np.uint8), count=len(a.ids)).astype(bool)
        who = np.flatnonzero(needed)
        scores = exact(products(a.x[who], unpacked(row["x"], len(ids), a.width)))
        place = np.full(len(a.ids), -1)
        place[who] = np.arange(len(who))
        anchor, _, _, low, high = a.windows
        for lo in range(0, len(anchor), 256):
            some = np.flatnonzero(place[anchor[lo : lo + 256]] >= 0) + lo
            s = scores[place[anchor[some]]]
            fits = (s >= low[some][:, None]) & (s <= high[some][:, None]) & (ids[None, :] != a.ids[anchor[some]][:, None])
            at, to = np.nonzero(fits)
            found.append((some[at], ids[to], s[at, to]))
            held += len(at)
        if held > 200_000:
            found = [tuple(best())]
            held = len(found[0][0])
    if a is not None:
        yield from made()


def _windows(batches: Iterator[pa.RecordBatch], stage: str, k: int, share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Windows of the next stage from what was found: rows (anchors, ids, windows, found: window, rank, vec_id, score)."""
    for row in rows_of(batches):
        old = np.frombuffer(row["windows"], np.int64).reshape(-1, 5)
        got = np.array([[r["window"], r["rank"], r["vec_id"], r["score"]] for r in row["found"] or []], np.int64).reshape(-1, 4)
        if stage == "negatives":  # a window for each positive
            got = got[np.lexsort((got[:, 1], got[:, 0]))]
            p = got[:, 3]
            new = np.stack([old[got[:, 0], 0], got[:, 2], p, -(-share[0] * p // 100), share[1] * p // 100], axis=1) if len(got) else np.empty((0, 5), np.int64)
            new = new[new[:, 3] <= new[:, 4]]
        else:  # the k-th found so far is the least that can still count
            new = old.copy()
            last = got[got[:, 1] == k]
            new[last[:, 0], 3] = np.maximum(new[last[:, 0], 3], last[:, 3])
        yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([new.tobytes()], pa.binary())], ["block", "windows"])


def _start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One open window for each anchor."""
    for row in rows_of(batches):
        n = len(row["ids"]) // 8
        open_ = np.stack([np.arange(n), np.zeros(n), np.zeros(n), np.full(n, _NONE), np.full(n, -_NONE)], axis=1).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([open_.tobytes()], pa.binary())], ["block", "windows"])


def candidate_blocks(vectors: DataFrame, label: Column, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """The candidates in curve order as written blocks with zone maps: block, width, label, ids, x, low, high."""
    rows = integers(vectors, scale, id_col, vec_col, label.cast("long").alias("label")).where("label IS NOT NULL")
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "width", "x")).alias("r")).select("vec_id", "r.*")
    rows = cut(one, "candidates")
    shapes = {}
    for r in _moments(rows).collect():  # a row for each length and dimension
        middle, spread = shapes.setdefault(r["width"], (np.zeros(r["width"]), np.ones(r["width"])))
        middle[r["i"]], spread[r["i"]] = r["middle"], r["spread"]
    keyed = rows.mapInArrow(partial(_keyed, shapes=shapes | {0: (np.zeros(0), np.ones(0))}), "vec_id long, label long, width int, x binary, key binary")
    spark = vectors.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, rows.count() // (ROWS * GROUP * 4))
    order = ("width", "label", "key", "vec_id")
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return cut(ranged.mapInArrow(partial(_blocks, rows=ROWS), _BLOCK).withColumn("block", F.monotonically_increasing_id()), "blocks")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        widths = np.asarray(batch.column("width"))
        for width in np.unique(widths[widths > 0]):
            x = read_ints(batch.column("x").take(pa.array(np.flatnonzero(widths == width))), int(width))
            total[int(width)] = total.get(int(width), 0) + np.stack([np.full(width, len(x)), x.sum(axis=0), (x**2).sum(axis=0)], axis=1)
    for width, t in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([width] * width, pa.int32()), pa.array(range(width), pa.int32()), *map(pa.array, t.T)], ["width", "i", "n", "s", "s2"])


def _moments(rows: DataFrame) -> DataFrame:
    """(width, i, middle, spread) of each dimension: where the curve's cells are cut. They shape blocks, not results."""
    sums = rows.mapInArrow(_sums, "width int, i int, n double, s double, s2 double").groupBy("width", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2"))
    middle = F.col("s") / F.col("n")
    return sums.select("width", "i", middle.alias("middle"), F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - middle * middle)).alias("spread"))


def mine(vectors: DataFrame, label: Column | str = "label", every: int = 50, positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95), scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Hard negatives of each anchor (a row whose id is divisible by `every`) for each of its positives.

    (anchor_id, positive_id, rank, negative_id, positive_score, negative_score). A component x is floor(scale * x), a score the inner
    product of such integers with the anchor's; higher scores come first, ties by the smaller vec_id. Positives are the
    anchor's first rows of its label, itself left out; negatives are the first rows of other labels with share[0] * positive_score <=
    100 * negative_score <= share[1] * positive_score. All there are, if fewer; a positive without negatives has no row.

    Rows with a null id or label, a null vector, or a null or non-finite component take no part; components beyond 2**31 after
    scaling raise; vectors of different lengths don't meet. Of several rows with one id the one with the smallest label, then the shorter
    vector, then the smaller components takes part. An empty table gives an empty table; other columns, whatever their names, are not read.
    """
    blocks = candidate_blocks(vectors, F.col(label) if isinstance(label, str) else label, scale, id_col, vec_col)
    parallel = vectors.sparkSession.sparkContext.defaultParallelism
    anchors = cut(blocks.mapInArrow(partial(_anchor_blocks, every=every), "width int, ids binary, labels binary, x binary").withColumn("block", F.monotonically_increasing_id()), "anchors")
    zones = cut(blocks.select("block", "width", "label", "low", "high").mapInArrow(_zone_packs, "width int, blocks binary, labels binary, low binary, high binary").withColumn("block", F.monotonically_increasing_id()), "zones")
    r, c = grid(anchors.count(), zones.count(), parallel)
    none = lambda *names: [F.lit(None).cast("binary").alias(n) for n in names]

    def found(windows: DataFrame, positive: bool, first: bool, k: int) -> DataFrame:
        """The k best rows of each window: (anchors, window, rank, vec_id, score)."""
        asked = anchors.join(windows, "block")
        z = dealt(zones, "col", c, "row", r).select("row", "col", F.lit(0).alias("kind"), "width", "block", *none("ids"), "labels", *none("x", "windows"), "blocks", "low", "high")
        q = dealt(asked, "row", r, "col", c).select("row", "col", F.lit(1).alias("kind"), "width", "block", "ids", "labels", "x", "windows", *none("blocks", "low", "high"))
        met = z.unionByName(q).repartition(r * c, "width", "row", "col").sortWithinPartitions("width", "row", "col", "kind", "block")
        plan = met.mapInArrow(partial(_planned, positive=positive, first=first), "anchors long, block long, needed binary")
        plan = cut(plan.withColumn("group", F.floor(F.col("block") / GROUP)), "plan")
        need = plan.join(blocks.select("block", "width", "ids", "x"), "block").select("anchors", "group", F.lit(1).alias("kind"), "block", "width", "ids", *none("labels"), "x", *none("windows"), "needed")
        who = plan.select("anchors", "group").distinct().join(asked.withColumnRenamed("block", "anchors"), "anchors")
        who = who.select("anchors", "group", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"), "width", "ids", "labels", "x", "windows", *none("needed"))
        met = who.unionByName(need).repartition("anchors", "group").sortWithinPartitions("anchors", "group", "kind", "block")
        got = met.mapInArrow(partial(_scored, k=k), "anchors long, window long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("anchors", "window").orderBy(F.desc("score"), "vec_id"))
        return got.withColumn("rank", rank).where(F.col("rank") <= k)

    def following(windows: DataFrame, got: DataFrame, stage: str, k: int) -> DataFrame:
        each = got.groupBy(F.col("anchors").alias("block")).agg(F.collect_list(F.struct("window", "rank", "vec_id", "score")).alias("found"))  # of ANCHORS anchors
        rows = windows.join(each, "block", "left")
        return cut(rows.mapInArrow(partial(_windows, stage=stage, k=k, share=share), "block long, windows binary"), "windows")

    open_ = cut(anchors.mapInArrow(_start, "block long, windows binary"), "windows")
    near = following(open_, found(open_, True, True, positives), "bar", positives)
    sought = following(near, found(near, True, False, positives), "negatives", positives)
    bars = following(sought, found(sought, False, True, negatives), "bar", negatives)
    got = found(bars, False, False, negatives)
    named = anchors.join(sought, "block").mapInArrow(_named, "anchors long, window long, anchor_id long, positive_id long, positive_score long")
    return got.join(named, ["anchors", "window"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in rows_of(batches):
        a = _Anchors(row)
        at, positive, score, _, _ = a.windows
        yield pa.RecordBatch.from_arrays([pa.array([a.block] * len(at), pa.int64()), pa.array(np.arange(len(at))), *map(pa.array, (a.ids[at], positive, score))], ["anchors", "window", "anchor_id", "positive_id", "positive_score"])


def sql(label: str = "label", every: int = 50, positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95), scale: int = 256) -> str:
    """The same in DuckDB's SQL, over the view embeddings."""
    score = "CAST(coalesce(list_sum(list_transform(list_zip(a.x, r.x), lambda p: p[1] * p[2])), 0) AS BIGINT)"
    return f"""
    WITH e AS (SELECT vec_id, {label} AS label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
      WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    v AS (SELECT * FROM e WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, len(x), x) = 1),
    s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, {score} AS score FROM v a JOIN v r ON a.vec_id <> r.vec_id AND len(a.x) = len(r.x) WHERE a.vec_id % {every} = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {positives}),
    n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND {share[0]} * positive_score <= 100 * score AND 100 * score <= {share[1]} * positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {negatives}"""

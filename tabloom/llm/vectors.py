"""Vectors as exact integers in packed blocks, and the grid on which blocks of queries meet blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components must lie within this bound after scaling; sums of products are then exact in a long.
LARGEST = 2**31 - 1
#: Rows of a block, and blocks of either kind in a cell of the grid, at most (on average).
BLOCK, GROUP = 1024, 16


def usable(column: pa.Array, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, floor(scale * x) as doubles) for each length of vector; a null vector or one that holds a null
    or non-finite component is in none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[lengths >= 0]):
        at = np.flatnonzero(lengths == n)
        flat = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        x = flat.reshape(len(at), n)
        good = np.isfinite(x).all(axis=1)
        x = np.floor(scale * x[good])
        if x.size and np.abs(x).max() > LARGEST:
            raise ValueError(f"a component times {scale} is beyond {LARGEST}")
        yield int(n), at[good], x


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as bytes, in the smallest type that holds them all."""
    most = np.abs(x).max() if x.size else 0
    return x.astype(np.int8 if most < 2**7 else np.int16 if most < 2**15 else np.int32).tobytes()


def unpacked(data: bytes, rows: int, width: int) -> np.ndarray:
    """What packed was given, as doubles."""
    each = len(data) // (rows * width) if rows * width else 1
    return np.frombuffer(data, f"i{each}").reshape(rows, width).astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, exact: in doubles where they hold all sums, else in longs."""
    most = (np.abs(a).max() if a.size else 0) * (np.abs(b).max() if b.size else 0) * max(1, a.shape[1])
    if most < 2**53:
        return a @ b.T
    return exact(a) @ exact(b).T


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of equal rows of a and b, exact, as longs."""
    return np.einsum("ij,ij->i", exact(a), exact(b))


def exact(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64)


def integer_rows(batches: Iterator[pa.RecordBatch], scale: int, keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Columns (keep, v) -> (keep, width, x): usable vectors one by one, as bytes that are equal and in order as they are."""
    for batch in batches:
        for width, at, x in usable(batch.column("v"), scale):
            rows = batch.select(list(keep)).take(pa.array(at))
            x = [r.tobytes() for r in (x + 2**31).astype(">u4")]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([width] * len(at), pa.int32()), pa.array(x, pa.binary())], [*keep, "width", "x"])


def integers(vectors: DataFrame, scale: int, id_col: str, vec_col: str, *others: Column) -> DataFrame:
    """(vec_id, others, width, x) of the rows with an id and a usable vector."""
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), *others, F.col(vec_col).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    keep = tuple(named.columns[:-1])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields[:-1])
    return named.mapInArrow(partial(integer_rows, scale=scale, keep=keep), f"{schema}, width int, x binary")


def read_ints(column: pa.Array, width: int) -> np.ndarray:
    """Bytes of integer_rows as a matrix of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(len(column), width).astype(np.float64) - 2**31


def blocks_of(batches: Iterator[pa.RecordBatch], lists: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(vec_id, width, x) -> (width, ids, parts): blocks of up to `rows` vectors of one length, components in `lists` parts."""
    held: dict[int, list] = {}

    def made(width: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        parts = [packed(p) for p in np.array_split(x, lists, axis=1)]
        return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([parts], pa.list_(pa.binary()))], ["width", "ids", "parts"])

    for batch in batches:
        widths, ids = np.asarray(batch.column("width")), np.asarray(batch.column("vec_id"))
        for width in np.unique(widths):
            at = np.flatnonzero(widths == width)
            own = held.setdefault(int(width), [np.empty(0, np.int64), np.empty((0, width))])
            own[0], own[1] = np.concatenate([own[0], ids[at]]), np.concatenate([own[1], read_ints(batch.column("x").take(pa.array(at)), int(width))])
            while len(own[0]) >= rows:
                yield made(int(width), own[0][:rows], own[1][:rows])
                own[0], own[1] = own[0][rows:], own[1][rows:]
    for width, (ids, x) in held.items():
        if len(ids):
            yield made(width, ids, x)


def grid(queries: int, rows: int, parallel: int, group: int = GROUP) -> tuple[int, int]:
    """Rows and columns of a grid whose cells hold about `group` blocks of either kind; smaller cells where there are few."""
    while group > 1 and -(-queries // group) * -(-rows // group) < 2 * parallel:
        group //= 2
    return max(1, -(-queries // group)), max(1, -(-rows // group))


def dealt(df: DataFrame, own: str, size: int, other: str, others: int) -> DataFrame:
    """Blocks placed in the grid: each in one place of dimension `own` by its number, and in every place of `other`."""
    return df.withColumn(own, F.pmod(F.xxhash64("block"), F.lit(size)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of packed blocks, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}


def first_k(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each q's k highest scores with different ids, in order: ties to the smaller id, an id once with its best."""
    order = np.lexsort((ids, -score, q))
    place = np.lexsort((np.arange(len(order)), ids[order], q[order]))  # the first of each (q, id) in that order
    q2, i2 = q[order][place], ids[order][place]
    again = np.zeros(len(order), bool)
    again[place[1:]] = (q2[1:] == q2[:-1]) & (i2[1:] == i2[:-1])
    order = order[~again]
    start = np.searchsorted(q[order], q[order])
    return order[np.arange(len(order)) - start < k]

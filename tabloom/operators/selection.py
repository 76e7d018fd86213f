"""Exact order statistics of many columns at once, by counting in ever finer ranges.

A double becomes a 64-bit number of the same order. Each wanted rank of a column has a range of these numbers that holds it, at
first from the column's least to its largest. A round is one job: each task counts its values in BINS equal parts of every range, the counts are added up,
and the part that holds the rank becomes the range. A range of few values, FEW at most, is read out, and a range of one
number is its value, however often it occurs. So no task and no buffer holds more than BINS counts or FEW values for a rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Parts of a range in a round; values of a range that are read out.
BINS, FEW = 1024, 2048
_TOP = 1 << 63


def ordered(x: np.ndarray) -> np.ndarray:
    """Numbers in the order of x: -inf first, NaN after inf, both zeros alike."""
    x = np.where(np.isnan(x), np.nan, x + 0.0)  # one NaN, one zero
    bits = x.view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(_TOP))


def value_of(number: int) -> float:
    bits = number ^ _TOP if number & _TOP else ~number & (2 * _TOP - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


@dataclass
class _Range:
    """The numbers from low to high of a column, of which the one at rank (from 0) is wanted; count: how many there are;
    parts: in so many a round cuts it."""

    column: int
    low: int
    high: int
    rank: int
    count: int
    parts: int

    @property
    def step(self) -> int:
        return -(-(self.high - self.low + 1) // self.parts)

    @property
    def done(self) -> bool:
        return self.low == self.high or self.count <= FEW

    def narrowed(self, counts: np.ndarray) -> _Range:
        upto = np.cumsum(counts)
        part = int(np.searchsorted(upto, self.rank, side="right"))
        low = self.low + part * self.step
        return _Range(self.column, low, min(low + self.step - 1, self.high), self.rank - int(upto[part] - counts[part]), int(counts[part]), self.parts)


def _numbers(batch: pa.RecordBatch, column: int) -> np.ndarray:
    values = batch.column(column).drop_null()
    return ordered(np.asarray(values.cast(pa.float64())))


def _counted(batches: Iterator[pa.RecordBatch], ranges: list[_Range]) -> Iterator[pa.RecordBatch]:
    """(slot, n): counts by part, range after range; only those with values."""
    parts = ranges[0].parts
    total = np.zeros(len(ranges) * parts, np.int64)
    for batch in batches:
        numbers: dict[int, np.ndarray] = {}
        for i, r in enumerate(ranges):
            if r.column not in numbers:
                numbers[r.column] = _numbers(batch, r.column)
            x = numbers[r.column]
            x = x[(x >= np.uint64(r.low)) & (x <= np.uint64(r.high))] - np.uint64(r.low)
            total[i * parts : (i + 1) * parts] += np.bincount((x // np.uint64(r.step)).astype(np.int64), minlength=parts)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["slot", "n"])


def _read_out(batches: Iterator[pa.RecordBatch], ranges: list[_Range]) -> Iterator[pa.RecordBatch]:
    """(slot, value) of all values in the ranges."""
    for batch in batches:
        for i, r in enumerate(ranges):
            x = _numbers(batch, r.column)
            x = np.array([value_of(int(v)) for v in x[(x >= np.uint64(r.low)) & (x <= np.uint64(r.high))]], np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i, np.int32)), pa.array(x)], ["slot", "value"])


def at_ranks(df: DataFrame, wanted: Sequence[tuple[str, int]]) -> list[float | None]:
    """The value at each wanted (column, rank from 0) among the column's non-null values in order; None beyond the last."""
    columns = list(dict.fromkeys(c for c, _ in wanted))
    values, ends = _values(df, columns)
    return _at_ranks(values, [(columns.index(c), rank) for c, rank in wanted], ends)


def _values(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, Row]:
    """The columns as doubles c0, c1, ..., and their counts and ends."""
    values = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    return values, values.agg(*[f(f"c{i}").alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("n", F.count), ("low", F.min), ("high", F.max))]).first()


def _at_ranks(values: DataFrame, wanted: Sequence[tuple[int, int]], ends: Row) -> list[float | None]:
    number = lambda v: int(ordered(np.array([v], np.float64))[0])
    there = [(i, rank) for i, rank in wanted if rank < ends[f"n{i}"]]
    ranges = [_Range(i, number(ends[f"low{i}"]), number(ends[f"high{i}"]), rank, ends[f"n{i}"], BINS) for i, rank in there]
    while open_ := [r for r in ranges if not r.done]:
        distinct = list({(r.column, r.low, r.high): r for r in open_}.values())
        found = values.mapInArrow(partial(_counted, ranges=distinct), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # BINS for each range
        tally = np.zeros((len(distinct), BINS), np.int64)
        for r in found:
            tally[r["slot"] // BINS, r["slot"] % BINS] = r["n"]
        place = {(r.column, r.low, r.high): i for i, r in enumerate(distinct)}
        ranges = [r if r.done else r.narrowed(tally[place[(r.column, r.low, r.high)]]) for r in ranges]
    short = list({(r.column, r.low, r.high): r for r in ranges if r.low < r.high}.values())
    lists: dict[int, list[float]] = {}
    if short:
        for r in values.mapInArrow(partial(_read_out, ranges=short), "slot int, value double").collect():  # FEW for each range
            lists.setdefault(r["slot"], []).append(r["value"])
    sorted_ = {(r.column, r.low, r.high): sorted(lists[i], key=lambda v: (math.isnan(v), v)) for i, r in enumerate(short)}
    found = [value_of(r.low) if r.low == r.high else sorted_[(r.column, r.low, r.high)][r.rank] for r in ranges]
    by_rank = dict(zip(there, found, strict=True))
    return [by_rank.get(w) for w in wanted]


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """The exact median of each column's non-null values, the mean of the middle two if there is no middle one; None without values.

    As with the built-in median, NaN counts as larger than all numbers."""
    values, ends = _values(df, columns)
    middle = [((ends[f"n{i}"] - 1) // 2, ends[f"n{i}"] // 2) for i in range(len(columns))]
    found = _at_ranks(values, [(i, max(rank, 0)) for i, ranks in enumerate(middle) for rank in ranks], ends)
    return {c: a if a is None or a == b else 0.5 * a + 0.5 * b for c, a, b in zip(columns, found[::2], found[1::2], strict=True)}

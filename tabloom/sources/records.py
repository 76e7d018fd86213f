"""Records of CSV text whose quoted fields may hold line ends, from files that stay splittable.

A line alone doesn't tell whether it starts a record: that depends on whether a quoted field is open before it. So each file split is
read once under both assumptions, field open or not at its first line; a split then is a map from one to the other. The maps
are composed along each file, one row for a split, which settles the assumption of every split and the number of records
before it. Lines that are records of their own stay where they are; only those of longer records are gathered.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.sources.shared import kept

#: Characters of a record that spans lines, at most; more mean an unclosed quote and raise.
MOST_CHARS = 131_072


def open_after(line: str, inside: bool, sep: str = ",") -> bool:
    """Whether a quoted field is open at the end of a line, given whether one was before it.

    A quote opens a field as its first sign only; within one, two quotes are a sign of the text; what follows a closing quote up
    to the next separator is text."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == '"':
                at += 2
                continue
            inside = False
        elif line[at : at + 1] == '"':
            inside = True
            at += 1
            continue
        at = line.find(sep, at)
        if at < 0:
            return False
        at += 1


_LINES = "file string, start long, at long, line string, before array<boolean>, after array<boolean>, n array<long>"


def _read(batches: Iterator[pa.RecordBatch], sep: str) -> Iterator[pa.RecordBatch]:
    """Lines in file order. Under either assumption about the split's start (not open, open): whether a field is open before and
    after the line, and how many records of data have started up to it. The header and blank lines between records aren't counted."""
    key, open_, n, header, at = None, [False, True], [0, 0], [False, False], 0
    for batch in batches:
        out = []
        for file, start, line in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "value")), strict=True):
            if (file, start) != key:
                key, open_, n, header, at = (file, start), [False, True], [0, 0], [start == 0] * 2, 0
            if start == 0 and at == 0:
                line = line.removeprefix("﻿")
            before, blank = list(open_), not line.removesuffix("\r")
            quoted = '"' in line
            for i in (0, 1):
                if not open_[i] and not blank:
                    if header[i]:
                        header[i] = False
                    else:
                        n[i] += 1
                if quoted:
                    open_[i] = open_after(line, open_[i], sep)
            out.append((file, start, at, line, before, list(open_), list(n)))
            at += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], [c.split()[0] for c in _LINES.split(", ")])


_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.list_(pa.int64())]


def _composed(parts: pd.DataFrame) -> pd.DataFrame:
    """The splits of a file in order: which assumption holds for each, and how many records it starts."""
    state, rows = False, []
    for r in parts.sort_values("start").itertuples():
        rows.append((r.file, r.start, int(state), int(r.n[int(state)])))
        state = bool(r.after[int(state)])
    return pd.DataFrame(rows, columns=["file", "start", "held", "records"])


def read_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(number, record): the records of all files under path but for headers and blank lines, numbered from 0 in the order of files.

    A record keeps the line ends that its quoted fields hold; a UTF-8 mark is dropped. A record that spans lines and has
    over MOST_CHARS characters raises, as does a missing path."""
    text = spark.read.text(path, lineSep="\n")
    placed = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    lines = kept(placed.mapInArrow(partial(_read, sep=sep), _LINES), "lines")
    ends = lines.groupBy("file", "start").agg(F.max_by(F.struct("after", "n"), "at").alias("last")).select("file", "start", "last.after", "last.n")
    parts = ends.groupBy("file").applyInPandas(_composed, "file string, start long, held int, records long")
    upto = F.coalesce(F.sum("records").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each split
    starts = kept(parts.withColumn("shift", upto), "splits")
    held = F.col("held") + 1
    each = lines.join(starts, ["file", "start"]).select(
        "file", "start", "at", "line", F.element_at("before", held).alias("open"), F.element_at("after", held).alias("stays"), (F.element_at("n", held) + F.col("shift") - 1).alias("number"), (F.element_at("n", held) == 0).alias("none"),
    )
    # the header: no record of data has started in the file's first split
    last = lambda c: F.regexp_replace(c, "\r$", "")
    each = each.where(~((F.col("start") == 0) & F.col("none")) & (F.col("open") | (last("line") != "")))
    single = each.where(~F.col("open") & ~F.col("stays")).select("number", last("line").alias("record"))
    longer = each.where(F.col("open") | F.col("stays")).withColumn("chars", F.length("line") + 1)
    size = longer.groupBy("number").agg(F.sum("chars").alias("chars"))
    if size.where(F.col("chars") > MOST_CHARS).limit(1).count():
        raise ValueError(f"a record that spans lines has over {MOST_CHARS} characters: an unclosed quote")
    gathered = longer.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("start", "at", "line"))).alias("l"))  # MOST_CHARS at most
    joined = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return single.unionByName(gathered.select("number", last(joined).alias("record")))


def _fields(batches: Iterator[pa.RecordBatch], columns: int, sep: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(r + [""] * columns)[:columns] for x in batch.column("record").to_pylist() for r in csv.reader([x], delimiter=sep)]
        fields = zip(*rows, strict=True) if rows else [()] * columns
        yield pa.RecordBatch.from_arrays([batch.column("number"), *[pa.array([v or None for v in f], pa.string()) for f in fields]], ["number", *[f"c{i}" for i in range(columns)]])


def parsed(records: DataFrame, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """(number, columns as text): the fields of each record; missing and empty ones are null, those beyond are dropped."""
    schema = ", ".join(["number long", *[f"c{i} string" for i in range(len(columns))]])
    return records.select("number", "record").mapInArrow(partial(_fields, columns=len(columns), sep=sep), schema).toDF("number", *columns)

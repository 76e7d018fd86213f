"""Sources and sinks: dirty and typed splits, schema contracts, partitioned outputs, reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.sources import records
from tabloom.sources.shared import kept, scratch  # noqa: F401

def _numbered(rows: DataFrame, parts: Sequence[str], name: str) -> DataFrame:
    """rows with name: 0, 1, ... in the order of parts and of __at, which is consecutive within a part.

    Only the parts are added up in one window, of which there are as many as file splits or partitions.
    """
    each = rows.groupBy(*parts).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = each.select(*parts, (before - F.col("__first")).alias("__shift"))
    return rows.join(starts, list(parts)).withColumn(name, F.col("__at") + F.col("__shift")).drop("__at", "__shift", *parts)


def in_order(ids: DataFrame, column: str, name: str) -> DataFrame:
    """ids (one column) sorted by range over the partitions, with name: the place in order, from 0."""
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ids.repartitionByRange(parts, column).sortWithinPartitions(column)
    rows = kept(ranged.withColumns({"__at": F.monotonically_increasing_id(), "__part": F.spark_partition_id()}), "ordered")
    return _numbered(rows, ["__part"], name)


def read_text_split(spark: SparkSession, path: str, split: str, columns: Sequence[str], row_column: str | None = None) -> DataFrame:
    """A CSV split as text columns with split and source_row; a missing file raises. Quoted fields may hold line ends.

    A UTF-8 mark is dropped. source_row is row_column if given; else the record's number, counted from 2 below the header.
    """
    rows = records.parsed(records.read_records(spark, path), columns)
    number = F.col(row_column).cast("long") if row_column else F.col("number") + 2
    return rows.select(*columns, number.alias("source_row"), F.lit(split).alias("split"))


def append_splits(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def typed_features(df: DataFrame, target: str, keep: Sequence[str] = ()) -> DataFrame:
    """All columns but target and keep as double: a bad value raises; a missing target raises at once."""
    if target not in df.columns:
        raise ValueError(f"no target column {target}")
    return df.select(*[F.col(c) if c in keep else F.col(c).cast("string") if c == target else F.col(c).cast("double") for c in df.columns])


def same_features(parts: dict[str, DataFrame], target: str) -> list[str]:
    """The features that all parts share, in their common order; any difference raises."""
    names = {k: [c for c in df.columns if c != target] for k, df in parts.items()}
    first, *rest = names
    for k in rest:
        if names[k] != names[first]:
            raise ValueError(f"{k} has other features than {first}, or in another order")
    return names[first]


def with_split(parts: dict[str, DataFrame], target: str) -> DataFrame:
    """One table of all parts with a column split, after same_features."""
    same_features(parts, target)
    return append_splits([df.withColumn("split", F.lit(k)) for k, df in parts.items()])


def write_splits(df: DataFrame, path: str, columns: Sequence[str], form: str = "parquet") -> None:
    """columns in this order, a folder for each split; helper columns (leading _) are left out."""
    kept = [c for c in columns if not c.startswith("_")]
    writer = df.select(*kept, "split").write.partitionBy("split")
    (writer.option("header", True).csv if form == "csv" else writer.parquet)(path)


def write_rows(df: DataFrame, path: str, form: str = "json") -> None:
    """A report; without rows it raises."""
    if df.isEmpty():
        raise ValueError("no rows to write")
    df.write.json(path) if form == "json" else df.write.option("header", True).csv(path)


def collect_reports(reports: dict[str, DataFrame], column: str) -> DataFrame:
    """One row for each report: model and what `column` (a path of fields) holds."""
    return append_splits([df.select(F.lit(m).alias("model"), F.col(column).alias("report")).select("model", "report.*") for m, df in reports.items()])


def best_or_default(best: DataFrame | None, column: str, default: int, spark: SparkSession) -> DataFrame:
    """One row: the tuned value, or default where there is no report or it is empty."""
    one = spark.range(1).select(F.lit(default).alias("d"))
    if best is None:
        return one.select(F.col("d").alias(column))
    found = best.agg(F.max(column).alias("b"))
    return one.crossJoin(F.broadcast(found)).select(F.coalesce("b", "d").cast("int").alias(column))

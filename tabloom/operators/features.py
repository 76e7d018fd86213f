"""Derived features, standardisation, correlation and greedy selection."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalars import safe_divide
from tabloom.operators.sampling import MOST_CLASSES
from tabloom.spec import LOG_COLUMNS


def derived_columns() -> dict[str, Column]:
    """Name -> expression over the shape measurements, in order."""
    c = F.col
    total, gap = c("MajorAxisLength") + c("MinorAxisLength"), c("MajorAxisLength") - c("MinorAxisLength")
    hollow = c("ConvexArea") - c("Area")
    ellipse = F.lit(math.pi) * c("MajorAxisLength") * c("MinorAxisLength") / 4.0
    ratio = safe_divide
    return {
        "AspectRatio": c("AspectRation"),
        "AxisLengthSum": total,
        "AxisLengthDiff": gap,
        "AxisLengthMean": total / 2.0,
        "AxisDiffRatio": ratio(gap, total),
        "MinorMajorRatio": ratio(c("MinorAxisLength"), c("MajorAxisLength")),
        "AreaPerPerimeter": ratio(c("Area"), c("Perimeter")),
        "AreaPerPerimeterSquared": ratio(c("Area"), c("Perimeter") * c("Perimeter")),
        "PerimeterPerArea": ratio(c("Perimeter"), c("Area")),
        "AreaConvexRatio": ratio(c("Area"), c("ConvexArea")),
        "ConvexAreaGap": hollow,
        "ConvexAreaGapRatio": ratio(hollow, c("ConvexArea")),
        "AreaEllipseRatio": ratio(c("Area"), ellipse),
        "EquivDiameterMajorRatio": ratio(c("EquivDiameter"), c("MajorAxisLength")),
        "EquivDiameterMinorRatio": ratio(c("EquivDiameter"), c("MinorAxisLength")),
        "RoundnessSolidity": c("roundness") * c("Solidity"),
        "CompactnessSolidity": c("Compactness") * c("Solidity"),
        "ExtentSolidity": c("Extent") * c("Solidity"),
        "EccentricityAspectRatio": c("Eccentricity") * c("AspectRation"),
    }


def engineer(df: DataFrame) -> DataFrame:
    return df.withColumns(derived_columns())


def log_features(df: DataFrame, columns: Sequence[str] = LOG_COLUMNS) -> DataFrame:
    return df.withColumns({f"log_{c}": F.log1p(c) for c in columns})


def feature_names(df: DataFrame, other: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in other]


def standard_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean_<c> and std_<c> (of the population; 0 becomes 1) over split train."""
    std = lambda c: F.stddev_pop(c)
    aggs = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", std))]
    out = df.where("split = 'train'").agg(*aggs)
    return out.withColumns({f"std_{c}": F.when(F.col(f"std_{c}") == 0, 1.0).otherwise(F.col(f"std_{c}")) for c in columns})


def standardize(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(value - mean) / std with the training stats (one row), for all splits."""
    z = {c: (F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}") for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(z).select(df.columns)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for each pair of columns in order, a before b; r is null where either doesn't vary on the rows that have both.

    A pair is measured on the rows where neither is null (or NaN), whatever the other columns hold.
    """
    r = correlation_matrix(df, columns)
    found = [(a, b, float(r[i, j]) if np.isfinite(r[i, j]) else None) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
    return df.sparkSession.createDataFrame(found, "a string, b string, r double")


#: Share of a sum of squares under which a variance is taken for rounding.
_ROUNDING = 1e-13


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a partition: for each pair (i, j), over the rows that have both, how many, the sums of i and of i squared,
    and the sum of products. Such rows add up."""
    total = None
    for batch in batches:
        x = np.column_stack([np.asarray(batch.column(i).cast(pa.float64())) for i in range(batch.num_columns)])
        there = ~np.isnan(x)
        x, there = np.where(there, x, 0.0), there.astype(np.float64)
        own = np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
        total = own if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["g"])


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """p * p pairwise coefficients; nan where a column doesn't vary on the pair's rows, or the pair has no two rows.

    Values are centred by their column's mean first, so that sums keep their digits; moments of partitions are added up by Spark.
    """
    clean = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns]
    means = df.select(*clean).agg(*[F.avg(c).alias(f"__m_{c}") for c in columns])
    centred = df.select(*clean).crossJoin(F.broadcast(means)).select(*[(F.col(c) - F.col(f"__m_{c}")).alias(c) for c in columns])
    p = len(columns)
    parts = centred.mapInArrow(_moments, "g array<double>")
    summed = parts.select(F.posexplode("g").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()  # 4 * p * p numbers
    if not summed:
        return np.full((p, p), np.nan)
    n, s, q, both = np.array([row["x"] for row in summed]).reshape(4, p, p)
    spread = n * q - s * s  # of column i on the rows that it shares with j
    spread = np.where(spread > _ROUNDING * n * q, spread, 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        r = (n * both - s * s.T) / (np.sqrt(spread) * np.sqrt(spread.T))
        return np.where((spread > 0) & (spread.T > 0), np.clip(r, -1.0, 1.0), np.nan)


def greedy_selection(columns: Sequence[str], r: dict[tuple[str, str], float | None], threshold: float = 0.95) -> tuple[list[str], list[tuple[str, str, float]]]:
    """(kept, dropped): a column goes if the first kept column that qualifies has |r| >= threshold with it."""
    kept: list[str] = []
    dropped = []
    for c in columns:
        partner = next(((k, abs(v)) for k in kept if (v := r.get((k, c))) is not None and abs(v) >= threshold), None)
        if partner:
            dropped.append((c, *partner))
        else:
            kept.append(c)
    return kept, dropped


def select_uncorrelated(df: DataFrame, columns: Sequence[str], threshold: float = 0.95) -> tuple[list[str], DataFrame]:
    """(kept, audit of dropped, kept, abs_correlation); the matrix of pairs alone comes to the driver."""
    found = {(row["a"], row["b"]): row["r"] for row in correlations(df, columns).collect()}
    kept, dropped = greedy_selection(columns, found, threshold)
    return kept, df.sparkSession.createDataFrame(dropped, "dropped string, kept string, abs_correlation double")


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """(label, code): the labels of all splits in order, from 0."""
    distinct = df.select(F.col(label).alias("label")).where(F.col(label).isNotNull()).distinct()
    if distinct.limit(MOST_CLASSES + 1).count() > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} labels")
    one = distinct.agg(F.sort_array(F.collect_list("label")).alias("l"))  # as many as there are classes
    return one.select(F.posexplode("l").alias("code", "label")).select("label", "code")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): rows / (classes * rows of the class), over split train; labels without training rows are absent."""
    counts = df.where("split = 'train'").groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"))
    return counts.crossJoin(F.broadcast(total)).select("label", (F.col("rows") / (F.col("classes") * F.col("n"))).alias("weight"))

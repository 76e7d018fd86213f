"""Experiment tables: drops against a baseline, sweep gaps, rankings, reshaping, latencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.scalars import safe_divide


def robustness_drop(results: DataFrame) -> DataFrame:
    """results (noise_type, noise_intensity, model, test_accuracy), 'clean' being the baseline, with drops against it."""
    base = results.where("noise_type = 'clean'").groupBy("model").agg(F.max("test_accuracy").alias("baseline_accuracy"))
    drop = F.col("baseline_accuracy") - F.col("test_accuracy")
    out = results.join(base, "model").withColumn("accuracy_drop", drop)
    return out.withColumn("relative_drop_percent", 100 * safe_divide(F.col("accuracy_drop"), F.col("baseline_accuracy")))


def sweep_gaps(accuracies: DataFrame, by: Sequence[str]) -> DataFrame:
    """accuracies (by, split, accuracy) -> by with train_, val_, test_accuracy and the gaps between them."""
    wide = accuracies.groupBy(*by).pivot("split", ["train", "val", "test"]).agg(F.max("accuracy"))
    named = wide.select(*by, *[F.col(s).alias(f"{s}_accuracy") for s in ("train", "val", "test")])
    gap = lambda s: (F.col("train_accuracy") - F.col(f"{s}_accuracy")).alias(f"train_{s}_gap")
    return named.select("*", gap("val"), gap("test"))


def best_rows(sweep: DataFrame) -> DataFrame:
    """For each experiment the best row by (val, test) and the one of the largest train-test gap; ties to the smaller value."""
    best = F.max(F.struct("val_accuracy", "test_accuracy", (-F.col("parameter_value")).alias("p"))).alias("b")
    gap = F.max(F.struct("train_test_gap", (-F.col("parameter_value")).alias("p"))).alias("g")
    out = sweep.groupBy("experiment").agg(best, gap)
    return out.select("experiment", (-F.col("b.p")).alias("best_parameter"), F.col("b.val_accuracy").alias("best_val_accuracy"), (-F.col("g.p")).alias("gap_parameter"), F.col("g.train_test_gap").alias("largest_gap"))


def unpivot_metrics(table: DataFrame, ids: Sequence[str], names: dict[str, str]) -> DataFrame:
    """(ids, metric, score): a row for each metric under its new name."""
    long = table.unpivot(list(ids), list(names), "metric", "score")
    return long.replace(names, subset=["metric"])


def best_model(table: DataFrame) -> DataFrame:
    """The row of the best accuracy, ties to the first name."""
    return table.orderBy(F.desc("accuracy"), "model").limit(1)


def best_epoch(history: DataFrame) -> DataFrame:
    """The first epoch of the best validation accuracy, for each model."""
    best = F.max(F.struct("val_accuracy", (-F.col("epoch")).alias("e"))).alias("b")
    return history.groupBy("model").agg(best).select("model", (-F.col("b.e")).alias("epoch"), F.col("b.val_accuracy").alias("val_accuracy"))


def latency_summary(timings: DataFrame, samples: int) -> DataFrame:
    """timings (model, seconds) -> statistics of each model; p95 is the element at sorted position max(0, int(0.95 n) - 1).

    The element is found by counting up distinct values, so no window holds a model's rows.
    """
    stats = timings.groupBy("model").agg(F.count("*").alias("repeats"), F.avg("seconds").alias("mean"), F.median("seconds").alias("median"), F.min("seconds").alias("min"), F.max("seconds").alias("max"))
    values = timings.groupBy("model", "seconds").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("model").orderBy("seconds"))
    place = F.greatest(F.lit(0), F.floor(F.lit(0.95) * F.col("repeats")).cast("int") - 1)
    at = values.withColumn("upto", upto).join(stats.select("model", "repeats"), "model").where(F.col("upto") > place)
    p95 = at.groupBy("model").agg(F.min("seconds").alias("p95"))
    return stats.join(p95, "model").select("*", (1000 * F.col("mean") / samples).alias("ms_per_sample"), safe_divide(F.lit(float(samples)), F.col("mean")).alias("samples_per_second"))


def split_pivot(metrics: DataFrame, values: Sequence[str]) -> DataFrame:
    """metrics (model, split, values) -> a row for each model, columns <split>_<value>."""
    wide = metrics.groupBy("model").pivot("split", ["val", "test"]).agg(*[F.max(v).alias(v) for v in values])
    return wide

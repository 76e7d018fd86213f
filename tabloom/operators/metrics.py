"""Metrics from a confusion table, for any number of models and splits at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalars import safe_divide


#: Labels of a confusion table; it has their square of cells for each group.
MOST_LABELS = 1000


def accuracy(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return predictions.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("true_class") == F.col("predicted_class")).cast("double")).alias("accuracy"))


def confusion(predictions: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, true_class, predicted_class, n) for each pair of labels (label), 0 where none; one count over the rows."""
    seen = predictions.groupBy(*by, "true_class", "predicted_class").agg(F.count("*").alias("n"))
    if labels.limit(MOST_LABELS + 1).count() > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    pairs = labels.select(F.col("label").alias("true_class")).crossJoin(F.broadcast(labels.select(F.col("label").alias("predicted_class"))))
    if by:
        pairs = seen.select(*by).distinct().crossJoin(F.broadcast(pairs))
    return pairs.join(seen, [*by, "true_class", "predicted_class"], "left").select(*by, "true_class", "predicted_class", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_wide(table: DataFrame, labels: Sequence[str]) -> DataFrame:
    """A row for each true class, a column for each predicted one."""
    return table.groupBy("true_class").pivot("predicted_class", list(labels)).agg(F.sum("n")).na.fill(0)


def confusion_shares(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """share: of its true class."""
    total = table.groupBy(*by, "true_class").agg(F.sum("n").alias("__t"))
    return table.join(total, [*by, "true_class"]).select(*by, "true_class", "predicted_class", safe_divide(F.col("n").cast("double"), F.col("__t")).alias("share"))


def per_class(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, class, precision, recall, f1, support) from a confusion table; 0/0 is 0."""
    ends = F.explode(F.array(F.struct(F.col("true_class").alias("class"), F.lit(1).alias("is_true")), F.struct(F.col("predicted_class").alias("class"), F.lit(0).alias("is_true"))))
    long = table.select(*by, "n", (F.col("true_class") == F.col("predicted_class")).alias("hit"), ends.alias("e")).select(*by, "n", "hit", "e.*")
    sums = long.groupBy(*by, "class").agg(
        F.sum(F.when(F.col("hit") & (F.col("is_true") == 1), F.col("n")).otherwise(0)).cast("double").alias("tp"),
        F.sum(F.when(F.col("is_true") == 1, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("is_true") == 0, F.col("n")).otherwise(0)).alias("predicted"),
    )
    out = sums.withColumns({"precision": safe_divide(F.col("tp"), F.col("predicted")), "recall": safe_divide(F.col("tp"), F.col("support"))})
    f1 = safe_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.select(*by, "class", "precision", "recall", f1.alias("f1"), "support")


def averages(classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """macro_ (over all labels, absent ones too) and weighted_ (by support) means of precision, recall and f1."""
    macro = [F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")]
    weighted = [safe_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")]
    return classes.groupBy(*by).agg(*macro, *weighted)


def model_table(predictions: DataFrame, labels: DataFrame, by: Sequence[str]) -> DataFrame:
    """accuracy and averages for each model and split, from one count over the predictions."""
    table = confusion(predictions, labels, by)
    hits = F.sum(F.when(F.col("true_class") == F.col("predicted_class"), F.col("n")).otherwise(0)).cast("double")
    acc = table.groupBy(*by).agg(safe_divide(hits, F.sum("n")).alias("accuracy"))
    return acc.join(averages(per_class(table, by), by), list(by))


def with_correct(df: DataFrame) -> DataFrame:
    return df.withColumn("is_correct", (F.col("true_class") == F.col("predicted_class")).cast("int"))

"""Exact stratified samples, bootstrap, feature subsets and noise, all from hash-based random numbers."""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.scalars import normal, uniform
from tabloom.sources.tables import in_order

#: Labels that a column may have.
MOST_CLASSES = 100_000
NOISES = ("clean", "gaussian", "uniform", "dropout", "label_flip")


def quotas(df: DataFrame, label: str, limit: int) -> DataFrame:
    """(label, n, quota): about limit * n / rows and at least 1, in label order; the last label takes what is left.

    More than MOST_CLASSES labels raise: such a column is no label."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    if counts.limit(MOST_CLASSES + 1).count() > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} labels")
    one = counts.agg(F.sort_array(F.collect_list(F.struct("label", "n"))).alias("l"), F.sum("n").alias("rows"), F.count("*").alias("classes"))  # as many as there are classes
    each = one.select("rows", "classes", F.posexplode("l").alias("i", "x")).select("rows", "classes", "i", "x.label", "x.n")
    share = F.least(F.col("n"), F.greatest(F.lit(1), F.bround(F.lit(float(limit)) * F.col("n") / F.col("rows"), 0).cast("long")))
    before = F.coalesce(F.sum("share").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.greatest(F.lit(0), F.least(F.col("n"), F.lit(limit) - F.col("before")))
    part = F.when(F.col("i") == F.col("classes") - 1, rest).otherwise(F.greatest(F.lit(0), F.least(F.col("share"), F.lit(limit) - F.col("before"))))
    return each.withColumn("share", share).withColumn("before", before).select("label", "n", part.alias("quota"))


def stratified_limit(df: DataFrame, label: str, id_col: str, limit: int, seed: int) -> DataFrame:
    """Exactly limit rows (all if limit <= 0 or there are no more) with nearly the label shares of df.

    A row's place in its label depends on its id and the seed. Ranks are counted among the rows whose random number is
    near the quota's cut, not in whole labels; what is missing is filled from the rows left.
    """
    if limit <= 0:
        return df
    ranked = df.withColumns({"__u": uniform(F.col(id_col), "strata", seed), "__f": uniform(F.col(id_col), "fill", seed)})
    q = quotas(df, label, limit)
    part = ranked.join(F.broadcast(q), ranked[label] == q["label"]).drop(q["label"])
    first = F.row_number().over(Window.partitionBy(label).orderBy("__u", id_col))
    # with n rows left the quota-th smallest of n uniform numbers lies under this bound but for a chance of about 1e-9
    bound = (F.col("quota") + 6 * F.sqrt(F.col("quota") + 1) + 20) / F.col("n")
    near = part.where(F.col("__u") <= bound).withColumn("__r", first).where(F.col("__r") <= F.col("quota"))
    missing = limit - near.count()
    if missing <= 0:
        return near.select(df.columns)
    fill = ranked.join(near.select(id_col), id_col, "left_anti").orderBy("__f", id_col).limit(missing)
    return near.select(df.columns).unionByName(fill.select(df.columns))


def bootstrap(df: DataFrame, id_col: str, trees: int, ratio: float, seed: int) -> DataFrame:
    """(tree, id, weight): max(1, int(n * ratio)) draws with replacement for each tree, counted by row.

    Each draw picks a position from its own random number; positions are matched with rows in id order.
    """
    n = df.count()
    draws = max(1, int(n * ratio))
    placed = in_order(df.select(F.col(id_col).cast("long").alias("id")), "id", "position")
    slots = df.sparkSession.range(trees * draws).select((F.col("id") / draws).cast("int").alias("tree"), (F.col("id") % draws).alias("draw"))
    picked = slots.withColumn("position", F.floor(uniform(F.col("draw"), F.col("tree"), seed) * n).cast("long"))
    weights = picked.groupBy("tree", "position").agg(F.count("*").alias("weight"))
    return weights.join(placed, "position").select("tree", "id", "weight")


def subset_size(p: int, rule: str | int) -> int:
    """Features that a node may look at: sqrt, log2 or a number, from 1 to p."""
    size = int(math.sqrt(p)) if rule == "sqrt" else int(math.log2(p)) if rule == "log2" else int(rule)
    return min(p, max(1, size))


def feature_subset(nodes: DataFrame, features: DataFrame, size: int, seed: int) -> DataFrame:
    """(tree, node, feature): the size features with the smallest random numbers of their node."""
    u = uniform(F.concat_ws("/", F.col("tree").cast("string"), F.col("node").cast("string")), F.col("feature"), seed)
    rank = F.row_number().over(Window.partitionBy("tree", "node").orderBy("u", "feature"))
    return nodes.crossJoin(F.broadcast(features)).withColumn("u", u).withColumn("__r", rank).where(F.col("__r") <= size).select("tree", "node", "feature")


def noisy(c: str, kind: str, intensity: float | Column, id_col: str, seed: int | Column) -> Column:
    """Column c under one kind of noise; label_flip and clean leave it."""
    if kind not in NOISES:
        raise ValueError(f"unknown noise {kind}")
    i = intensity if isinstance(intensity, Column) else F.lit(float(intensity))
    u = uniform(F.col(id_col), f"{kind}.{c}", seed)
    if kind == "gaussian":
        return F.col(c) + i * normal(F.col(id_col), f"gaussian.{c}", seed)
    if kind == "uniform":
        return F.col(c) + (2 * u - 1) * i
    if kind == "dropout":
        return F.when(u < i, F.lit(0.0)).otherwise(F.col(c))
    return F.col(c)


def flipped(label: str, labels: Sequence[str], intensity: float | Column, id_col: str, seed: int | Column) -> Column:
    """With chance intensity another of labels, each as likely; a single label stays."""
    i = intensity if isinstance(intensity, Column) else F.lit(float(intensity))
    others = F.array_except(F.array(*map(F.lit, sorted(labels))), F.array(label))
    pick = F.floor(uniform(F.col(id_col), "flip.to", seed) * F.size(others)).cast("int") + 1
    return F.when((uniform(F.col(id_col), "flip", seed) < i) & (F.size(others) > 0), F.try_element_at(others, pick)).otherwise(F.col(label))


def with_noise(df: DataFrame, kind: str, intensity: float, features: Sequence[str], label: str, labels: Sequence[str], id_col: str, seed: int) -> DataFrame:
    if intensity < 0:
        raise ValueError("intensity must not be negative")
    if kind not in NOISES:
        raise ValueError(f"unknown noise {kind}")
    if kind == "label_flip":
        return df.withColumn(label, flipped(label, labels, intensity, id_col, seed))
    return df.withColumns({c: noisy(c, kind, intensity, id_col, seed) for c in features})


def scenario_seed(kind: str, intensity: float, seed: int) -> int:
    """A seed of its own for each kind and intensity."""
    return zlib.crc32(f"{seed}/{kind}/{float(intensity)!r}".encode()) >> 1


def scenarios(df: DataFrame, grid: Sequence[tuple[str, float]], features: Sequence[str], label: str, labels: Sequence[str], id_col: str, random_state: int) -> DataFrame:
    """df once for each (kind, intensity), with both as columns: one plan in which the scenario is a key."""
    for kind, intensity in grid:
        if kind not in NOISES or intensity < 0:
            raise ValueError(f"unknown noise {kind} {intensity}")
    table = df.sparkSession.createDataFrame([(k, float(i), scenario_seed(k, i, random_state)) for k, i in grid], "noise_type string, intensity double, __seed int")
    many = df.crossJoin(F.broadcast(table))

    def chosen(c: str) -> Column:
        out = F.col(c)
        for kind in sorted({k for k, _ in grid} - {"clean", "label_flip"}):
            out = F.when(F.col("noise_type") == kind, noisy(c, kind, F.col("intensity"), id_col, F.col("__seed"))).otherwise(out)
        return out

    other = F.when(F.col("noise_type") == "label_flip", flipped(label, labels, F.col("intensity"), id_col, F.col("__seed"))).otherwise(F.col(label))
    return many.withColumns({c: chosen(c) for c in features} | {label: other}).drop("__seed")

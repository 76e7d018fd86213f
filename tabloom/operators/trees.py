"""Entropy trees and forests, grown for all trees at once.

Rows are (id long, code int, features array<double>); code is the label's number. A node has a heap number: its children
are 2i + 1 and 2i + 2. The node table (tree, node, depth, prediction, feature, threshold) is the model.

Growth has two phases. Large nodes are split level by level (module growth): rows carry their node number in written blocks, and
one pass over the rows of open nodes moves them to their children and counts what the next splits need. A node of at most
growth.LOCAL_VALUES values leaves that loop: its rows meet in one task, which grows the whole subtree. So a small table takes one job
for all trees and depths, and a large one a pass for each level until its nodes are small.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabloom.operators import growth
from tabloom.operators.sampling import feature_subset, subset_size
from tabloom.sources.tables import kept

LEAST_GAIN = 1e-7


def entropy(counts: Sequence[Column]) -> Column:
    """Entropy in bits of class counts; of none 0."""
    total = sum(counts, F.lit(0.0))
    share = lambda c: F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(0.0)
    return sum((share(c) for c in counts), F.lit(0.0))


def entropy_by_group(df: DataFrame, group: Sequence[str], label: str) -> DataFrame:
    counts = df.groupBy(*group, label).agg(F.count("*").cast("double").alias("c"))
    totals = counts.groupBy(*group).agg(F.sum("c").alias("t"))
    joined = counts.join(totals, list(group))
    return joined.groupBy(*group).agg(F.sum(-(F.col("c") / F.col("t")) * F.log2(F.col("c") / F.col("t"))).alias("entropy"))


def majority(df: DataFrame, group: Sequence[str], label: str) -> DataFrame:
    """(group, label, n): the most frequent label, the smallest of equals."""
    counts = df.groupBy(*group, label).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), label))
    return counts.withColumn("__r", rank).where("__r = 1").drop("__r")


def best_splits(rows: DataFrame, classes: int, least_leaf: int, allowed: DataFrame | None = None, binned: bool = False) -> DataFrame:
    """rows (tree, node, weight, code, features) -> for each node the split of most information.

    Thresholds are midpoints between neighbouring distinct values, but for those where the largest label on the left
    equals the smallest on the right. Equal gains: first feature, then lowest threshold. Counts by distinct value come
    first, so windows run over values, not rows; allowed (tree, node, feature) limits the features of a node. binned: a
    value is the upper edge of a bin; thresholds are edges, between any bins that don't both hold one label alone. left: the
    weights by class of what goes left.
    """
    key = ["tree", "node"]
    long = rows.select(*key, "weight", "code", F.posexplode("features").alias("feature", "value"))
    if allowed is not None:
        long = long.join(allowed, [*key, "feature"])
    each = [F.sum(F.when(F.col("code") == k, F.col("weight")).otherwise(0)).cast("double").alias(f"c{k}") for k in range(classes)]
    values = long.groupBy(*key, "feature", "value").agg(*each, F.min("code").alias("low"), F.max("code").alias("high"))
    w = Window.partitionBy(*key, "feature").orderBy("value")
    upto, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*key, "feature")
    left = {f"l{k}": F.sum(f"c{k}").over(upto) for k in range(classes)}
    total = {f"t{k}": F.sum(f"c{k}").over(whole) for k in range(classes)}
    at = values.withColumns(left | total | {"next": F.lead("value").over(w), "next_low": F.lead("low").over(w), "next_high": F.lead("high").over(w)})
    same = (F.col("high") == F.col("next_low")) & ((F.col("low") == F.col("next_high")) if binned else F.lit(True))
    at = at.where(F.col("next").isNotNull() & ~same)
    ls, ts = [F.col(f"l{k}") for k in range(classes)], [F.col(f"t{k}") for k in range(classes)]
    rs = [t - x for t, x in zip(ts, ls, strict=True)]
    n, nl, nr = sum(ts, F.lit(0.0)), sum(ls, F.lit(0.0)), sum(rs, F.lit(0.0))
    gain = F.round(entropy(ts) - nl / n * entropy(ls) - nr / n * entropy(rs), 12)
    scored = at.where((nl >= least_leaf) & (nr >= least_leaf)).select(*key, "feature", (F.col("value") if binned else (F.col("value") + F.col("next")) / 2).alias("threshold"), gain.alias("gain"), F.array(*ls).alias("left"))
    best = F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("threshold")).alias("t"), "left")).alias("b")
    return scored.groupBy(*key).agg(best).select(*key, (-F.col("b.f")).alias("feature"), (-F.col("b.t")).alias("threshold"), F.col("b.gain").alias("gain"), F.col("b.left").alias("left"))


@dataclass
class TreeModel:
    """nodes: one row for each node of each tree; feature is -1 at leaves."""

    nodes: pd.DataFrame
    labels: list[str]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes, "tree int, node long, depth int, prediction int, feature int, threshold double")

    def save(self, spark: SparkSession, path: str) -> None:
        names = spark.createDataFrame(list(enumerate(self.labels)), "code int, label string")
        self.table(spark).write.parquet(f"{path}/nodes")
        names.write.parquet(f"{path}/labels")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeModel:
        labels = [r["label"] for r in spark.read.parquet(f"{path}/labels").orderBy("code").collect()]
        return cls(spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toPandas(), labels)

    def cut_at(self, depth: int) -> TreeModel:
        """The same trees, no deeper than depth."""
        kept = self.nodes[self.nodes["depth"] <= depth].copy()
        kept.loc[kept["depth"] == depth, "feature"] = -1
        return TreeModel(kept, self.labels)

    def _flat(self) -> tuple[np.ndarray, ...]:
        """Arrays over all nodes: feature, threshold, prediction, left child, right child; and the roots of trees."""
        t = self.nodes.sort_values(["tree", "node"]).reset_index(drop=True)
        place = {(a, b): i for i, (a, b) in enumerate(zip(t["tree"], t["node"], strict=True))}
        child = lambda s: np.array([place.get((a, 2 * b + s), i) for i, (a, b) in enumerate(zip(t["tree"], t["node"], strict=True))])
        roots = np.array([place[(a, 0)] for a in sorted(t["tree"].unique())])
        small = lambda v: np.asarray(v, np.int32)  # noqa: E731  the model is sent to every task
        return small(t["feature"]), t["threshold"].fillna(0).to_numpy(), small(t["prediction"]), small(child(1)), small(child(2)), small(roots)

    def descend(self, features: Column, output: str = "prediction") -> Column:
        """For each tree the prediction (or heap number of the node) that features reach: array<long>."""
        feature, threshold, prediction, left, right, roots = self._flat()
        heap = self.nodes.sort_values(["tree", "node"])["node"].to_numpy()
        depth = int(self.nodes["depth"].max()) if len(self.nodes) else 0

        @F.pandas_udf(T.ArrayType(T.LongType()))
        def go(column: pd.Series) -> pd.Series:
            x = np.array(column.tolist(), np.float64).reshape(len(column), -1)
            at = np.tile(roots, (len(x), 1))
            for _ in range(depth):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                value = np.take_along_axis(x, np.maximum(f, 0), 1)
                at = np.where(inner, np.where(value <= threshold[at], left[at], right[at]), at)
            return pd.Series(list((prediction if output == "prediction" else heap)[at]))

        return go(features)

    def predict(self, rows: DataFrame) -> DataFrame:
        """(id, true_class, predicted_class) for each row, in one pass: each tree has one vote; ties to the smallest label.

        Rows stay rows, also where ids repeat; without features a row has no prediction."""
        vote = partial(_voted, flat=self._flat(), depth=int(self.nodes["depth"].max()), labels=self.labels)
        return rows.select("id", "code", "features").mapInArrow(vote, "id long, true_class string, predicted_class string")

    def summary(self, spark: SparkSession) -> DataFrame:
        """(tree, nodes, leaves, depth)."""
        t = self.table(spark)
        return t.groupBy("tree").agg(F.count("*").alias("nodes"), F.sum((F.col("feature") < 0).cast("long")).alias("leaves"), F.max("depth").alias("depth"))


def forest_vote(votes: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, label): the most frequent vote, the smallest of equals."""
    return majority(votes, by, "label").drop("n")


def forest_summary(trees: DataFrame) -> DataFrame:
    """One row over the trees' summaries."""
    return trees.agg(F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"), F.avg("depth").alias("mean_depth"), F.avg("nodes").alias("mean_nodes"), F.avg("leaves").alias("mean_leaves"))


def _voted(batches: Iterator[pa.RecordBatch], flat: tuple[np.ndarray, ...], depth: int, labels: list[str]) -> Iterator[pa.RecordBatch]:
    feature, threshold, prediction, left, right, roots = flat
    names = pa.array(labels, pa.string())
    for batch in batches:
        column = batch.column("features")
        there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        won = np.full(batch.num_rows, -1)
        if len(there):
            x = np.asarray(column.flatten().cast(pa.float64())).reshape(len(there), -1)
            at = np.tile(roots, (len(x), 1))
            each = np.arange(len(x))[:, None]
            for _ in range(depth):
                f = feature[at]
                if (f < 0).all():
                    break
                down = np.where(x[each, np.maximum(f, 0)] <= threshold[at], left[at], right[at])
                at = np.where(f >= 0, down, at)
            votes = np.bincount((each * len(labels) + prediction[at]).ravel(), minlength=len(x) * len(labels))
            won[there] = votes.reshape(len(x), -1).argmax(axis=1)
        taken = names.take(pa.array(won, pa.int64(), mask=won < 0))
        yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), names.take(batch.column("code").cast(pa.int64())), taken], ["id", "true_class", "predicted_class"])


def grow(rows: DataFrame, labels: Sequence[str], max_depth: int, least_leaf: int = 1, least_split: int = 2, least_gain: float = LEAST_GAIN, weights: DataFrame | None = None, features_per_node: str | int | None = None, seed: int = 0, bins: int | None = None) -> TreeModel:
    """Grow one tree, or with weights (tree, id, weight) one for each tree in them. The driver holds the node table alone.

    bins: features are replaced by so many quantiles first, and large nodes are split by histograms, which bounds what a level
    sends; without bins every distinct value counts, at any number of rows. A table without rows raises.
    """
    if max_depth > 30:
        raise ValueError("max_depth must be 30 at most")
    rows = rows.select("id", "code", "features")
    if (first := rows.first()) is None:
        raise ValueError("no training rows")
    p = len(first["features"])
    edges = None
    if bins:
        found = rows.select(*[F.percentile_approx(F.col("features")[j], [i / bins for i in range(1, bins)], 10_000).alias(f"q{j}") for j in range(p)]).first()
        edges = [np.array([*sorted(set(q)), max(q) + 1.0]) for q in found]
    rule = growth.Rule(len(labels), p, max_depth, least_leaf, least_split, least_gain, None if features_per_node is None else subset_size(p, features_per_node), seed, edges)
    blocks = growth.blocks_of(rows, weights, rule)
    nodes, pieces = {}, []
    open_ = {k: c for k, c in growth.root_counts(blocks, rule).items()}
    if not open_:
        raise ValueError("no training rows")
    level, hists = growth.Level(), None
    for depth in range(max_depth + 1):
        todo = {}
        for k, c in open_.items():
            nodes[k] = [depth, int(c.argmax()), -1, None]
            if (c > 0).sum() > 1 and depth < max_depth and c.sum() >= least_split:
                todo[k] = c
        large = {k: c for k, c in todo.items() if c.sum() * p > growth.LOCAL_VALUES}
        if not todo:
            break
        level.aim(large, set(todo) - set(large), open_, edges is not None)
        made = growth.passed(blocks, level, rule)
        pieces.append(made.where("kind = 2"))
        if not large:
            break
        blocks = made.where("kind = 0")
        if edges is not None:
            hists = growth.summed(made.where("kind = 1"), hists, level, rule)
            splits = growth.best_of(hists)
        else:
            allowed = None
            if rule.subset is not None:
                spark = rows.sparkSession
                names = spark.range(p).select(F.col("id").cast("int").alias("feature"))
                allowed = feature_subset(spark.createDataFrame(sorted(large), "tree int, node long"), names, rule.subset, seed)
            splits = best_splits(growth.unpacked(blocks, rule), len(labels), least_leaf, allowed)
        parents, open_ = open_, {}
        level = growth.Level()
        for r in splits.where(F.col("gain") >= least_gain).collect():
            k = (r["tree"], r["node"])
            left = np.array(r["left"])
            nodes[k][2], nodes[k][3] = r["feature"], r["threshold"]
            level.split(k, r["feature"], r["threshold"])
            open_[(k[0], 2 * k[1] + 1)], open_[(k[0], 2 * k[1] + 2)] = left, parents[k] - left
        if not open_:
            break
    for r in growth.subtrees(pieces, rule).collect() if pieces else ():
        nodes[(r["tree"], r["node"])] = [r["depth"], r["prediction"], r["feature"], r["threshold"]]
    return _model(nodes, labels)


def _model(nodes: dict, labels: Sequence[str]) -> TreeModel:
    frame = pd.DataFrame([(t, n, *v) for (t, n), v in sorted(nodes.items())], columns=["tree", "node", "depth", "prediction", "feature", "threshold"])
    frame["threshold"] = frame["threshold"].astype(float)
    return TreeModel(frame, list(labels))

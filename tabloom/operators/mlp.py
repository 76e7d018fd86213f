"""A net with one hidden layer: scoring as column expressions or in batches, training by summed partial gradients.

Rows are (id long, code int, features array<double>). Training is synchronous: a step is one job that sums the gradients of
its rows, which are all rows or a mini-batch. Several nets, each with rows of its own, are trained by the same jobs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.scalars import argmax, softmax, uniform
from tabloom.sources.tables import scratch

FLOOR = 1e-15


@dataclass(frozen=True)
class Net:
    """w1: hidden x features, b1: hidden, w2: classes x hidden, b2: classes."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @classmethod
    def he(cls, features: int, hidden: int, classes: int, seed: int) -> Net:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, np.sqrt(2 / features), (hidden, features)), np.zeros(hidden), rng.normal(0, np.sqrt(2 / hidden), (classes, hidden)), np.zeros(classes))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(n, list(getattr(self, n).shape), [float(v) for v in getattr(self, n).ravel()]) for n in ("w1", "b1", "w2", "b2")]
        spark.createDataFrame(rows, "part string, shape array<int>, values array<double>").write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Net:
        return cls(**{r["part"]: np.array(r["values"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()})

    def forward(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1.T + self.b1, 0) @ self.w2.T + self.b2
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def forward_columns(net: Net, features: Column) -> Column:
    """Class shares as a column expression; for small nets, and anywhere SQL alone is wanted."""
    lit = lambda m: F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in m])
    vec = lambda v: F.array(*[F.lit(float(x)) for x in v])
    dot = lambda w, x, b: F.aggregate(F.zip_with(w, x, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v) + b
    hidden = F.transform(F.arrays_zip(lit(net.w1).alias("w"), vec(net.b1).alias("b")), lambda r: F.greatest(dot(r["w"], features, r["b"]), F.lit(0.0)))
    out = F.transform(F.array(hidden), lambda h: F.transform(F.arrays_zip(lit(net.w2).alias("w"), vec(net.b2).alias("b")), lambda r: dot(r["w"], h, r["b"])))[0]
    return F.transform(F.array(out), softmax)[0]


def forward_batches(net: Net, features: Column) -> Column:
    """The same, one product of matrices for each Arrow batch."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def go(column: pd.Series) -> pd.Series:
        return pd.Series(list(net.forward(np.array(column.tolist(), np.float64).reshape(len(column), -1))))

    return go(features)


def predict(net: Net, rows: DataFrame) -> DataFrame:
    """rows with p (class shares) and predicted (the largest share, the first of equals)."""
    return rows.withColumn("p", forward_batches(net, F.col("features"))).withColumn("predicted", argmax(F.col("p")))


def cross_entropy(p: Column, code: Column) -> Column:
    return F.avg(-F.log(F.greatest(F.element_at(p, code + 1), F.lit(FLOOR))))


def _gradient_of(net: Net, x: np.ndarray, y: np.ndarray, weight: np.ndarray, keep: np.ndarray | None) -> tuple[np.ndarray, float, float]:
    """Flat gradient of the weighted sum of losses over the rows, that sum, and the sum of weights."""
    h = np.maximum(x @ net.w1.T + net.b1, 0)
    if keep is not None:
        h = h * keep
    z = h @ net.w2.T + net.b2
    e = np.exp(z - z.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    hit = p[np.arange(len(y)), y]
    d = p * weight[:, None]
    d[np.arange(len(y)), y] -= weight
    back = (d @ net.w2) * (h > 0) * (1 if keep is None else keep)
    parts = back.T @ x, back.sum(0), d.T @ h, d.sum(0)
    return np.concatenate([g.ravel() for g in parts]), float(-(weight * np.log(np.maximum(hit, FLOOR))).sum()), float(weight.sum())


def _partial(batches: Iterator[pa.RecordBatch], nets: dict[int, Net], weights: np.ndarray, dropout: float, seed: int) -> Iterator[pa.RecordBatch]:
    """(number, g): of each net the summed gradient over its rows of the partition, the loss and the weight."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        numbers, ids, y = (np.asarray(batch.column(c)) for c in ("number", "id", "code"))
        x = np.asarray(batch.column("features").flatten().cast(pa.float64())).reshape(batch.num_rows, -1)
        for number in np.unique(numbers):
            own, net = numbers == number, nets[int(number)]
            keep = None
            if dropout > 0:  # a mask that depends on the row's id, not on where the row is
                cell = (ids[own][:, None].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) ^ (np.arange(len(net.b1), dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F))
                cell = (cell ^ (cell >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
                keep = ((cell >> np.uint64(11)) / 2**53 >= dropout) / (1 - dropout)
            code = y[own].astype(int)
            g, loss, n = _gradient_of(net, x[own], code, weights[code], keep)
            total[int(number)] = total.get(int(number), 0) + np.concatenate([g, [loss, n]])
    for number, g in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([g], pa.list_(pa.float64()))], ["number", "g"])


def gradients(rows: DataFrame, nets: dict[int, Net], weights: np.ndarray, l2: float = 0.0, dropout: float = 0.0, seed: int = 0, by: str | None = None) -> dict[int, tuple[Net, float, float]]:
    """Of each net (gradient, mean weighted loss, sum of weights) over its rows, all in one job; by: the int column that names a
    row's net (None: all rows are of net 0). l2 on weights, not on biases. Nets without rows are absent.

    Each partition sends one vector for each net; the driver gets the sums."""
    if not 0 <= dropout < 1:
        raise ValueError("dropout must be in [0, 1)")
    number = F.col(by).cast("int") if by else F.lit(0)
    parts = rows.select(number.alias("number"), "id", "code", "features").mapInArrow(partial(_partial, nets=nets, weights=weights, dropout=dropout, seed=seed), "number int, g array<double>")
    summed = parts.select("number", F.posexplode("g").alias("i", "v")).groupBy("number", "i").agg(F.sum("v").alias("v"))
    flat: dict[int, list[tuple[int, float]]] = {}
    for r in summed.collect():
        flat.setdefault(r["number"], []).append((r["i"], r["v"]))
    out = {}
    for k, values in flat.items():
        g, net = np.array([v for _, v in sorted(values)]), nets[k]
        n = max(g[-1], 1e-300)
        shapes = net.w1.shape, net.b1.shape, net.w2.shape, net.b2.shape
        cuts = np.split(g[:-2] / n, np.cumsum([int(np.prod(s)) for s in shapes])[:-1])
        d = Net(*[c.reshape(s) for c, s in zip(cuts, shapes, strict=True)])
        out[k] = replace(d, w1=d.w1 + l2 * net.w1, w2=d.w2 + l2 * net.w2), float(g[-2] / n), float(g[-1])
    return out


def gradient(rows: DataFrame, net: Net, weights: np.ndarray, l2: float = 0.0, dropout: float = 0.0, seed: int = 0) -> tuple[Net, float]:
    """(gradient as a Net, mean weighted loss) over all rows."""
    found = gradients(rows, {0: net}, weights, l2, dropout, seed)
    if not found:
        raise ValueError("no training rows")
    return found[0][:2]


def stepped(net: Net, g: Net, rate: float) -> Net:
    return Net(net.w1 - rate * g.w1, net.b1 - rate * g.b1, net.w2 - rate * g.w2, net.b2 - rate * g.b2)


def measure(net: Net, rows: DataFrame) -> tuple[float, float]:
    """(cross-entropy, accuracy)."""
    r = predict(net, rows).agg(cross_entropy(F.col("p"), F.col("code")).alias("loss"), F.avg((F.col("predicted") == F.col("code")).cast("double")).alias("acc")).first()
    return r["loss"], r["acc"]


def _hits(batches: Iterator[pa.RecordBatch], nets: dict[int, Net]) -> Iterator[pa.RecordBatch]:
    hits = {k: np.zeros(2, np.int64) for k in nets}
    for batch in batches:
        y = np.asarray(batch.column("code"))
        x = np.asarray(batch.column("features").flatten().cast(pa.float64())).reshape(batch.num_rows, -1)
        for k, net in nets.items():
            hits[k] += (int((net.forward(x).argmax(axis=1) == y).sum()), len(y))
    yield pa.RecordBatch.from_arrays([pa.array(hits, pa.int32()), *[pa.array([int(h[i]) for h in hits.values()], pa.int64()) for i in (0, 1)]], ["number", "hits", "n"])


def accuracies(nets: dict[int, Net], rows: DataFrame) -> DataFrame:
    """(number, accuracy) of all nets on the same rows, in one pass over them."""
    found = rows.select("code", "features").mapInArrow(partial(_hits, nets=nets), "number int, hits long, n long")
    return found.groupBy("number").agg((F.sum("hits") / F.sum("n")).alias("accuracy"))


def descend(fit: DataFrame, net: Net, steps: int, rate: float, l2: float = 0.0, dropout: float = 0.0, weights: np.ndarray | None = None, seed: int = 0) -> Net:
    """net after so many steps of synchronous descent, without measuring in between."""
    return descend_many(fit, {0: net}, steps, rate, l2, dropout, weights, seed)[0]


def descend_many(fit: DataFrame, nets: dict[int, Net], steps: int, rate: float, l2: float = 0.0, dropout: float = 0.0, weights: np.ndarray | None = None, seed: int = 0, by: str | None = None) -> dict[int, Net]:
    """All nets after so many steps, each on its own rows of fit (column by); a step of all nets is one job."""
    weights = np.ones(len(next(iter(nets.values())).b2)) if weights is None else weights
    for s in range(steps):
        found = gradients(fit, nets, weights, l2, dropout, seed + s, by)
        nets = {k: stepped(net, found[k][0], rate) if k in found else net for k, net in nets.items()}
    return nets


def batch_of(epoch: int, batches: int, seed: int) -> Column:
    """The mini-batch of a row in an epoch, from 0: by its id, dealt anew each epoch."""
    return F.least(F.floor(uniform(F.col("id"), f"batch.{epoch}", seed) * batches), F.lit(batches - 1)).cast("int")


def deal(fit: DataFrame, epoch: int, batches: int, seed: int) -> DataFrame:
    """fit written with a folder for each mini-batch of the epoch, so that a step reads its own rows alone."""
    path = scratch(fit.sparkSession, f"epoch-{epoch}")
    fit.select("id", "code", "features", batch_of(epoch, batches, seed).alias("batch")).write.partitionBy("batch").parquet(path)
    return fit.sparkSession.read.schema("id long, code int, features array<double>, batch int").parquet(path)


def train(fit: DataFrame, val: DataFrame, hidden: int, classes: int, epochs: int, rate: float = 0.5, patience: int | None = 15, steps: int = 4, l2: float = 1e-4, dropout: float = 0.0, weights: np.ndarray | None = None, seed: int = 0, test: DataFrame | None = None, batches: int | None = None) -> tuple[Net, list[dict]]:
    """(best net by validation accuracy, history). Synchronous descent: a step is one job. Without batches an epoch has `steps`
    steps over all rows of fit; with batches it deals fit anew and takes a step for each mini-batch that has rows.

    Stops after `patience` epochs without a better validation accuracy (None: never); the rate falls by 0.85 every ten
    epochs. train_update_loss is the loss of the last step, or with batches the weighted mean over the epoch's steps.
    """
    p = len(fit.select("features").first()[0])
    net = best = Net.he(p, hidden, classes, seed)
    weights = np.ones(classes) if weights is None else weights
    top, stale, history = -1.0, 0, []
    for epoch in range(1, epochs + 1):
        dealt = deal(fit, epoch, batches, seed) if batches else None
        losses, sizes = [], []
        for s in range(batches or steps):
            rows = dealt.where(F.col("batch") == s) if batches else fit
            if found := gradients(rows, {0: net}, weights, l2, dropout, seed + epoch * 1000 + s):
                g, loss, n = found[0]
                net = stepped(net, g, rate)
                losses.append(loss)
                sizes.append(n)
        if not losses:
            raise ValueError("no training rows")
        update = float(np.average(losses, weights=sizes)) if batches else losses[-1]
        (tl, ta), (vl, va) = measure(net, fit), measure(net, val)
        row = {"epoch": epoch, "train_update_loss": update, "train_loss": tl, "val_loss": vl, "train_accuracy": ta, "val_accuracy": va, "learning_rate": rate}
        if test is not None:
            row["test_accuracy"] = measure(net, test)[1]
        history.append(row)
        if va > top:
            top, best, stale = va, net, 0
        else:
            stale += 1
        if patience is not None and stale >= patience:
            break
        if epoch % 10 == 0:
            rate *= 0.85
    return best, history

"""Mini-batches and nets that are trained together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import mlp


def table(spark, n=90, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 3))
    return spark.createDataFrame([(i, int(r[0] + r[1] > 0) + int(r[2] > 1), r.tolist()) for i, r in enumerate(x)], "id long, code int, features array<double>").repartition(3)


def test_an_epoch_deals_every_row_once_and_anew(spark):
    df = table(spark)
    first, second = ({r["id"]: r["batch"] for r in mlp.deal(df, e, 4, 7).collect()} for e in (1, 2))
    assert set(first) == set(second) == set(range(90)) and set(first.values()) == {0, 1, 2, 3} and first != second
    assert first == {r["id"]: r["batch"] for r in mlp.deal(df.repartition(5), 1, 4, 7).collect()}


def test_a_step_reads_its_batch_alone(spark):
    dealt = mlp.deal(table(spark), 1, 4, 7).where(F.col("batch") == 2)
    plan = dealt._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan and "batch" not in plan.split("PushedFilters: [")[1].split("]")[0]


def test_mini_batches_are_steps_on_their_rows(spark):
    df = table(spark)
    got, history = mlp.train(df, df, 4, 3, 2, rate=0.3, patience=None, l2=0.01, seed=3, batches=3, dropout=0.2)
    net, losses = mlp.Net.he(3, 4, 3, 3), []
    for epoch in (1, 2):
        parts = df.withColumn("b", mlp.batch_of(epoch, 3, 3))
        losses = []
        for b in range(3):
            g, loss = mlp.gradient(parts.where(F.col("b") == b), net, np.ones(3), 0.01, 0.2, 3 + epoch * 1000 + b)
            net = mlp.stepped(net, g, 0.3)
            losses.append((loss, parts.where(F.col("b") == b).count()))
    assert history[-1]["train_update_loss"] == pytest.approx(sum(x * n for x, n in losses) / 90)
    if history[-1]["val_accuracy"] > history[0]["val_accuracy"]:
        assert np.allclose(got.w1, net.w1) and np.allclose(got.b2, net.b2)
    assert mlp.train(df.limit(2), df, 4, 3, 1, batches=50, seed=3)[1][0]["epoch"] == 1  # batches without rows take no step


def test_nets_trained_together_are_those_trained_alone(spark):
    one, two = table(spark, seed=1), table(spark, seed=2)
    both = one.withColumn("number", F.lit(0)).unionByName(two.withColumn("number", F.lit(5)))
    nets = {0: mlp.Net.he(3, 4, 3, 1), 5: mlp.Net.he(3, 4, 3, 2), 9: mlp.Net.he(3, 4, 3, 3)}
    got = mlp.descend_many(both, nets, 3, 0.4, 0.01, by="number")
    for k, rows in ((0, one), (5, two)):
        alone = mlp.descend(rows, nets[k], 3, 0.4, 0.01)
        assert np.allclose(got[k].w1, alone.w1) and np.allclose(got[k].w2, alone.w2) and np.allclose(got[k].b1, alone.b1)
    assert got[9] is nets[9]  # no rows
    found = {r["number"]: r["accuracy"] for r in mlp.accuracies(got, one).collect()}
    assert found == {k: pytest.approx(mlp.measure(net, one)[1]) for k, net in got.items()}
    with pytest.raises(ValueError, match="no training rows"):
        mlp.gradient(one.limit(0), nets[0], np.ones(3))

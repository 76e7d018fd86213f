"""Exact medians by counting, and correlations over gaps, against plain forms."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import cleaning, features, selection


def columns(seed, n):
    rng = random.Random(seed)
    gap = lambda v, p: None if rng.random() < p else v
    one = lambda i: (
        i, gap(rng.gauss(0, 1), 0.2), gap(float(rng.randint(-3, 3)), 0.1), gap(5.0, 0.3) if i % 3 else rng.uniform(4.9, 5.1), rng.choice([-0.0, 0.0, 1e-300, -1e-300, 5e-324]),
        rng.choice([1e300, -1e300, math.inf, -math.inf, 1.0]), rng.choice([math.nan, 1.0, 2.0, None]), None, rng.lognormvariate(0, 20),
    )
    return [one(i) for i in range(n)]


SCHEMA = "id long, gauss double, ties double, heavy double, tiny double, huge double, odd double, none double, wide double"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")][1:]


@pytest.mark.parametrize("n,bins,few", [(1, 1024, 2048), (2, 4, 1), (301, 4, 1), (300, 16, 3), (1000, 1024, 10)])
def test_medians_are_the_built_in_ones(spark, monkeypatch, n, bins, few):
    monkeypatch.setattr(selection, "BINS", bins)
    monkeypatch.setattr(selection, "FEW", few)
    df = spark.createDataFrame(columns(n, n), SCHEMA).repartition(3)
    want = df.agg(*[F.median(c).alias(c) for c in NAMES]).first().asDict()
    got = selection.medians(df, NAMES)
    assert {c: repr(v) for c, v in got.items()} == {c: repr(v if v != 0 else 0.0) if v is not None else "None" for c, v in want.items()}


def test_medians_without_rows_and_other_types(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert selection.medians(empty, NAMES) == dict.fromkeys(NAMES)
    assert selection.medians(spark.range(10), ["id"]) == {"id": 4.5}
    train = spark.createDataFrame([("train", 1.0), ("train", 4.0), ("test", 9.0), ("train", None)], "split string, x double")
    assert cleaning.train_medians(train, ["x"]).collect() == [(2.5,)]
    with pytest.raises(ValueError, match="no training values"):
        cleaning.require_values(cleaning.train_medians(train.where("split = 'test'"), ["x"]))


def test_ranks(spark):
    values = [3.0, 1.0, 1.0, 2.0, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert selection.at_ranks(df, [("x", 0), ("x", 1), ("x", 2), ("x", 3), ("x", 4)]) == [1.0, 1.0, 2.0, 3.0, None]


def test_order_of_numbers_is_that_of_values():
    x = np.array([-math.inf, -1e300, -1.5, -5e-324, 0.0, 5e-324, 1.0, 1e300, math.inf, math.nan])
    numbers = selection.ordered(x)
    assert (np.diff(numbers.astype(object)) > 0).all() and selection.ordered(np.array([-0.0]))[0] == numbers[4]
    assert [repr(selection.value_of(int(v))) for v in numbers] == [repr(float(v)) for v in x]


def test_correlation_of_columns_with_gaps_is_pairwise(spark):
    rows = [(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (4.0, 3.0), (None, 8.0), (9.0, None)]
    r = features.correlation_matrix(spark.createDataFrame(rows, "a double, b double"), ["a", "b"])
    assert r[0, 1] == pytest.approx(0.6) and r[1, 0] == pytest.approx(0.6) and r[0, 0] == pytest.approx(1.0)
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (400, 6)) + 1e4
    x[:, 1] += x[:, 0]
    x[:, 5] = np.where(rng.random(400) < 0.5, 3.5, x[:, 2])
    x[rng.random(x.shape) < 0.3] = np.nan
    x[x[:, 5] != 3.5, 4] = np.nan  # where 4 is there, 5 doesn't vary
    frame = pd.DataFrame(x, columns=list("abcdef"))
    df = spark.createDataFrame([tuple(None if v != v and i % 2 else v for v in r) for i, r in enumerate(x.tolist())], ", ".join(f"{c} double" for c in "abcdef"))
    want = frame.corr("pearson").to_numpy()
    want[4, 5] = want[5, 4] = np.nan
    np.testing.assert_allclose(features.correlation_matrix(df.repartition(5), list("abcdef")), want, rtol=1e-8, atol=1e-9)
    assert np.isnan(features.correlation_matrix(df.limit(0), list("ab"))).all()
    one = spark.createDataFrame([(1.0, None), (None, 2.0), (3.0, 4.0)], "a double, b double")
    assert features.correlations(one, ["a", "b"]).collect() == [("a", "b", None)]

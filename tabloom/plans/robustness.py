"""Registered queries: all four models trained on noisy rows and tested on clean ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators import experiments, knn, metrics, mlp, sampling, trees
from tabloom.plans import model_sql, models, views
from tabloom.sources import tables

Q: dict = {}
SQL: dict[str, str] = {}
DIMS, NAMES, CLASSES, SEED = models.DIMS, models.NAMES, models.CLASSES, models.SEED
#: No noise, and each noise at two intensities.
GRID = (("clean", 0.0), *((k, i) for k in ("gaussian", "uniform", "dropout", "label_flip") for i in (0.3, 0.5)))
TREES, DEPTH = 5, 4
#: Rows and trees of scenario n have ids from n * STRIDE and numbers from n * TREES.
STRIDE = 2**40


def query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_W = views.wide_vectors("duck")
_GRID = "(VALUES " + ", ".join(f"({n}, '{k}', CAST({i} AS DOUBLE))" for n, (k, i) in enumerate(GRID)) + ") AS s(number, noise_type, noise_intensity)"
_NOISY = f"""SELECT s.number, n.id, CAST(substr(n.label, 2) AS INT) AS code, [{', '.join(f'n.{c}' for c in DIMS)}] AS features
      FROM ({" UNION ALL ".join(models._noisy_sql(k, i) for k, i in GRID)}) n JOIN {_GRID} USING (noise_type, noise_intensity) WHERE n.split = 'train'"""
_CLEAN = f"SELECT id, CAST(substr(label, 2) AS INT) AS code, split, [{', '.join(DIMS)}] AS features FROM w WHERE split = 'test'"
_TABLES = f"w AS ({_W}), noisy AS MATERIALIZED ({_NOISY}), clean AS MATERIALIZED ({_CLEAN})"


def _drops_sql(model: str, hits: str) -> str:
    """Drops from hits (number, hit)."""
    return f"""a AS (SELECT noise_type, noise_intensity, '{model}' AS model, avg(CAST(hit AS DOUBLE)) AS test_accuracy FROM ({hits}) JOIN {_GRID} USING (number) GROUP BY ALL),
    b AS (SELECT test_accuracy AS baseline_accuracy FROM a WHERE noise_type = 'clean')
    SELECT noise_type, noise_intensity, model, round(test_accuracy, 8) AS test_accuracy, round(baseline_accuracy, 8) AS baseline_accuracy, round(baseline_accuracy - test_accuracy, 8) AS accuracy_drop,
      round(CASE WHEN baseline_accuracy = 0 THEN 0 ELSE 100 * ((baseline_accuracy - test_accuracy) / baseline_accuracy) END, 6) AS relative_drop_percent FROM a, b"""


def _drops(accuracies: DataFrame, grid: DataFrame, model: str) -> DataFrame:
    """accuracies (number, test_accuracy)."""
    named = accuracies.join(grid, "number").select("noise_type", F.col("intensity").alias("noise_intensity"), F.lit(model).alias("model"), "test_accuracy")
    out = experiments.robustness_drop(named)
    return out.select("noise_type", "noise_intensity", "model", *[F.round(c, 8).alias(c) for c in ("test_accuracy", "baseline_accuracy", "accuracy_drop")], F.round("relative_drop_percent", 6).alias("relative_drop_percent"))


def _scenarios(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(training rows of all scenarios: number, id, label, code, features; test rows; the grid with numbers)."""
    wide = views.load(spark, sf, views.wide_vectors("spark"))
    grid = spark.createDataFrame([(n, k, float(i)) for n, (k, i) in enumerate(GRID)], "number int, noise_type string, intensity double")
    arrays = lambda df: df.withColumns({"features": F.array(*DIMS), "code": F.substring("label", 2, 9).cast("int")})
    many = sampling.scenarios(wide.where("split = 'train'"), GRID, DIMS, "label", NAMES, "id", SEED).join(grid, ["noise_type", "intensity"])
    many = tables.kept(arrays(many).select("number", "id", "label", "code", "features"), "scenarios")
    return many, tables.kept(arrays(wide.where("split = 'test'")).select("id", "label", "code", "features"), "test"), grid


_DISTANCE = "list_sum(list_transform(list_zip(q.features, t.features), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_NEAR = f"SELECT q.id, q.code AS true_code, t.number, t.code, {_DISTANCE} AS distance FROM clean q, noisy t QUALIFY row_number() OVER (PARTITION BY q.id, t.number ORDER BY distance, t.id) <= 11"
_COUNTED = f"SELECT id, true_code, number, code, count(*) AS n, round(sum(distance), 9) AS d FROM ({_NEAR}) GROUP BY ALL"
_VOTED = f"SELECT * FROM ({_COUNTED}) QUALIFY row_number() OVER (PARTITION BY id, number ORDER BY n DESC, d, code DESC) = 1"


@query(f"WITH {_TABLES}, {_drops_sql('knn', f'SELECT number, true_code = code AS hit FROM ({_VOTED})')}")
def robustness_knn(spark, sf):
    many, test, grid = _scenarios(spark, sf)
    hits = metrics.accuracy(knn.predict(many, test, 11, by="number"), ["number"])
    return _drops(hits.select("number", F.col("accuracy").alias("test_accuracy")), grid, "knn")


def _trees_sql(model: str, base: str, each: int, leaf: int, split: int, subset: int | None) -> str:
    grown = model_sql.grow(base, CLASSES, len(DIMS), DEPTH, leaf, split, subset, SEED)
    votes = f"SELECT id, code, tree // {each} AS number, prediction, count(*) AS n FROM reached WHERE cut = {DEPTH} GROUP BY ALL"
    won = f"SELECT * FROM ({votes}) QUALIFY row_number() OVER (PARTITION BY id, number ORDER BY n DESC, prediction) = 1"
    return f"WITH {_TABLES}, {grown}, {model_sql.descend('SELECT * FROM clean', DEPTH)}, {_drops_sql(model, f'SELECT number, code = prediction AS hit FROM ({won})')}"


_FIRST = "(SELECT id, row_number() OVER (ORDER BY id) - 1 AS position FROM noisy WHERE number = 0)"
_DRAWN = f"(SELECT n, unnest(range(greatest(1, CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT)))) AS draw FROM (SELECT count(*) AS n FROM {_FIRST}))"
_WEIGHTS = f"SELECT tree, id, count(*) AS weight FROM (SELECT tree, CAST(floor({models._U_BOOT} * n) AS BIGINT) AS position FROM (SELECT unnest(range({TREES})) AS tree), {_DRAWN}) JOIN {_FIRST} USING (position) GROUP BY tree, id"
_FOREST = f"SELECT n.number * {TREES} + b.tree AS tree, n.id, b.weight, n.code, n.features FROM noisy n JOIN ({_WEIGHTS}) b USING (id)"


def _grown(spark: SparkSession, sf: str, model: str, each: int, leaf: int, split: int, rule: str | None) -> DataFrame:
    """The trees of all scenarios in one growth."""
    many, test, grid = _scenarios(spark, sf)
    own = many.select((F.col("number").cast("long") * STRIDE + F.col("id")).alias("id"), "number", "code", "features")
    if each == 1:
        weights = own.select(F.col("number").alias("tree"), "id", F.lit(1).alias("weight"))
    else:
        drawn = sampling.bootstrap(many.where("number = 0"), "id", each, 0.8, SEED).crossJoin(F.broadcast(grid.select("number")))
        weights = drawn.select((F.col("number") * each + F.col("tree")).alias("tree"), (F.col("number").cast("long") * STRIDE + F.col("id")).alias("id"), "weight")
    made = trees.grow(own, NAMES, DEPTH, leaf, split, weights=weights, features_per_node=rule, seed=SEED)
    votes = test.select("id", "code", F.posexplode(made.descend(F.col("features"))).alias("tree", "label"))
    won = trees.forest_vote(votes.withColumn("number", F.floor(F.col("tree") / each).cast("int")), ["id", "code", "number"])
    return _drops(won.groupBy("number").agg(F.avg((F.col("label") == F.col("code")).cast("double")).alias("test_accuracy")), grid, model)


@query(_trees_sql("tree", "SELECT number AS tree, id, 1 AS weight, code, features FROM noisy", 1, 4, 8, None))
def robustness_tree(spark, sf):
    return _grown(spark, sf, "tree", 1, 4, 8, None)


@query(_trees_sql("forest", _FOREST, TREES, 3, 6, 4))
def robustness_forest(spark, sf):
    return _grown(spark, sf, "forest", TREES, 3, 6, "sqrt")


STEPS, RATE, L2 = 4, 0.5, 1e-4


def _net_sql(number: int) -> str:
    """(number, hit) of the net that STEPS steps on scenario number lead to."""
    out, weights = [f"net0 AS MATERIALIZED ({model_sql.net(models._START)})"], "net0"
    for s in range(STEPS):
        fit = f"SELECT * FROM noisy WHERE number = {number}"
        out += [model_sql.forward(f"g{s}f", weights, fit), model_sql.gradient(f"g{s}", f"g{s}f", weights, models.HIDDEN, models.FEATURES, CLASSES, L2, [1.0] * CLASSES), model_sql.step(f"net{s + 1}", f"g{s}", weights, RATE)]
        weights = f"net{s + 1}"
    out.append(model_sql.forward("m", weights, "SELECT * FROM clean"))
    return f"SELECT {number} AS number, list_position(p, list_max(p)) - 1 = code AS hit FROM (WITH {', '.join(out)} SELECT * FROM m)"


@query(f"WITH {_TABLES}, {_drops_sql('net', ' UNION ALL '.join(_net_sql(n) for n in range(len(GRID))))}")
def robustness_net(spark, sf):
    many, test, grid = _scenarios(spark, sf)
    nets = mlp.descend_many(many, dict.fromkeys(range(len(GRID)), models._START), STEPS, RATE, L2, by="number")
    return _drops(mlp.accuracies(nets, test).withColumnRenamed("accuracy", "test_accuracy"), grid, "net")

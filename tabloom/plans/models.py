"""Registered queries: neighbours, trees, forests, nets."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import scalars
from tabloom.operators import experiments, knn, metrics, mlp, pruned_knn, sampling, trees
from tabloom.plans import model_sql, views
from tabloom.sources import tables

Q: dict = {}
SQL: dict[str, str] = {}
KS = (1, 3, 5, 7, 9, 11, 15, 21)
CLASSES = 10
NAMES = [f"L{i}" for i in range(CLASSES)]


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _vectors(spark: SparkSession, sf: str, dims: int | None = None) -> DataFrame:
    return views.load(spark, sf, views.vectors("spark", dims))


def _split(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("split") == name)


# --- nearest neighbours -------------------------------------------------------------------------

_DIST = "list_sum(list_transform(list_zip(q.features, t.features), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _near_sql(part: str, k: int, extra: str = "") -> str:
    """near (query_id, true_class, rank, train_id, label, distance) of a split against train."""
    return f"""v AS ({views.vectors("duck")}), d AS (SELECT q.id AS query_id, q.label AS true_class, t.id AS train_id, t.label, {_DIST} AS distance FROM v q, v t WHERE q.split = '{part}' AND t.split = 'train'),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id) AS rank FROM d) WHERE rank <= {k}){extra}"""


def _vote_sql(source: str, by: str = "") -> str:
    keys = f"query_id, true_class{by}"
    counts = f"SELECT {keys}, label, count(*) AS n, round(sum(distance), 9) AS s FROM {source} GROUP BY {keys}, label"
    return f"SELECT {keys}, label AS predicted_class FROM ({counts}) QUALIFY row_number() OVER (PARTITION BY query_id{by} ORDER BY n DESC, s, label DESC) = 1"


_MANY = f"many AS (SELECT near.*, k FROM near JOIN (SELECT unnest([{', '.join(map(str, KS))}]) AS k) ON rank <= k), voted AS ({_vote_sql('many', ', k')})"


@query(f"WITH v AS ({views.vectors('duck')}) SELECT q.id, t.id AS other, round({_DIST}, 6) AS distance FROM v q JOIN v t ON t.id = q.id + 1")
def knn_distance(spark, sf):
    v = _vectors(spark, sf).select("id", "features")
    other = v.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), F.col("features").alias("g"))
    return v.join(other, "id").select("id", "other", F.round(scalars.squared_distance(F.col("features"), F.col("g")), 6).alias("distance"))


@query(f"WITH {_near_sql('val', 11)} SELECT query_id, CAST(rank AS INT) AS rank, train_id, label, round(distance, 6) AS distance FROM near")
def knn_topk(spark, sf):
    v = _vectors(spark, sf)
    return knn.topk(_split(v, "train"), _split(v, "val"), 11).withColumn("distance", F.round("distance", 6))


@query(f"WITH {_near_sql('test', 7)} SELECT query_id, CAST(rank AS INT) AS rank, train_id, label, round(distance, 6) AS distance FROM near")
def knn_pruned_topk(spark, sf):
    v = _vectors(spark, sf)
    return pruned_knn.topk(_split(v, "train"), _split(v, "test"), 7).withColumn("distance", F.round("distance", 6))


@query(f"WITH {_near_sql('val', 11)} SELECT query_id, predicted_class FROM ({_vote_sql('near')})")
def knn_vote(spark, sf):
    v = _vectors(spark, sf)
    return knn.votes(knn.topk(_split(v, "train"), _split(v, "val"), 11))


@query(f"WITH {_near_sql('test', 11)} SELECT query_id AS id, true_class, predicted_class FROM ({_vote_sql('near')})")
def knn_predict(spark, sf):
    v = _vectors(spark, sf)
    return knn.predict(_split(v, "train"), _split(v, "test"), 11)


@query(f"WITH {_near_sql('test', 11)} SELECT query_id AS id, true_class, predicted_class, CAST(true_class = predicted_class AS INT) AS is_correct FROM ({_vote_sql('near')})")
def knn_predictions(spark, sf):
    path = tables.scratch(spark, "predictions")
    metrics.with_correct(Q["knn_predict"](spark, sf)).write.parquet(path)
    return spark.read.parquet(path)


@query(f"WITH {_near_sql('val', max(KS))}, {_MANY} SELECT query_id AS id, k, true_class, predicted_class FROM voted")
def knn_multi_k(spark, sf):
    v = _vectors(spark, sf)
    return knn.predict_many(_split(v, "train"), _split(v, "val"), KS)


_ACC = "acc AS (SELECT k, avg(CAST(true_class = predicted_class AS DOUBLE)) AS accuracy FROM voted GROUP BY k)"


@query(f"WITH {_near_sql('val', max(KS))}, {_MANY}, {_ACC} SELECT k, round(accuracy, 8) AS accuracy FROM acc ORDER BY accuracy DESC, k LIMIT 1")
def knn_best_k(spark, sf):
    many = Q["knn_multi_k"](spark, sf)
    return knn.best_k(metrics.accuracy(many, ["k"])).withColumn("accuracy", F.round("accuracy", 8))


@query(f"WITH {_near_sql('val', max(KS))}, {_MANY}, {_ACC} SELECT coalesce((SELECT k FROM acc ORDER BY accuracy DESC, k LIMIT 1), 11) AS k UNION ALL SELECT 11")
def best_k_or_default(spark, sf):
    path = tables.scratch(spark, "best-k")
    tables.write_rows(Q["knn_best_k"](spark, sf), path)
    tuned = tables.best_or_default(spark.read.json(path), "k", 11, spark)
    return tuned.unionByName(tables.best_or_default(None, "k", 11, spark))


@query(f"WITH {_near_sql('train', 5)}, one AS (SELECT * FROM near WHERE rank <= 1) SELECT 1 AS k, avg(CAST(true_class = predicted_class AS DOUBLE)) AS accuracy FROM ({_vote_sql('one')}) UNION ALL SELECT 5, round(avg(CAST(true_class = predicted_class AS DOUBLE)), 8) FROM ({_vote_sql('near')})")
def knn_train_self(spark, sf):
    train = _split(_vectors(spark, sf), "train")
    return metrics.accuracy(knn.predict_many(train, train, (1, 5)), ["k"]).select("k", F.round("accuracy", 8).alias("accuracy"))


def _curve(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    parts = [metrics.accuracy(knn.predict_many(_split(v, "train"), _split(v, s), KS), ["k"]).withColumn("split", F.lit(s)) for s in ("train", "val", "test")]
    return experiments.sweep_gaps(tables.append_splits(parts), ["k"])


_CURVE = " UNION ALL ".join(f"SELECT '{s}' AS split, k, accuracy FROM (WITH {_near_sql(s, max(KS))}, {_MANY}, {_ACC} SELECT * FROM acc)" for s in ("train", "val", "test"))
_GAPS = "max(accuracy) FILTER (split = 'train') AS train_accuracy, max(accuracy) FILTER (split = 'val') AS val_accuracy, max(accuracy) FILTER (split = 'test') AS test_accuracy"
_ROUND_GAPS = "round(train_accuracy, 8) AS train_accuracy, round(val_accuracy, 8) AS val_accuracy, round(test_accuracy, 8) AS test_accuracy, round(train_accuracy - val_accuracy, 8) AS train_val_gap, round(train_accuracy - test_accuracy, 8) AS train_test_gap"


@query(f"WITH a AS ({_CURVE}), w AS (SELECT k, {_GAPS} FROM a GROUP BY k) SELECT k, {_ROUND_GAPS} FROM w")
def knn_k_curve(spark, sf):
    out = _curve(spark, sf)
    return out.select("k", *[F.round(c, 8).alias(c) for c in out.columns if c != "k"])


# --- noise on training rows, neighbours on clean ones -------------------------------------------

GRID = (("clean", 0.0), ("gaussian", 0.5), ("uniform", 0.5), ("dropout", 0.5), ("label_flip", 0.3))
DIMS = [f"f{i}" for i in range(16)]
SEED = 42


def _noise_sql(kind: str, i: int, c: str, intensity: float, seed: int) -> str:
    u = lambda name: views.uniform_sql("duck", f"CAST(id AS STRING) || ':{name}:{seed}'")
    if kind == "gaussian":
        return f"{c} + {intensity} * (sqrt(-2 * ln({u(f'gaussian.{c}.r')})) * cos(2 * pi() * {u(f'gaussian.{c}.a')}))"
    if kind == "uniform":
        return f"{c} + (2 * {u(f'uniform.{c}')} - 1) * {intensity}"
    if kind == "dropout":
        return f"CASE WHEN {u(f'dropout.{c}')} < {intensity} THEN 0 ELSE {c} END"
    return c


def _flip_sql(intensity: float, seed: int) -> str:
    u = lambda name: views.uniform_sql("duck", f"CAST(id AS STRING) || ':{name}:{seed}'")
    others = f"list_filter([{', '.join(map(repr, NAMES))}], lambda x: x <> label)"
    return f"CASE WHEN {u('flip')} < {intensity} THEN ({others})[CAST(floor({u('flip.to')} * {CLASSES - 1}) AS INT) + 1] ELSE label END"


def _noisy_sql(kind: str, intensity: float) -> str:
    seed = sampling.scenario_seed(kind, intensity, SEED)
    label = _flip_sql(intensity, seed) if kind == "label_flip" else "label"
    cols = ", ".join(f"{_noise_sql(kind, i, c, intensity, seed)} AS {c}" for i, c in enumerate(DIMS))
    return f"SELECT id, split, '{kind}' AS noise_type, CAST({intensity} AS DOUBLE) AS noise_intensity, {label} AS label, {cols} FROM w"


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    return views.load(spark, sf, views.wide_vectors("spark"))


def _noise_query(kind: str, intensity: float):
    rounded = ", ".join(f"round({c}, 6) AS {c}" for c in DIMS)

    @query(f"WITH w AS ({views.wide_vectors('duck')}), n AS ({_noisy_sql(kind, intensity)}) SELECT id, label, {rounded} FROM n WHERE split = 'train'")
    def q(spark, sf):
        train = _split(_wide(spark, sf), "train")
        out = sampling.with_noise(train, kind, intensity, DIMS, "label", NAMES, "id", sampling.scenario_seed(kind, intensity, SEED))
        return out.select("id", "label", *[F.round(c, 6).alias(c) for c in DIMS])

    name = f"noise_{kind}"
    Q[name], SQL[name] = Q.pop("q"), SQL.pop("q")


for _kind, _intensity in GRID[1:]:
    _noise_query(_kind, _intensity)

_ALL_NOISE = " UNION ALL ".join(_noisy_sql(k, i) for k, i in GRID)


@query(f"WITH w AS ({views.wide_vectors('duck')}), n AS ({_ALL_NOISE}) SELECT noise_type, noise_intensity, label, count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}' for c in DIMS)} FROM n WHERE split = 'train' GROUP BY ALL")
def noise_scenarios(spark, sf):
    many = sampling.scenarios(_split(_wide(spark, sf), "train"), GRID, DIMS, "label", NAMES, "id", SEED)
    return many.groupBy("noise_type", F.col("intensity").alias("noise_intensity"), "label").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in DIMS])


# --- samples ------------------------------------------------------------------------------------

_LIMIT = 137


@query(
    f"""WITH v AS ({views.vectors('duck')}), c AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY label) AS i FROM v GROUP BY label),
    s AS (SELECT *, least(n, greatest(1, CAST(round_even(CAST({_LIMIT} AS DOUBLE) * n / (SELECT count(*) FROM v), 0) AS BIGINT))) AS share FROM c),
    b AS (SELECT *, coalesce(sum(share) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
    q AS (SELECT label, CASE WHEN i = (SELECT max(i) FROM c) THEN greatest(0, least(n, {_LIMIT} - before)) ELSE share END AS quota FROM b),
    r AS (SELECT v.id, v.label, row_number() OVER (PARTITION BY v.label ORDER BY {views.uniform_sql("duck", "CAST(id AS STRING) || ':strata:7'")}, id) AS r, quota FROM v JOIN q USING (label)),
    a AS (SELECT id, label FROM r WHERE r <= quota ORDER BY label, r LIMIT {_LIMIT}),
    f AS (SELECT id, label FROM v WHERE id NOT IN (SELECT id FROM a) ORDER BY {views.uniform_sql("duck", "CAST(id AS STRING) || ':fill:7'")}, id LIMIT (SELECT {_LIMIT} - count(*) FROM a))
    SELECT * FROM a UNION ALL SELECT * FROM f"""
)
def stratified_limit(spark, sf):
    return sampling.stratified_limit(_vectors(spark, sf).select("id", "label"), "label", "id", _LIMIT, 7)


_U_BOOT = views.uniform_sql("duck", "CAST(draw AS STRING) || ':' || CAST(tree AS STRING) || ':42'")


@query(
    f"""WITH v AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS position FROM ({views.vectors('duck')}) WHERE split = 'train'), n AS (SELECT count(*) AS n, greatest(1, CAST(floor(count(*) * CAST(0.8 AS DOUBLE)) AS BIGINT)) AS draws FROM v),
    d AS (SELECT tree, unnest(range(draws)) AS draw, n FROM n, (SELECT unnest(range(5)) AS tree)), p AS (SELECT tree, CAST(floor({_U_BOOT} * n) AS BIGINT) AS position FROM d)
    SELECT CAST(tree AS INT) AS tree, id, count(*) AS weight FROM p JOIN v USING (position) GROUP BY tree, id"""
)
def bootstrap_sample(spark, sf):
    return sampling.bootstrap(_split(_vectors(spark, sf), "train"), "id", 5, 0.8, 42)


_U_SUB = views.uniform_sql("duck", "CAST(tree AS STRING) || '/' || CAST(node AS STRING) || ':' || CAST(feature AS STRING) || ':42'")


def _subset_sql(size: int) -> str:
    return f"""WITH k AS (SELECT DISTINCT vec_id % 7 AS tree, vec_id % 31 AS node FROM embeddings), x AS (SELECT tree, node, f AS feature FROM k, (SELECT unnest(range(64)) AS f))
    SELECT CAST(tree AS INT) AS tree, node, CAST(feature AS INT) AS feature FROM x QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY {_U_SUB}, feature) <= {size}"""


def _subset(spark: SparkSession, sf: str, rule: str | int) -> DataFrame:
    nodes = views.load(spark, sf, "SELECT DISTINCT CAST(vec_id % 7 AS INT) AS tree, vec_id % 31 AS node FROM embeddings")
    names = spark.range(64).select(F.col("id").cast("int").alias("feature"))
    return sampling.feature_subset(nodes, names, sampling.subset_size(64, rule), 42)


@query(_subset_sql(6))
def feature_subset_log2(spark, sf):
    return _subset(spark, sf, "log2")


@query(_subset_sql(12))
def feature_subset_number(spark, sf):
    return _subset(spark, sf, 12)


@query(_subset_sql(8))
def feature_subset(spark, sf):
    return _subset(spark, sf, "sqrt")


# --- trees --------------------------------------------------------------------------------------


@query("WITH e AS (SELECT user_id % 50 AS grp, event_type AS label FROM events), c AS (SELECT grp, label, CAST(count(*) AS DOUBLE) AS c FROM e GROUP BY grp, label), t AS (SELECT grp, sum(c) AS t FROM c GROUP BY grp) SELECT grp, round(sum(-(c / t) * log2(c / t)), 8) AS entropy FROM c JOIN t USING (grp) GROUP BY grp")
def entropy_by_group(spark, sf):
    e = views.load(spark, sf, "SELECT user_id % 50 AS grp, event_type AS label FROM events")
    return trees.entropy_by_group(e, ["grp"], "label").withColumn("entropy", F.round("entropy", 8))


@query("WITH e AS (SELECT user_id % 50 AS grp, event_type AS label FROM events) SELECT grp, label, count(*) AS n FROM e GROUP BY grp, label QUALIFY row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, label) = 1")
def majority_label(spark, sf):
    e = views.load(spark, sf, "SELECT user_id % 50 AS grp, event_type AS label FROM events")
    return trees.majority(e, ["grp"], "label")


def _entropy_sql(side: str) -> str:
    n = "(" + " + ".join(f"{side}{k}" for k in range(CLASSES)) + ")"
    return "(" + " + ".join(f"CASE WHEN {side}{k} > 0 THEN -({side}{k} / {n}) * log2({side}{k} / {n}) ELSE 0 END" for k in range(CLASSES)) + ")"


_N = {s: "(" + " + ".join(f"{s}{k}" for k in range(CLASSES)) + ")" for s in "ltr"}
_EACH = ", ".join(f"CAST(count(*) FILTER (code = {k}) AS DOUBLE) AS c{k}" for k in range(CLASSES))
_LEFT = ", ".join(f"sum(c{k}) OVER w AS l{k}, sum(c{k}) OVER (PARTITION BY node, feature) AS t{k}" for k in range(CLASSES))
_RIGHT = ", ".join(f"t{k} - l{k} AS r{k}" for k in range(CLASSES))


@query(
    f"""WITH v AS ({views.vectors('duck', 16)}), x AS (SELECT id % 4 AS node, code, f AS feature, features[f + 1] AS value FROM v, (SELECT unnest(range(16)) AS f) WHERE split = 'train'),
    d AS (SELECT node, feature, value, {_EACH}, min(code) AS low, max(code) AS high FROM x GROUP BY node, feature, value),
    g AS (SELECT node, feature, value, high, {_LEFT}, lead(value) OVER w AS nv, lead(low) OVER w AS nl FROM d WINDOW w AS (PARTITION BY node, feature ORDER BY value)),
    h AS (SELECT *, {_RIGHT} FROM g WHERE nv IS NOT NULL AND high <> nl),
    s AS (SELECT node, feature, (value + nv) / 2 AS threshold, round({_entropy_sql("t")} - {_N["l"]} / {_N["t"]} * {_entropy_sql("l")} - {_N["r"]} / {_N["t"]} * {_entropy_sql("r")}, 12) AS gain FROM h WHERE {_N["l"]} >= 4 AND {_N["r"]} >= 4)
    SELECT node, CAST(feature AS INT) AS feature, round(threshold, 8) AS threshold, round(gain, 8) AS gain FROM s QUALIFY row_number() OVER (PARTITION BY node ORDER BY s.gain DESC, s.feature, s.threshold) = 1"""
)
def best_split(spark, sf):
    rows = _split(_vectors(spark, sf, 16), "train").select(F.lit(0).alias("tree"), (F.col("id") % 4).alias("node"), F.lit(1).alias("weight"), "code", "features")
    return trees.best_splits(rows, CLASSES, 4).select("node", "feature", F.round("threshold", 8).alias("threshold"), F.round("gain", 8).alias("gain"))


def _tree(spark: SparkSession, sf: str, depth: int = 6) -> tuple[trees.TreeModel, DataFrame]:
    v = _vectors(spark, sf, 16)
    return trees.grow(_split(v, "train"), NAMES, depth, least_leaf=4, least_split=8), v


def _forest(spark: SparkSession, sf: str, depth: int = 6, n: int = 9) -> tuple[trees.TreeModel, DataFrame]:
    v = _vectors(spark, sf, 16)
    train = _split(v, "train")
    return trees.grow(train, NAMES, depth, least_leaf=3, least_split=6, weights=sampling.bootstrap(train, "id", n, 0.8, SEED), features_per_node="sqrt", seed=SEED), v


_TREE_DEPTH, _FOREST_TREES = 6, 9
_BASE = f"SELECT 0 AS tree, id, 1 AS weight, code, features FROM ({views.vectors('duck', 16)}) WHERE split = 'train'"
_BOOT = f"""SELECT d.tree AS tree, p.id, count(*) AS weight, any_value(v.code) AS code, any_value(v.features) AS features FROM
      (SELECT tree, CAST(floor({_U_BOOT} * n) AS BIGINT) AS position FROM (SELECT unnest(range({_FOREST_TREES})) AS tree), (SELECT n, unnest(range(greatest(1, CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT)))) AS draw FROM (SELECT count(*) AS n FROM ({_BASE})))) d
      JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS position FROM ({_BASE})) p USING (position) JOIN ({_BASE}) v ON v.id = p.id GROUP BY d.tree, p.id"""
_TREE_SQL = model_sql.grow(_BASE, CLASSES, 16, _TREE_DEPTH, 4, 8)
_FOREST_SQL = model_sql.grow(_BOOT, CLASSES, 16, _TREE_DEPTH, 3, 6, 4, SEED)
_REACHED = model_sql.descend(views.vectors("duck", 16), _TREE_DEPTH)
_NODES = "SELECT tree, node, depth, prediction, feature, round(threshold, 8) AS threshold FROM nodes"
_VOTED = f"SELECT id, 'L' || code AS true_class, 'L' || prediction AS predicted_class FROM ({model_sql.VOTE}) WHERE split = 'test' AND cut = {_TREE_DEPTH}"
_SIZES = "SELECT tree, count(*) AS nodes, count(*) FILTER (feature < 0) AS leaves, max(depth) AS depth FROM nodes GROUP BY tree"


def _rounded(model: trees.TreeModel, spark: SparkSession) -> DataFrame:
    return model.table(spark).withColumn("threshold", F.round("threshold", 8))


@query(f"WITH {_TREE_SQL} {_NODES}")
def tree_level_fit(spark, sf):
    return _rounded(_tree(spark, sf)[0], spark)


@query(f"WITH {_TREE_SQL}, {_REACHED} {_VOTED}")
def tree_predict(spark, sf):
    model, v = _tree(spark, sf)
    return model.predict(_split(v, "test"))


@query(f"WITH {_TREE_SQL} {_SIZES}")
def tree_summary(spark, sf):
    return _tree(spark, sf)[0].summary(spark)


@query(f"WITH {_FOREST_SQL} {_NODES}")
def forest_fit(spark, sf):
    return _rounded(_forest(spark, sf)[0], spark)


@query(f"WITH {_FOREST_SQL}, {_REACHED} {_VOTED}")
def forest_predict(spark, sf):
    model, v = _forest(spark, sf)
    return model.predict(_split(v, "test"))


@query(f"WITH {_FOREST_SQL} SELECT min(depth) AS min_depth, max(depth) AS max_depth, avg(depth) AS mean_depth, avg(nodes) AS mean_nodes, avg(leaves) AS mean_leaves FROM ({_SIZES})")
def forest_summary(spark, sf):
    return trees.forest_summary(_forest(spark, sf)[0].summary(spark))


@query(f"WITH p AS ({views.predictions('duck')}) SELECT id, predicted_class AS label FROM p GROUP BY id, predicted_class QUALIFY row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, predicted_class) = 1")
def forest_vote(spark, sf):
    p = views.load(spark, sf, views.predictions("spark"))
    return trees.forest_vote(p.select("id", F.col("predicted_class").alias("label")), ["id"])


_CUTS = (1, 2, 3, 4, 6)
_BY_DEPTH = f"SELECT cut, split, avg(CAST(code = prediction AS DOUBLE)) AS accuracy FROM ({model_sql.VOTE}) WHERE cut IN {_CUTS} GROUP BY cut, split"


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS model, cut AS depth, {_ROUND_GAPS} FROM (SELECT cut, {_GAPS} FROM (WITH {sql}, {_REACHED} {_BY_DEPTH}) GROUP BY cut)" for name, sql in (("tree", _TREE_SQL), ("forest", _FOREST_SQL))
    )
)
def tree_depth_curve(spark, sf):
    """One deep tree and one deep forest, cut at each depth."""
    parts = []
    for name, (model, v) in (("tree", _tree(spark, sf)), ("forest", _forest(spark, sf))):
        for depth in _CUTS:
            small = model.cut_at(depth)
            parts += [metrics.accuracy(small.predict(_split(v, s))).select(F.lit(name).alias("model"), F.lit(depth).alias("depth"), F.lit(s).alias("split"), "accuracy") for s in ("train", "val", "test")]
    out = experiments.sweep_gaps(tables.append_splits(parts), ["model", "depth"])
    return out.select("model", "depth", *[F.round(c, 8).alias(c) for c in out.columns if c not in ("model", "depth")])


# --- net ----------------------------------------------------------------------------------------

HIDDEN, FEATURES = 8, 16


def hashed_net() -> mlp.Net:
    """Weights from hashes, so that SQL can have the same."""
    u = lambda name: (int(hashlib.md5(name.encode()).hexdigest()[:8], 16) + 0.5) / 4294967296 - 0.5
    m = lambda n, r, c: np.array([[round(2 * u(f"{n}:{i}:{j}"), 4) for j in range(c)] for i in range(r)])
    return mlp.Net(m("w1", HIDDEN, FEATURES), m("b1", 1, HIDDEN)[0], m("w2", CLASSES, HIDDEN), m("b2", 1, CLASSES)[0])


def _forward_sql() -> str:
    net = hashed_net()
    vec = lambda row: "[" + ", ".join(f"CAST({v} AS DOUBLE)" for v in row) + "]"
    dot = lambda row, x: f"list_sum(list_transform(list_zip({vec(row)}, {x}), lambda p: p[1] * p[2]))"
    hidden = "[" + ", ".join(f"greatest({dot(r, 'features')} + {b}, CAST(0 AS DOUBLE))" for r, b in zip(net.w1, net.b1, strict=True)) + "]"
    out = "[" + ", ".join(f"{dot(r, 'h')} + {b}" for r, b in zip(net.w2, net.b2, strict=True)) + "]"
    return f"""v AS ({views.vectors('duck', FEATURES)}), a AS (SELECT id, split, code, {hidden} AS h FROM v), z AS (SELECT id, split, code, {out} AS z FROM a),
    e AS (SELECT id, split, code, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z), p AS (SELECT id, split, code, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)"""


@query(f"WITH {_forward_sql()} SELECT id, CAST(i AS INT) AS class, round(p[i + 1], 8) AS share FROM p, (SELECT unnest(range({CLASSES})) AS i)")
def mlp_forward(spark, sf):
    v = _vectors(spark, sf, FEATURES)
    shares = v.select("id", F.posexplode(mlp.forward_batches(hashed_net(), F.col("features"))).alias("class", "share"))
    return shares.withColumn("share", F.round("share", 8))


@query(f"WITH {_forward_sql()} SELECT id, CAST(list_position(p, list_max(p)) - 1 AS INT) AS predicted FROM p")
def mlp_predict(spark, sf):
    return mlp.predict(hashed_net(), _vectors(spark, sf, FEATURES)).select("id", "predicted")


@query(f"WITH {_forward_sql()} SELECT split, round(avg(-ln(greatest(p[code + 1], CAST(1e-15 AS DOUBLE)))), 8) AS loss FROM p GROUP BY split")
def cross_entropy(spark, sf):
    v = _vectors(spark, sf, FEATURES)
    scored = v.withColumn("p", mlp.forward_columns(hashed_net(), F.col("features")))
    return scored.groupBy("split").agg(F.round(mlp.cross_entropy(F.col("p"), F.col("code")), 8).alias("loss"))


_CLASS_WEIGHTS, _L2, _DROPOUT = [round(0.5 + k / 10, 1) for k in range(CLASSES)], 0.001, 0.25
#: The mask of mlp.gradient for a row's id and seed 7, in integers of 128 bits.
_CELL = "xor(CAST((CAST(id AS UHUGEINT) * 11400714819323198485 + 7) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT), CAST((CAST(c AS UHUGEINT) * 14029467366897019727) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT))"
_MASK = f"list_transform(range({HIDDEN}), lambda c: CASE WHEN CAST((CAST((CAST(xor({_CELL}, {_CELL} >> 33) AS UHUGEINT) * 18397679294719823053) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT) >> 11) AS DOUBLE) / 9007199254740992 >= {_DROPOUT} THEN CAST(1 AS DOUBLE) / (1 - CAST({_DROPOUT} AS DOUBLE)) ELSE 0 END)"


def _gradient_sql(mask: str | None) -> str:
    rows = f"SELECT * FROM ({views.vectors('duck', FEATURES)}) WHERE split = 'train'"
    ctes = f"net0 AS ({model_sql.net(hashed_net())}), {model_sql.forward('f', 'net0', rows, mask)}, {model_sql.gradient('g', 'f', 'net0', HIDDEN, FEATURES, CLASSES, _L2, _CLASS_WEIGHTS, mask)}"
    parts = [("w1", f"j * {FEATURES} + i"), ("b1", "j"), ("w2", f"j * {HIDDEN} + i"), ("b2", "j"), ("loss", "0")]
    return f"WITH {ctes} " + " UNION ALL ".join(f"SELECT '{p}' AS part, CAST({i} AS INT) AS i, round(v, 8) + 0.0 AS value FROM g_{p}" for p, i in parts)


def _gradient(spark: SparkSession, sf: str, dropout: float) -> DataFrame:
    g, loss = mlp.gradient(_split(_vectors(spark, sf, FEATURES), "train"), hashed_net(), np.array(_CLASS_WEIGHTS), _L2, dropout, 7)
    rows = [(n, i, round(float(v), 8) + 0.0) for n in ("w1", "b1", "w2", "b2") for i, v in enumerate(getattr(g, n).ravel())]
    return spark.createDataFrame([*rows, ("loss", 0, round(loss, 8))], "part string, i int, value double")


@query(_gradient_sql(None))
def mlp_gradient(spark, sf):
    return _gradient(spark, sf, 0.0)


@query(_gradient_sql(_MASK))
def mlp_dropout_gradient(spark, sf):
    return _gradient(spark, sf, _DROPOUT)


_START = mlp.Net.he(FEATURES, HIDDEN, CLASSES, 1)
_HISTORY = ("epoch", "train_update_loss", "train_loss", "val_loss", "train_accuracy", "val_accuracy", "learning_rate")


def _train_sql(epochs: int, patience: int | None, batches: int | None = None) -> str:
    return model_sql.train(views.vectors("duck", FEATURES), _START, epochs, batches or 2, 0.5, 1e-4, patience, 1 if batches else None)


def _history_sql(columns: tuple[str, ...]) -> str:
    return "SELECT CAST(epoch AS BIGINT) AS epoch, " + ", ".join(f"round({c}, 8) AS {c}" for c in columns[1:]) + " FROM history"


def _train(spark: SparkSession, sf: str, epochs: int, patience: int | None, batches: int | None = None):
    v = _vectors(spark, sf, FEATURES)
    path = tables.scratch(spark, "net")
    v.select("id", "split", "code", "features").write.parquet(path)
    v = spark.read.parquet(path)
    return mlp.train(_split(v, "train"), _split(v, "val"), HIDDEN, CLASSES, epochs, patience=patience, steps=2, seed=1, test=_split(v, "test"), batches=batches)


def _history(spark: SparkSession, history: list[dict], columns: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([tuple(h[c] if c == "epoch" else round(float(h[c]), 8) for c in columns) for h in history], "epoch long, " + ", ".join(f"{c} double" for c in columns[1:]))


@query(f"WITH {_train_sql(5, 3)} SELECT id, code AS true_code, predicted FROM ({model_sql.best_predictions(5)}) WHERE split = 'test'")
def mlp_train(spark, sf):
    net, _ = _train(spark, sf, 5, 3)
    v = _vectors(spark, sf, FEATURES)
    return mlp.predict(net, _split(v, "test")).select("id", F.col("code").alias("true_code"), "predicted")


@query(f"WITH {_train_sql(5, 3)} {_history_sql(_HISTORY)}")
def mlp_history(spark, sf):
    return _history(spark, _train(spark, sf, 5, 3)[1], _HISTORY)


@query(f"WITH {_train_sql(4, None)} {_history_sql((*_HISTORY, 'test_accuracy'))}")
def mlp_epoch_curve(spark, sf):
    return _history(spark, _train(spark, sf, 4, None)[1], (*_HISTORY, "test_accuracy"))


@query(f"WITH {_train_sql(2, None, 3)} {_history_sql((*_HISTORY, 'test_accuracy'))}")
def mlp_minibatch_history(spark, sf):
    return _history(spark, _train(spark, sf, 2, None, 3)[1], (*_HISTORY, "test_accuracy"))


@query(f"WITH {_train_sql(2, None, 3)} SELECT id, code AS true_code, predicted FROM ({model_sql.best_predictions(2)}) WHERE split = 'test'")
def mlp_minibatch_train(spark, sf):
    net, _ = _train(spark, sf, 2, None, 3)
    return mlp.predict(net, _split(_vectors(spark, sf, FEATURES), "test")).select("id", F.col("code").alias("true_code"), "predicted")

"""Registered queries: metrics and experiment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators import experiments, metrics
from tabloom.plans import views
from tabloom.sources import tables

Q: dict = {}
SQL: dict[str, str] = {}
MEASURES = ("precision", "recall", "f1")
AVERAGES = [f"{a}_{m}" for a in ("macro", "weighted") for m in MEASURES]


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    return views.load(spark, sf, views.predictions("spark"))


def _rounded(df: DataFrame, columns, digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


_R = lambda cols, d=8: ", ".join(f"round({c}, {d}) AS {c}" for c in cols)
_L = f"l AS (SELECT unnest([{', '.join(map(repr, views.LABELS))}]) AS label)"


def _metrics_sql(by: str) -> str:
    """conf, cls and avgs grouped by `by` (column names with commas)."""
    keys = [k.strip() for k in by.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    pick = ", ".join(f"g.{k}" for k in keys)
    sd = lambda n, d: f"CASE WHEN {d} = 0 THEN 0 ELSE {n} / {d} END"
    return f"""pr AS ({views.predictions('duck')}), {_L}, seen AS (SELECT {by}, true_class, predicted_class, count(*) AS n FROM pr GROUP BY ALL), g AS (SELECT DISTINCT {by} FROM pr),
    conf AS (SELECT {pick}, a.label AS true_class, b.label AS predicted_class, coalesce(seen.n, 0) AS n FROM g CROSS JOIN l a CROSS JOIN l b LEFT JOIN seen ON {on("seen", "g")} AND seen.true_class = a.label AND seen.predicted_class = b.label),
    cnt AS (SELECT {pick}, label AS class, CAST(coalesce(sum(n) FILTER (true_class = label AND predicted_class = label), 0) AS DOUBLE) AS tp, CAST(coalesce(sum(n) FILTER (true_class = label), 0) AS BIGINT) AS support, CAST(coalesce(sum(n) FILTER (predicted_class = label), 0) AS BIGINT) AS predicted
      FROM g JOIN conf ON {on("conf", "g")} CROSS JOIN l GROUP BY {pick}, label),
    pre AS (SELECT *, {sd("tp", "predicted")} AS "precision", {sd("tp", "support")} AS recall FROM cnt),
    cls AS (SELECT {by}, class, "precision", recall, {sd('2 * "precision" * recall', '("precision" + recall)')} AS f1, support FROM pre),
    avgs AS (SELECT {by}, {", ".join(f'avg("{m}") AS macro_{m}, sum("{m}" * support) / sum(support) AS weighted_{m}' for m in MEASURES)} FROM cls GROUP BY {by}),
    acc AS (SELECT {by}, CAST(sum(n) FILTER (true_class = predicted_class) AS DOUBLE) / sum(n) AS accuracy FROM conf GROUP BY {by})"""


def _classes(spark: SparkSession, sf: str, by) -> DataFrame:
    return metrics.per_class(metrics.confusion(_predictions(spark, sf), views.label_table(spark, sf), by), by)


@query(f"WITH pr AS ({views.predictions('duck')}) SELECT model, split, count(*) AS n, round(avg(CAST(true_class = predicted_class AS DOUBLE)), 8) AS accuracy FROM pr GROUP BY ALL")
def accuracy(spark, sf):
    return _rounded(metrics.accuracy(_predictions(spark, sf), ["model", "split"]), ["accuracy"])


@query(f"WITH {_metrics_sql('model')} SELECT model, true_class, predicted_class, n FROM conf")
def confusion_long(spark, sf):
    return metrics.confusion(_predictions(spark, sf), views.label_table(spark, sf), ["model"])


@query(f"WITH {_metrics_sql('model')} SELECT true_class, " + ", ".join(f"CAST(sum(n) FILTER (predicted_class = '{c}') AS BIGINT) AS \"{c}\"" for c in views.LABELS) + " FROM conf WHERE model = 'A' GROUP BY true_class")
def confusion_wide(spark, sf):
    one = _predictions(spark, sf).where("model = 'A'")
    return metrics.confusion_wide(metrics.confusion(one, views.label_table(spark, sf)), views.LABELS)


@query(f"WITH {_metrics_sql('model')} SELECT model, true_class, predicted_class, round(CASE WHEN sum(n) OVER (PARTITION BY model, true_class) = 0 THEN 0 ELSE CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY model, true_class) END, 8) AS share FROM conf")
def confusion_normalized(spark, sf):
    table = metrics.confusion(_predictions(spark, sf), views.label_table(spark, sf), ["model"])
    return _rounded(metrics.confusion_shares(table, ["model"]), ["share"])


@query(f"WITH {_metrics_sql('model')} SELECT class, round(\"precision\", 8) AS \"precision\", {_R(['recall', 'f1'])}, support FROM cls WHERE model = 'B'")
def per_class_metrics(spark, sf):
    table = metrics.confusion(_predictions(spark, sf).where("model = 'B'"), views.label_table(spark, sf))
    return _rounded(metrics.per_class(table), MEASURES)


@query(f"WITH {_metrics_sql('model')} SELECT model, {_R(AVERAGES)} FROM avgs")
def macro_weighted_metrics(spark, sf):
    return _rounded(metrics.averages(_classes(spark, sf, ["model"]), ["model"]), AVERAGES)


@query(f"WITH {_metrics_sql('model, split')} SELECT model, split, {_R(['accuracy', *AVERAGES])} FROM acc JOIN avgs USING (model, split)")
def model_metric_table(spark, sf):
    out = metrics.model_table(_predictions(spark, sf), views.label_table(spark, sf), ["model", "split"])
    return _rounded(out, ["accuracy", *AVERAGES])


@query(f"WITH {_metrics_sql('model')} SELECT model, class, round(\"precision\", 8) AS \"precision\", {_R(['recall', 'f1'])}, support FROM cls")
def per_class_table(spark, sf):
    return _rounded(_classes(spark, sf, ["model"]), MEASURES)


_SHOWN = {"accuracy": "Accuracy", "macro_f1": "Macro F1", "weighted_f1": "Weighted F1"}


def _models(spark, sf) -> DataFrame:
    return metrics.model_table(_predictions(spark, sf), views.label_table(spark, sf), ["model"])


@query(f"WITH {_metrics_sql('model')}, t AS (SELECT * FROM acc JOIN avgs USING (model)) " + " UNION ALL ".join(f"SELECT model, '{n}' AS metric, round({m}, 8) AS score FROM t" for m, n in _SHOWN.items()))
def metrics_unpivot(spark, sf):
    return _rounded(experiments.unpivot_metrics(_models(spark, sf), ["model"], _SHOWN), ["score"])


@query(f"WITH {_metrics_sql('model')} SELECT model, round(accuracy, 8) AS accuracy FROM acc ORDER BY accuracy DESC, model LIMIT 1")
def best_model(spark, sf):
    return _rounded(experiments.best_model(_models(spark, sf).select("model", "accuracy")), ["accuracy"])


@query(f"WITH {_metrics_sql('model, split')}, t AS (SELECT * FROM acc JOIN avgs USING (model, split)) SELECT model, " + ", ".join(f"round(max({v}) FILTER (split = '{s}'), 8) AS {s}_{v}" for s in ("val", "test") for v in ("accuracy", "macro_f1")) + " FROM t GROUP BY model")
def model_split_pivot(spark, sf):
    table = metrics.model_table(_predictions(spark, sf), views.label_table(spark, sf), ["model", "split"])
    out = experiments.split_pivot(table, ["accuracy", "macro_f1"])
    return _rounded(out, [c for c in out.columns if c != "model"])


# --- reports ------------------------------------------------------------------------------------


@query(f"WITH {_metrics_sql('model')} SELECT 'json' AS form, model, {_R(['accuracy', *AVERAGES])} FROM acc JOIN avgs USING (model) UNION ALL SELECT 'csv', model, {_R(['accuracy', *AVERAGES])} FROM acc JOIN avgs USING (model)")
def json_csv_roundtrip(spark, sf):
    table = _rounded(_models(spark, sf), ["accuracy", *AVERAGES])
    schema = table.schema
    paths = {form: tables.scratch(spark, form) for form in ("json", "csv")}
    for form, path in paths.items():
        tables.write_rows(table, path, form)
    back = {"json": spark.read.schema(schema).json(paths["json"]), "csv": spark.read.schema(schema).csv(paths["csv"], header=True)}
    return tables.append_splits([df.withColumn("form", F.lit(form)) for form, df in back.items()])


@query(f"WITH {_metrics_sql('model')} SELECT model, round(accuracy, 8) AS accuracy, round(macro_f1, 8) AS macro_f1 FROM acc JOIN avgs USING (model)")
def collect_reports(spark, sf):
    """Each model's report is a file of its own, the numbers at other places in it."""
    table = _rounded(_models(spark, sf), ["accuracy", "macro_f1"]).select("model", "accuracy", "macro_f1")
    place = {"A": "test_report", "B": "test.report", "C": "results.test.report"}
    reports = {}
    for model, path in place.items():
        row = F.struct("accuracy", "macro_f1")
        *outer, inner = path.split(".")
        nested = row.alias(inner)
        for name in reversed(outer):
            nested = F.struct(nested).alias(name)
        file = tables.scratch(spark, f"report-{model}")
        table.where(F.col("model") == model).select(nested).write.json(file)
        reports[model] = spark.read.json(file, multiLine=True).select(F.col(path).alias("report"))
    return tables.collect_reports(reports, "report")


_NOISE = "CASE split WHEN 'train' THEN 'clean' WHEN 'val' THEN 'gaussian' ELSE 'uniform' END"
_LEVEL = "CASE split WHEN 'train' THEN CAST(0 AS DOUBLE) WHEN 'val' THEN CAST(0.1 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END"


@query(
    f"""WITH pr AS ({views.predictions('duck')}), a AS (SELECT {_NOISE} AS noise_type, {_LEVEL} AS noise_intensity, model, avg(CAST(true_class = predicted_class AS DOUBLE)) AS test_accuracy FROM pr GROUP BY ALL), b AS (SELECT model, test_accuracy AS baseline_accuracy FROM a WHERE noise_type = 'clean')
    SELECT noise_type, noise_intensity, model, round(test_accuracy, 8) AS test_accuracy, round(baseline_accuracy, 8) AS baseline_accuracy, round(baseline_accuracy - test_accuracy, 8) AS accuracy_drop, round(CASE WHEN baseline_accuracy = 0 THEN 0 ELSE 100 * ((baseline_accuracy - test_accuracy) / baseline_accuracy) END, 6) AS relative_drop_percent FROM a JOIN b USING (model)"""
)
def robustness_drop(spark, sf):
    p = _predictions(spark, sf).withColumns({"noise_type": F.expr(_NOISE), "noise_intensity": F.expr(_LEVEL)})
    results = metrics.accuracy(p, ["noise_type", "noise_intensity", "model"]).withColumnRenamed("accuracy", "test_accuracy").drop("n")
    out = _rounded(experiments.robustness_drop(results), ["test_accuracy", "baseline_accuracy", "accuracy_drop"])
    return _rounded(out, ["relative_drop_percent"], 6)


_SWEEP_SQL = f"""pr AS (SELECT *, id % 5 AS parameter_value FROM ({views.predictions('duck')})), a AS (SELECT model AS experiment, parameter_value, split, avg(CAST(true_class = predicted_class AS DOUBLE)) AS accuracy FROM pr GROUP BY ALL),
    s AS (SELECT experiment, parameter_value, max(accuracy) FILTER (split = 'train') AS train_accuracy, max(accuracy) FILTER (split = 'val') AS val_accuracy, max(accuracy) FILTER (split = 'test') AS test_accuracy FROM a GROUP BY ALL),
    w AS (SELECT *, train_accuracy - val_accuracy AS train_val_gap, train_accuracy - test_accuracy AS train_test_gap FROM s)"""
_SWEEP = ["train_accuracy", "val_accuracy", "test_accuracy", "train_val_gap", "train_test_gap"]


def _sweep(spark, sf) -> DataFrame:
    p = _predictions(spark, sf).withColumns({"experiment": F.col("model"), "parameter_value": F.col("id") % 5})
    return experiments.sweep_gaps(metrics.accuracy(p, ["experiment", "parameter_value", "split"]), ["experiment", "parameter_value"])


@query(f"WITH {_SWEEP_SQL} SELECT experiment, parameter_value, {_R(_SWEEP)} FROM w")
def sweep_gaps(spark, sf):
    return _rounded(_sweep(spark, sf), _SWEEP)


@query(
    f"""WITH {_SWEEP_SQL}, b AS (SELECT experiment, parameter_value AS best_parameter, round(val_accuracy, 8) AS best_val_accuracy FROM w QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY val_accuracy DESC NULLS LAST, test_accuracy DESC NULLS LAST, parameter_value) = 1),
    g AS (SELECT experiment, parameter_value AS gap_parameter, round(train_test_gap, 8) AS largest_gap FROM w QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY train_test_gap DESC NULLS LAST, parameter_value) = 1) SELECT * FROM b JOIN g USING (experiment)"""
)
def best_rows(spark, sf):
    return _rounded(experiments.best_rows(_sweep(spark, sf)), ["best_val_accuracy", "largest_gap"])


_HISTORY = "SELECT event_type AS model, event_id % 40 AS epoch, round(avg(value) / 500, 6) AS val_accuracy FROM events GROUP BY event_type, event_id % 40"


@query(f"WITH h AS ({_HISTORY}) SELECT model, epoch, val_accuracy FROM h QUALIFY row_number() OVER (PARTITION BY model ORDER BY val_accuracy DESC, epoch) = 1")
def best_epoch(spark, sf):
    return experiments.best_epoch(views.load(spark, sf, _HISTORY))


@query(
    """WITH t AS (SELECT event_type AS model, value AS seconds FROM events), s AS (SELECT model, count(*) AS repeats, avg(seconds) AS mean, median(seconds) AS median, min(seconds) AS min, max(seconds) AS max FROM t GROUP BY model),
    r AS (SELECT model, seconds, row_number() OVER (PARTITION BY model ORDER BY seconds) - 1 AS i FROM t), p AS (SELECT r.model, r.seconds AS p95 FROM r JOIN s ON r.model = s.model AND i = greatest(0, CAST(floor(CAST(0.95 AS DOUBLE) * repeats) AS BIGINT) - 1))
    SELECT model, repeats, round(mean, 6) AS mean, round(median, 6) AS median, min, max, p95, round(1000 * mean / 2737, 6) AS ms_per_sample, round(2737 / mean, 6) AS samples_per_second FROM s JOIN p USING (model)"""
)
def latency_summary(spark, sf):
    timings = views.load(spark, sf, "SELECT event_type AS model, value AS seconds FROM events")
    return _rounded(experiments.latency_summary(timings, 2737), ["mean", "median", "ms_per_sample", "samples_per_second"], 6)

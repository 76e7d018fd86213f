"""Registered queries: sources, cleaning, features, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import scalars
from tabloom.operators import cleaning, features
from tabloom.plans import views
from tabloom.plans.views import DIRTY_SPEC as SPEC
from tabloom.sources import tables
from tabloom.spec import LOG_COLUMNS, SHAPES

NUM = SPEC.numeric
SIG = [*NUM, "class"]
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _dirty(spark: SparkSession, sf: str) -> DataFrame:
    return views.load(spark, sf, views.dirty("spark"))


def _shapes(spark: SparkSession, sf: str) -> DataFrame:
    return views.load(spark, sf, views.shapes("spark"))


# --- SQL of the cleaning steps ------------------------------------------------------------------


def _parse_sql(c: str) -> tuple[str, str]:
    """(value, issue) of a text column for DuckDB."""
    t = f"trim(coalesce({c}, ''))"
    missing = f"upper({t}) IN ({', '.join(repr(m) for m in scalars.MISSING)})"
    number, unit = (f"regexp_matches({t}, '{p}')" for p in (scalars.NUMBER, scalars.WITH_UNIT))
    odd = f"regexp_matches({t}, '{scalars.NOT_FINITE}')"
    plain = f"try_cast(replace({t}, '_', '') AS DOUBLE)"
    united = f"try_cast(regexp_extract({t}, '{scalars.WITH_UNIT}', 1) AS DOUBLE)"
    ok = lambda v: f"coalesce(isfinite({v}), false)"
    value = f"CASE WHEN {missing} THEN NULL WHEN {number} AND {ok(plain)} THEN {plain} WHEN {unit} AND {ok(united)} AND NOT {odd} THEN {united} END"
    issue = f"CASE WHEN {missing} THEN 'missing_token' WHEN {number} AND {ok(plain)} THEN NULL WHEN {number} OR {odd} THEN 'not_finite' WHEN {unit} AND {ok(united)} THEN 'removed_unit_' || lower(regexp_extract({t}, '{scalars.WITH_UNIT}', 2)) WHEN {unit} THEN 'not_finite' ELSE 'not_numeric' END"  # noqa: E501
    return value, issue


_LABEL = "translate(upper(trim(coalesce(class, ''))), '30', 'EO')"
_OK = f"{_LABEL} IN ({', '.join(repr(x) for x in SPEC.labels)})"
_P = {c: _parse_sql(c) for c in NUM}
#: dirty -> parsed -> signs -> positive -> ratio -> cap -> cross -> medians -> imputed -> once -> clean
CLEAN_SQL = f"""
WITH dirty AS ({views.dirty("duck")}),
parsed AS (SELECT source_row, split, CASE WHEN {_OK} THEN {_LABEL} ELSE '' END AS class,
  [CASE WHEN NOT {_OK} THEN 'invalid_class' WHEN {_LABEL} <> coalesce(class, '') THEN 'class_normalized' END, {", ".join(f"'{c}:' || ({_P[c][1]})" for c in NUM)}] AS i0,
  {", ".join(f"{_P[c][0]} AS {c}" for c in NUM)} FROM dirty),
signs AS (SELECT * REPLACE (abs(area) AS area), CASE WHEN area < 0 THEN 'area:negative_to_abs' END AS i1 FROM parsed),
positive AS (SELECT * REPLACE ({", ".join(f"CASE WHEN {c} > 0 THEN {c} END AS {c}" for c in NUM)}),
  [{", ".join(f"CASE WHEN {c} <= 0 THEN '{c}:non_positive_to_missing' END" for c in NUM)}] AS i2 FROM signs),
ratios AS (SELECT * REPLACE (CASE WHEN ratio <= 1 THEN ratio END AS ratio), CASE WHEN ratio > 1 THEN 'ratio:outside_0_1_to_missing' END AS i3 FROM positive),
caps AS (SELECT * REPLACE (CASE WHEN major <= 1000 THEN major END AS major), CASE WHEN major > 1000 THEN 'major:gt_1000_to_missing' END AS i4 FROM ratios),
crossed AS (SELECT * REPLACE (CASE WHEN area > convex THEN NULL ELSE area END AS area), CASE WHEN area > convex THEN 'area:greater_than_convex_to_missing' END AS i5 FROM caps),
cleaned AS (SELECT source_row, split, {", ".join(NUM)}, class, list_filter(list_concat(i0, [i1], i2, [i3, i4, i5]), lambda x: x IS NOT NULL) AS issues FROM crossed),
medians AS (SELECT {", ".join(f"median({c}) AS m_{c}" for c in NUM)} FROM cleaned WHERE split = 'train'),
imputed AS (SELECT source_row, split, {", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in NUM)}, class,
  list_concat(issues, list_filter([{", ".join(f"CASE WHEN {c} IS NULL THEN '{c}:imputed_train_median' END" for c in NUM)}], lambda x: x IS NOT NULL)) AS issues FROM cleaned, medians),
once AS (SELECT * FROM imputed QUALIFY row_number() OVER (PARTITION BY split, {", ".join(SIG)} ORDER BY source_row) = 1),
clean AS (SELECT * FROM once o WHERE split <> 'train' OR NOT EXISTS (SELECT 1 FROM once e WHERE e.split <> 'train' AND {" AND ".join(f"e.{c} = o.{c}" for c in SIG)}))
"""
_ROW = ["source_row", "split", *SIG]


def _issues(df: DataFrame) -> DataFrame:
    return df.withColumn("issues", F.array_join(F.array_sort("issues"), ","))


_ISSUES = "array_to_string(list_sort(issues), ',') AS issues"


def _sql(last: str) -> str:
    return CLEAN_SQL + last


# --- sources and sinks --------------------------------------------------------------------------

_RAW = ["class", *NUM]


def _as_csv(df: DataFrame, name: str) -> str:
    path = tables.scratch(df.sparkSession, name)
    df.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@query(f"WITH dirty AS ({views.dirty('duck')}) SELECT source_row, split, {', '.join(f"coalesce({c}, '') AS {c}" for c in _RAW)} FROM dirty")
def read_tag_union(spark, sf):
    raw = _dirty(spark, sf).select(F.col("source_row").cast("string").alias("row"), "split", *_RAW)
    parts = []
    for s in ("train", "val", "test"):
        path = _as_csv(raw.where(F.col("split") == s).drop("split"), f"raw-{s}")
        parts.append(tables.read_text_split(spark, path, s, ["row", *_RAW], row_column="row"))
    return tables.append_splits(parts).select("source_row", "split", *[F.coalesce(c, F.lit("")).alias(c) for c in _RAW])


#: Events as text whose fields hold quotes, separators and line ends, in order of id.
_QUOTED = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'two' || chr(10) || 'lines, "' || event_type || '"' WHEN 1 THEN chr(10) || chr(10) WHEN 2 THEN '"' WHEN 3 THEN NULL ELSE event_type END AS note,
      CASE WHEN event_id % 3 = 0 THEN ' ",' || chr(10) || CAST(event_id AS STRING) || '"' ELSE CAST(event_id AS STRING) END AS name FROM events"""


@query(f"SELECT CAST(row_number() OVER (ORDER BY event_id) + 1 AS BIGINT) AS source_row, 'train' AS split, CAST(event_id AS STRING) AS row, coalesce(note, '') AS note, name FROM ({_QUOTED})")
def read_quoted_lines(spark, sf):
    """Records that span lines keep their number, over all files that hold the split."""
    rows = views.load(spark, sf, _QUOTED).select(F.col("event_id").alias("row"), "note", "name")
    ordered = rows.repartitionByRange(8, "row").sortWithinPartitions("row")
    path = tables.scratch(spark, "quoted")
    ordered.write.options(header=True, escape='"', quoteAll=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    back = tables.read_text_split(spark, path, "train", ["row", "note", "name"])
    return back.select("source_row", "split", "row", F.coalesce("note", F.lit("")).alias("note"), "name")


@query(f"WITH s AS ({views.shapes('duck')}) SELECT split, count(*) AS n, round(avg(Area), 6) AS mean_area, min(Class) AS first_class FROM s GROUP BY split")
def typed_feature_read(spark, sf):
    text = _shapes(spark, sf).drop("id").withColumns({c: F.col(c).cast("string") for c in SHAPES.numeric})
    typed = tables.typed_features(text, "Class", keep=["split"])
    return typed.groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg("Area"), 6).alias("mean_area"), F.min("Class").alias("first_class"))


@query(f"WITH s AS ({views.shapes('duck')}) SELECT split, count(*) AS n, {len(SHAPES.numeric)} AS features FROM s GROUP BY split")
def schema_contract(spark, sf):
    shapes = _shapes(spark, sf).drop("id")
    parts = {s: shapes.where(F.col("split") == s).drop("split") for s in ("train", "val", "test")}
    n = len(tables.same_features(parts, "Class"))
    return tables.with_split(parts, "Class").groupBy("split").agg(F.count("*").alias("n"), F.lit(n).alias("features"))


@query(f"WITH s AS ({views.shapes('duck')}), st AS (SELECT avg(Area) AS m, stddev_pop(Area) AS sd FROM s WHERE split = 'train') SELECT 'raw' AS variant, split, count(*) AS n, round(sum(abs(Area)), 4) AS total FROM s GROUP BY split UNION ALL SELECT 'standardized', split, count(*), round(sum(abs((Area - m) / sd)), 4) FROM s, st GROUP BY split")
def variant_union(spark, sf):
    raw = _shapes(spark, sf)
    std = features.standardize(raw, features.standard_stats(raw, SHAPES.numeric), SHAPES.numeric)
    paths = {}
    for variant, df in (("raw", raw), ("standardized", std)):
        paths[variant] = tables.scratch(spark, variant)
        tables.write_splits(df, paths[variant], [*SHAPES.numeric, "Class"])
    both = tables.append_splits([spark.read.parquet(p).withColumn("variant", F.lit(v)) for v, p in paths.items()])
    return both.groupBy("variant", "split").agg(F.count("*").alias("n"), F.round(F.sum(F.abs("Area")), 4).alias("total"))


@query(_sql(f"SELECT split, {', '.join(SIG)} FROM clean"))
def write_splits_roundtrip(spark, sf):
    rows, _ = cleaning.clean_pipeline(_dirty(spark, sf), SPEC)
    path = tables.scratch(spark, "clean")
    tables.write_splits(rows.withColumn("_helper", F.lit(1)), path, [*SIG, "_helper"])
    return spark.read.parquet(path).select("split", *SIG)


# --- cleaning -----------------------------------------------------------------------------------


@query(f"WITH dirty AS ({views.dirty('duck')}) SELECT source_row, {_LABEL} AS class FROM dirty")
def normalize_class(spark, sf):
    return _dirty(spark, sf).select("source_row", scalars.normalize_class(F.col("class")).alias("class"))


@query(f"WITH dirty AS ({views.dirty('duck')}) SELECT CASE WHEN {_OK} THEN {_LABEL} ELSE '' END AS class, CASE WHEN NOT {_OK} THEN 'invalid_class' WHEN {_LABEL} <> class THEN 'class_normalized' END AS issue, count(*) AS n FROM dirty GROUP BY ALL")
def validate_class(spark, sf):
    return cleaning.validate_class(_dirty(spark, sf), SPEC).groupBy("class", "issue").agg(F.count("*").alias("n"))


@query(f"WITH dirty AS ({views.dirty('duck')}) " + " UNION ALL ".join(f"SELECT source_row, '{c}' AS col, {_P[c][0]} AS value, {_P[c][1]} AS issue FROM dirty" for c in NUM))
def parse_numeric(spark, sf):
    one = lambda c: F.struct(F.lit(c).alias("col"), scalars.parse_numeric(F.col(c)).alias("p"))
    long = _dirty(spark, sf).select("source_row", F.explode(F.array(*map(one, NUM))).alias("x"))
    return long.select("source_row", "x.col", "x.p.value", "x.p.issue")


def _with_issue(spark, sf, pattern):
    rows = tables.kept(cleaning.clean_rows(_dirty(spark, sf), SPEC), "cleaned")  # else the filter goes below the rules and parses all again
    return _issues(rows.where(F.exists("issues", lambda i: i.rlike(pattern)))).select(*_ROW, "issues")


def _where_issue(pattern):
    return _sql(f"SELECT {', '.join(_ROW)}, {_ISSUES} FROM cleaned WHERE len(list_filter(issues, lambda x: regexp_matches(x, '{pattern}'))) > 0")


@query(_where_issue("negative_to_abs"))
def sign_repair(spark, sf):
    return _with_issue(spark, sf, "negative_to_abs")


@query(_where_issue("non_positive|outside_0_1|gt_1000"))
def range_rules(spark, sf):
    return _with_issue(spark, sf, "non_positive|outside_0_1|gt_1000")


@query(_where_issue("greater_than_convex"))
def cross_column_rule(spark, sf):
    return _with_issue(spark, sf, "greater_than_convex")


@query(_sql(f"SELECT {', '.join(_ROW)}, {_ISSUES} FROM cleaned"))
def clean_rows(spark, sf):
    return _issues(cleaning.clean_rows(_dirty(spark, sf), SPEC)).select(*_ROW, "issues")


@query(_sql(f"SELECT {', '.join(f'm_{c} AS {c}' for c in NUM)} FROM medians"))
def train_medians(spark, sf):
    return cleaning.train_medians(tables.kept(cleaning.clean_rows(_dirty(spark, sf), SPEC), "cleaned"), NUM)


def _imputed(spark, sf):
    rows = tables.kept(cleaning.clean_rows(_dirty(spark, sf), SPEC), "cleaned")
    return cleaning.impute_train_median(rows, cleaning.train_medians(rows, NUM), NUM)


@query(_sql(f"SELECT {', '.join(_ROW)}, {_ISSUES} FROM imputed"))
def impute_train_median(spark, sf):
    return _issues(_imputed(spark, sf)).select(*_ROW, "issues")


@query(_sql(f"SELECT {', '.join(_ROW)} FROM once"))
def dedup_within_split(spark, sf):
    return cleaning.dedup_within_split(_imputed(spark, sf), SIG).select(_ROW)


@query(_sql(f"SELECT {', '.join(_ROW)} FROM clean"))
def leakage_anti_join(spark, sf):
    return cleaning.leakage_anti_join(cleaning.dedup_within_split(_imputed(spark, sf), SIG), SIG).select(_ROW)


@query(_sql("SELECT split, issue, count(*) AS n FROM (SELECT split, unnest(issues) AS issue FROM imputed) GROUP BY ALL ORDER BY n DESC, split, issue"))
def issue_audit(spark, sf):
    return cleaning.issue_audit(_imputed(spark, sf)).orderBy(F.desc("n"), "split", "issue")


@query(_sql("SELECT split, a.n AS rows_in, b.n AS rows_out FROM (SELECT split, count(*) AS n FROM dirty GROUP BY split) a JOIN (SELECT split, count(*) AS n FROM clean GROUP BY split) b USING (split)"))
def row_accounting(spark, sf):
    raw = _dirty(spark, sf)
    rows, _ = cleaning.clean_pipeline(raw, SPEC)
    count = lambda df, name: df.groupBy("split").agg(F.count("*").alias(name))
    return count(raw, "rows_in").join(count(rows, "rows_out"), "split")


@query(_sql("SELECT split, class, count(*) AS n FROM clean GROUP BY ALL UNION ALL SELECT 'all', class, count(*) FROM clean GROUP BY class"))
def class_distribution(spark, sf):
    rows, _ = cleaning.clean_pipeline(_dirty(spark, sf), SPEC)
    return cleaning.class_distribution(rows, "class")


@query(_sql(f"SELECT {', '.join(_ROW)}, {_ISSUES} FROM clean"))
def clean_pipeline(spark, sf):
    rows, _ = cleaning.clean_pipeline(_dirty(spark, sf), SPEC)
    return _issues(rows).select(*_ROW, "issues")


# --- features -----------------------------------------------------------------------------------

_SD = lambda n, d: f"CASE WHEN {d} = 0 THEN 0 ELSE {n} / ({d}) END"
_T, _D, _G, _E = "(MajorAxisLength + MinorAxisLength)", "(MajorAxisLength - MinorAxisLength)", "(ConvexArea - Area)", "(pi() * MajorAxisLength * MinorAxisLength / 4)"
DERIVED_SQL = {
    "AspectRatio": "AspectRation", "AxisLengthSum": _T, "AxisLengthDiff": _D, "AxisLengthMean": f"{_T} / 2", "AxisDiffRatio": _SD(_D, _T),
    "MinorMajorRatio": _SD("MinorAxisLength", "MajorAxisLength"), "AreaPerPerimeter": _SD("Area", "Perimeter"), "AreaPerPerimeterSquared": _SD("Area", "Perimeter * Perimeter"),
    "PerimeterPerArea": _SD("Perimeter", "Area"), "AreaConvexRatio": _SD("Area", "ConvexArea"), "ConvexAreaGap": _G, "ConvexAreaGapRatio": _SD(_G, "ConvexArea"),
    "AreaEllipseRatio": _SD("Area", _E), "EquivDiameterMajorRatio": _SD("EquivDiameter", "MajorAxisLength"), "EquivDiameterMinorRatio": _SD("EquivDiameter", "MinorAxisLength"),
    "RoundnessSolidity": "roundness * Solidity", "CompactnessSolidity": "Compactness * Solidity", "ExtentSolidity": "Extent * Solidity", "EccentricityAspectRatio": "Eccentricity * AspectRation",
}
_DERIVED = ", ".join(f"{e} AS {n}" for n, e in DERIVED_SQL.items())
FEATURES_SQL = f"WITH s AS ({views.shapes('duck')}), f AS (SELECT *, {_DERIVED}, {', '.join(f'ln(1 + {c}) AS log_{c}' for c in LOG_COLUMNS)} FROM s)"
ALL_FEATURES = [*SHAPES.numeric, *DERIVED_SQL, *[f"log_{c}" for c in LOG_COLUMNS]]
_R = lambda cols, d=6: ", ".join(f"round({c}, {d}) AS {c}" for c in cols)


def _all(spark, sf):
    return features.log_features(features.engineer(_shapes(spark, sf)))


@query(f"{FEATURES_SQL} SELECT id, {_R(DERIVED_SQL)} FROM f")
def engineer_features(spark, sf):
    return features.engineer(_shapes(spark, sf)).select("id", *[F.round(c, 6).alias(c) for c in DERIVED_SQL])


@query(f"{FEATURES_SQL} SELECT id, {_R([f'log_{c}' for c in LOG_COLUMNS])} FROM f")
def log_features(spark, sf):
    return features.log_features(_shapes(spark, sf)).select("id", *[F.round(f"log_{c}", 6).alias(f"log_{c}") for c in LOG_COLUMNS])


@query(f"{FEATURES_SQL} SELECT unnest(range({len(ALL_FEATURES)})) AS position, unnest([{', '.join(map(repr, ALL_FEATURES))}]) AS feature, n FROM (SELECT count(*) AS n FROM f)")
def feature_catalog(spark, sf):
    df = _all(spark, sf)
    names = features.feature_names(df, ["id", "split", "Class"])
    rows = df.agg(F.count("*").alias("n"))
    return rows.select(F.posexplode(F.array(*map(F.lit, names))).alias("position", "feature"), "n").select(F.col("position").cast("long").alias("position"), "feature", "n")


@query(f"{FEATURES_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END, 6) AS std FROM f WHERE split = 'train'" for c in ALL_FEATURES))
def standardize_fit(spark, sf):
    df = _all(spark, sf)
    stats = features.standard_stats(df, ALL_FEATURES)
    one = lambda c: F.struct(F.lit(c).alias("feature"), F.round(f"mean_{c}", 6).alias("mean"), F.round(f"std_{c}", 6).alias("std"))
    return stats.select(F.inline(F.array(*map(one, ALL_FEATURES))))


@query(f"{FEATURES_SQL}, m AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in ALL_FEATURES)} FROM f WHERE split = 'train') SELECT id, split, {', '.join(f'round(({c} - m_{c}) / s_{c}, 5) + 0 AS {c}' for c in ALL_FEATURES)} FROM f, m")
def standardize_apply(spark, sf):
    df = tables.kept(_all(spark, sf), "features")
    out = features.standardize(df, features.standard_stats(df, ALL_FEATURES), ALL_FEATURES)
    return out.select("id", "split", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ALL_FEATURES])  # no negative zeros


_PAIRS = [(a, b) for i, a in enumerate(SHAPES.numeric) for b in SHAPES.numeric[i + 1 :]]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM f WHERE split = 'train'" for a, b in _PAIRS)


@query(f"{FEATURES_SQL} {_CORR}")
def correlation_matrix(spark, sf):
    return features.correlations(_shapes(spark, sf).where("split = 'train'"), SHAPES.numeric).withColumn("r", F.round("r", 6))


#: Columns with gaps: each is null in rows of its own, and one doesn't vary where another is there.
_GAPPY = tuple(SHAPES.numeric[:8])
_GAPS_SQL = "SELECT " + ", ".join(f"CASE WHEN id % {i + 3} <> {i} THEN {c} END AS {c}" for i, c in enumerate(_GAPPY)) + ", CASE WHEN id % 2 = 0 THEN 7 WHEN id % 3 = 0 THEN CAST(id AS DOUBLE) END AS even, CASE WHEN id % 2 = 0 THEN CAST(id % 11 AS DOUBLE) END AS sparse FROM s WHERE split = 'train'"
_GAP_PAIRS = [(a, b) for i, a in enumerate((*_GAPPY, "even", "sparse")) for b in (*_GAPPY, "even", "sparse")[i + 1 :]]
_BOTH = "FILTER ({0} IS NOT NULL AND {1} IS NOT NULL)"


def _gap_sql(a: str, b: str) -> str:
    varies = " AND ".join(f"min({c}) {_BOTH.format(a, b)} < max({c}) {_BOTH.format(a, b)}" for c in (a, b))
    return f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN {varies} THEN round(corr({a}, {b}), 6) END AS r FROM g"


@query(f"WITH s AS ({views.shapes('duck')}), g AS MATERIALIZED ({_GAPS_SQL}) " + " UNION ALL ".join(_gap_sql(a, b) for a, b in _GAP_PAIRS))
def correlation_with_gaps(spark, sf):
    gappy = spark.sql(_GAPS_SQL.replace("FROM s", "FROM {s}"), s=_shapes(spark, sf))
    return features.correlations(gappy, (*_GAPPY, "even", "sparse")).withColumn("r", F.round("r", 6))


def _greedy_sql(last: str) -> str:
    """The walk over the columns as a recursion: each is kept unless a kept one before it qualifies."""
    cols = SHAPES.numeric
    return f"""WITH RECURSIVE {FEATURES_SQL.removeprefix("WITH ")}, c AS MATERIALIZED ({_CORR}),
    n AS (SELECT unnest(range({len(cols)})) AS i, unnest([{", ".join(map(repr, cols))}]) AS name),
    p AS (SELECT i, name, (SELECT list(a) FROM c WHERE b = name AND abs(r) >= 0.95) AS near FROM n),
    w AS (SELECT CAST(0 AS BIGINT) AS i, ['{cols[0]}'] AS kept, CAST([] AS VARCHAR[]) AS hit, '' AS name
          UNION ALL SELECT p.i, CASE WHEN len(list_filter(w.kept, lambda x: list_contains(coalesce(p.near, []), x))) = 0 THEN list_append(w.kept, p.name) ELSE w.kept END,
            list_filter(w.kept, lambda x: list_contains(coalesce(p.near, []), x)), p.name FROM w JOIN p ON p.i = w.i + 1),
    kept AS (SELECT unnest(kept) AS kept FROM w WHERE i = {len(cols) - 1}),
    dropped AS (SELECT name AS dropped, hit[1] AS kept FROM w WHERE len(hit) > 0) {last}"""


@query(_greedy_sql("SELECT dropped, kept, abs(r) AS abs_correlation FROM dropped JOIN c ON a = kept AND b = dropped"))
def greedy_corr_select(spark, sf):
    _, audit = features.select_uncorrelated(_shapes(spark, sf).where("split = 'train'"), SHAPES.numeric)
    return audit.withColumn("abs_correlation", F.round("abs_correlation", 6))


def _selected(spark, sf):
    shapes = _shapes(spark, sf)
    kept, _ = features.select_uncorrelated(shapes.where("split = 'train'"), SHAPES.numeric)
    return shapes.select("id", "split", "Class", *kept), kept


_LONG = f", l AS (UNPIVOT (SELECT id, split, Class, {', '.join(SHAPES.numeric)} FROM s) ON {', '.join(SHAPES.numeric)} INTO NAME feature VALUE value)"


@query(_greedy_sql(f"{_LONG} SELECT id, split, Class AS class, feature, round(value, 6) AS value FROM l JOIN kept ON kept = feature"))
def selected_projection(spark, sf):
    df, kept = _selected(spark, sf)
    return df.unpivot(["id", "split", "Class"], kept, "feature", "value").select("id", "split", F.col("Class").alias("class"), "feature", F.round("value", 6).alias("value"))


@query(_greedy_sql(f"{_LONG} SELECT split, feature, count(*) AS n, round(sum(value), 3) AS total FROM l JOIN kept ON kept = feature GROUP BY split, feature"))
def selected_roundtrip(spark, sf):
    df, kept = _selected(spark, sf)
    path = tables.scratch(spark, "selected")
    tables.write_splits(df, path, [*kept, "Class"])
    back = spark.read.parquet(path).unpivot(["split"], kept, "feature", "value")
    return back.groupBy("split", "feature").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query(f"WITH s AS ({views.shapes('duck')}) SELECT Class AS label, row_number() OVER (ORDER BY Class) - 1 AS code FROM (SELECT DISTINCT Class FROM s)")
def encode_labels(spark, sf):
    return features.label_codes(_shapes(spark, sf), "Class").select("label", F.col("code").cast("long").alias("code"))


@query(f"WITH s AS ({views.shapes('duck')}), c AS (SELECT Class AS label, count(*) AS n FROM s WHERE split = 'train' GROUP BY Class) SELECT label, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 8) AS weight FROM c")
def class_weights(spark, sf):
    return features.class_weights(_shapes(spark, sf), "Class").withColumn("weight", F.round("weight", 8))

"""Views over the given tables that the queries work on, as SQL text for Spark ("spark") and for DuckDB ("duck")."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.spec import TableSpec

DIRTY_SPEC = TableSpec(
    numeric=("area", "convex", "major", "ratio"), labels=("SIGNUP", "PURCHASE", "ERROR", "VIEW", "CLICK"), label="class",
    repair_sign=("area",), ratios=("ratio",), caps={"major": 1000.0}, at_most=(("area", "convex"),),
)
EVENT_LABELS = ("CLICK", "ERROR", "PURCHASE", "SIGNUP", "VIEW")
#: With a label that no row has.
LABELS = (*EVENT_LABELS[:2], "NEVER", *EVENT_LABELS[2:])
SPLIT = "CASE WHEN {0} % 10 < 7 THEN 'train' WHEN {0} % 10 = 7 THEN 'val' ELSE 'test' END"


def uniform_sql(engine: str, key: str) -> str:
    """The uniform number of functions.scalars.uniform for a key given as SQL text."""
    digest = f"substr(md5({key}), 1, 8)"
    number = f"CAST(conv({digest}, 16, 10) AS DOUBLE)" if engine == "spark" else f"CAST(CAST('0x' || {digest} AS BIGINT) AS DOUBLE)"
    return f"(({number} + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE))"


def dirty(engine: str) -> str:
    """Events as dirty text rows: source_row, split, class, area, convex, major, ratio; some rows twice."""
    return f"""
    WITH b AS (SELECT event_id AS source_row, {SPLIT.format("event_id")} AS split, CAST(value AS STRING) AS v,
      CASE WHEN event_id % 101 = 0 THEN 'UNKNOWN' WHEN event_id % 11 = 0 THEN '  ' || replace(replace(upper(event_type), 'E', '3'), 'O', '0') || ' '
           WHEN event_id % 11 = 1 THEN event_type ELSE upper(event_type) END AS class,
      CASE WHEN event_id % 23 = 0 THEN CAST(CAST(floor(value * 50) AS DOUBLE) / 100 AS STRING) ELSE CAST(CAST(floor(value * 125) AS DOUBLE) / 100 AS STRING) END AS convex,
      CAST(CAST(event_id * 37 % 1200 AS DOUBLE) / 1000 AS STRING) AS ratio FROM events),
    r AS (SELECT source_row, split, class,
      CASE source_row % 17 WHEN 0 THEN '?' WHEN 1 THEN ' na ' WHEN 2 THEN v || 'cm' WHEN 3 THEN v || ' KG' WHEN 4 THEN '-' || v WHEN 5 THEN 'inf' WHEN 6 THEN 'abc'
           WHEN 7 THEN '' WHEN 8 THEN '1_000' WHEN 9 THEN '1.0d' WHEN 10 THEN '0' WHEN 11 THEN '+nan' ELSE v END AS area,
      convex, CASE WHEN source_row % 29 = 0 THEN v || 'e4' ELSE v END AS major, ratio FROM b)
    SELECT * FROM r
    UNION ALL SELECT source_row + 10000000, split, class, area, convex, major, ratio FROM r WHERE source_row % 50 = 3
    UNION ALL SELECT source_row + 20000000, 'test', class, area, convex, major, ratio FROM r WHERE source_row % 100 = 3"""


def shapes(engine: str) -> str:
    """Events as sixteen shape measurements with id, split and Class."""
    part = lambda m, d: f"CAST(event_id % {m} AS DOUBLE) / {d}"
    return f"""
    WITH a AS (SELECT event_id AS id, {SPLIT.format("event_id")} AS split, upper(event_type) AS Class, value * 100 + 1 AS Area, (value * 100 + 1) * (1 + {part(13, 100)}) AS ConvexArea,
      sqrt(value * 100 + 1) * (CAST(1.2 AS DOUBLE) + {part(7, 10)}) AS MajorAxisLength, sqrt(value * 100 + 1) / (CAST(1.1 AS DOUBLE) + {part(5, 10)}) AS MinorAxisLength,
      CAST(0.5 AS DOUBLE) + {part(41, 100)} AS Extent FROM events),
    b AS (SELECT *, 2 * (MajorAxisLength + MinorAxisLength) AS Perimeter, sqrt(4 * Area / pi()) AS EquivDiameter FROM a)
    SELECT id, split, Area, Perimeter, MajorAxisLength, MinorAxisLength, MajorAxisLength / MinorAxisLength AS AspectRation,
      sqrt(1 - (MinorAxisLength / MajorAxisLength) * (MinorAxisLength / MajorAxisLength)) AS Eccentricity, ConvexArea, EquivDiameter, Extent,
      Area / ConvexArea AS Solidity, 4 * pi() * Area / (Perimeter * Perimeter) AS roundness, EquivDiameter / MajorAxisLength AS Compactness,
      MajorAxisLength / Area AS ShapeFactor1, MinorAxisLength / Area AS ShapeFactor2, Area / (MajorAxisLength * MajorAxisLength * pi() / 4) AS ShapeFactor3,
      Area / (MajorAxisLength * MinorAxisLength * pi() / 4) AS ShapeFactor4, Class FROM b"""


def vectors(engine: str, dims: int | None = None) -> str:
    """Embeddings as id, split, label (L0 ...), code and features (the first dims)."""
    doubles = "CAST(embedding AS ARRAY<DOUBLE>)" if engine == "spark" else "CAST(embedding AS DOUBLE[])"
    if dims:
        doubles = f"slice({doubles}, 1, {dims})" if engine == "spark" else f"({doubles})[1:{dims}]"
    return f"SELECT vec_id AS id, {SPLIT.format('vec_id')} AS split, 'L' || label AS label, label AS code, {doubles} AS features FROM embeddings"


def wide_vectors(engine: str, dims: int = 16) -> str:
    cols = ", ".join(f"CAST(embedding[{i if engine == 'spark' else i + 1}] AS DOUBLE) AS f{i}" for i in range(dims))
    return f"SELECT vec_id AS id, {SPLIT.format('vec_id')} AS split, 'L' || label AS label, {cols} FROM embeddings"


def predictions(engine: str) -> str:
    """Three models of rising error over the events: id, split, model, true_class, predicted_class."""
    following = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(EVENT_LABELS, EVENT_LABELS[1:] + EVENT_LABELS[:1], strict=True))
    u = uniform_sql(engine, "CAST(event_id AS STRING) || ':' || model || ':7'")
    return f"""
    WITH m AS (SELECT event_id, upper(event_type) AS t, model, err FROM events CROSS JOIN (VALUES ('A', CAST(0.1 AS DOUBLE)), ('B', CAST(0.2 AS DOUBLE)), ('C', CAST(0.3 AS DOUBLE))) AS x(model, err))
    SELECT event_id AS id, {SPLIT.format("event_id")} AS split, model, t AS true_class, CASE WHEN {u} < err THEN CASE t {following} END ELSE t END AS predicted_class FROM m"""


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "labels")


def load(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A view's SQL text over the tables of sf_dir."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in view}
    for t in used:
        view = view.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(view, **used)


def label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LABELS as a table, from the event types there are and one that never occurs."""
    types = load(spark, sf_dir, "SELECT DISTINCT upper(event_type) AS label FROM events")
    return types.unionByName(spark.range(1).selectExpr("'NEVER' AS label")).distinct()

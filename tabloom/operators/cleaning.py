"""Cleaning of dirty labelled rows: rules with an issue audit, imputation, duplicates and leakage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalars import normalize_class, parse_numeric
from tabloom.operators import selection
from tabloom.sources.tables import kept
from tabloom.spec import TableSpec


class _Stages:
    """Rules that see what earlier rules left; each adds its issue to the row's list."""

    def __init__(self, df: DataFrame):
        self.df, self.issues = df, []

    def step(self, changes: dict[str, tuple[Column, Column]]) -> None:
        """column -> (new value, issue or null), all computed from the values before this step."""
        names = {c: f"__issue{len(self.issues) + i}" for i, c in enumerate(changes)}
        self.issues += names.values()
        self.df = self.df.withColumns({names[c]: issue for c, (_, issue) in changes.items()} | {c: value for c, (value, _) in changes.items()})

    def null_where(self, bad: dict[str, Column], why: str) -> None:
        self.step({c: (F.when(~b | b.isNull(), F.col(c)), F.when(b, f"{c}:{why}")) for c, b in bad.items()})


def validate_class(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The label normalised, empty where it is none of the allowed, with `issue`."""
    new = normalize_class(F.col(spec.label))
    ok = new.isin(*spec.labels)
    issue = F.when(~ok, "invalid_class").when(new != F.coalesce(spec.label, F.lit("")), "class_normalized")
    return df.withColumns({"issue": issue, spec.label: F.when(ok, new).otherwise("")})


def clean_rows(df: DataFrame, spec: TableSpec, keep: Sequence[str] = ("split", "source_row")) -> DataFrame:
    """keep, the numeric columns as double, the label, and issues (array): every row stays."""
    parsed = {f"__parsed_{c}": parse_numeric(F.col(c)) for c in spec.numeric}
    marked = validate_class(df, spec)
    s = _Stages(marked.withColumns(parsed))
    s.issues.append("issue")
    s.step({c: (F.col(f"__parsed_{c}.value"), F.concat(F.lit(f"{c}:"), F.col(f"__parsed_{c}.issue"))) for c in spec.numeric})
    s.step({c: (F.abs(F.col(c)), F.when(F.col(c) < 0, f"{c}:negative_to_abs")) for c in spec.repair_sign})
    s.null_where({c: F.col(c) <= 0 for c in spec.numeric}, "non_positive_to_missing")
    s.null_where({c: ~((F.col(c) > 0) & (F.col(c) <= 1)) for c in spec.ratios}, "outside_0_1_to_missing")
    for c, most in spec.caps.items():
        s.null_where({c: F.col(c) > most}, f"gt_{most:g}_to_missing")
    for a, b in spec.at_most:
        s.null_where({a: F.col(a) > F.col(b)}, f"greater_than_{b.lower()}_to_missing")
    return s.df.select(*keep, *spec.numeric, spec.label, F.array_compact(F.array(*s.issues)).alias("issues"))


def train_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the exact median of each column over the non-null values of split train. df is read once a round of
    selection.medians, so a derived df should be written first."""
    found = selection.medians(df.where("split = 'train'"), columns)
    return df.sparkSession.createDataFrame([tuple(found[c] for c in columns)], ", ".join(f"`{c}` double" for c in columns))


def require_values(medians: DataFrame) -> DataFrame:
    """medians, or an error where a column had no training value."""
    if empty := [c for c, v in medians.first().asDict().items() if v is None]:
        raise ValueError(f"no training values: {', '.join(empty)}")
    return medians


def impute_train_median(df: DataFrame, medians: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls replaced by the medians (one row); each replacement is an issue."""
    m = F.broadcast(medians.select(*[F.col(c).alias(f"__median_{c}") for c in columns]))
    added = F.array_compact(F.array(*[F.when(F.col(c).isNull(), f"{c}:imputed_train_median") for c in columns]))
    out = df.crossJoin(m).withColumn("issues", F.concat("issues", added))
    return out.withColumns({c: F.coalesce(c, f"__median_{c}") for c in columns}).select(df.columns)


def dedup_within_split(df: DataFrame, signature: Sequence[str]) -> DataFrame:
    """The first row, by source_row, of each signature and split. Partial sums first: a hot signature is no hot task."""
    rest = [c for c in df.columns if c not in (*signature, "split")]
    first = F.min(F.struct("source_row", *[c for c in rest if c != "source_row"])).alias("first")
    return df.groupBy("split", *signature).agg(first).select(*["first." + c if c in rest else c for c in df.columns])


def leakage_anti_join(df: DataFrame, signature: Sequence[str]) -> DataFrame:
    """Without the training rows whose signature another split has; nulls match nulls."""
    held = df.where("split <> 'train'")
    seen = held.select(*[F.col(c).alias(f"__{c}") for c in signature]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in signature]
    return df.where("split = 'train'").join(seen, same, "left_anti").unionByName(held)


def issue_audit(df: DataFrame) -> DataFrame:
    return df.select("split", F.explode("issues").alias("issue")).groupBy("split", "issue").agg(F.count("*").alias("n"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows by split and class, and over all splits as split 'all'."""
    named = df.select(F.col(label).alias("label"), F.col("split").alias("part"))
    by = named.rollup("label", "part").agg(F.count("*").alias("n"), F.grouping("part").alias("no_part"), F.grouping("label").alias("no_label"))
    return by.where("no_label = 0").select(F.when(F.col("no_part") == 1, "all").otherwise(F.col("part")).alias("split"), F.col("label").alias("class"), "n")


def clean_pipeline(raw: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """(clean rows, imputed rows with all issues): rules, medians over train before duplicates go, duplicates, leakage."""
    cleaned = kept(clean_rows(raw, spec), "cleaned")  # parsed once, read by the medians and the rows
    imputed = impute_train_median(cleaned, train_medians(cleaned, spec.numeric), spec.numeric)
    signature = [*spec.numeric, spec.label]
    once = kept(dedup_within_split(imputed, signature), "once")
    return leakage_anti_join(once, signature), imputed

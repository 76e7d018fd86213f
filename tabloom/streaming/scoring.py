"""Row rules with fitted parameters on a stream: the same expressions as on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.cleaning import clean_rows
from tabloom.spec import TableSpec


def clean_stream(raw: DataFrame, spec: TableSpec, medians: dict[str, float]) -> DataFrame:
    """Cleaned and imputed rows of a streaming DataFrame; medians were fitted on a table before."""
    rows = clean_rows(raw, spec)
    filled = F.array_compact(F.array(*[F.when(F.col(c).isNull(), f"{c}:imputed_train_median") for c in spec.numeric]))
    out = rows.withColumn("issues", F.concat("issues", filled))
    return out.withColumns({c: F.coalesce(c, F.lit(float(medians[c]))) for c in spec.numeric})


def standardize_stream(rows: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """z-scores with fitted (mean, std) of each column."""
    return rows.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})

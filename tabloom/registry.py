"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabloom.plans import cleaning, models, reports, robustness

Query = Callable[[SparkSession, str], DataFrame]
_PLANS = (cleaning, models, reports, robustness)


def queries() -> dict[str, Query]:
    return {name: f for plan in _PLANS for name, f in plan.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _PLANS for name, sql in plan.SQL.items()}

"""Column functions: labels and numbers from dirty text, guarded arithmetic, portable random numbers, arrays."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as missing, compared in upper case.
MISSING = ("", "?", "NA", "N/A", "NULL", "NONE", "NAN")
NUMBER = r"^[-+]?(?:[0-9]+(?:_[0-9]+)*(?:\.(?:[0-9]+(?:_[0-9]+)*)?)?|\.[0-9]+(?:_[0-9]+)*)(?:[eE][-+]?[0-9]+(?:_[0-9]+)*)?$"
NOT_FINITE = r"(?i)^[-+]?(?:inf|infinity|nan)$"
#: Fixed value: the grammar of a number with a unit, which decides what counts as one.
WITH_UNIT = r"^([-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)\s*([A-Za-z]+)$"


def strip(c: Column) -> Column:
    """Without white space at the ends; null as empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def normalize_class(c: Column) -> Column:
    """Stripped, upper case, 3 read as E and 0 as O; null as empty."""
    return F.translate(F.upper(strip(c)), "30", "EO")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def parse_numeric(c: Column) -> Column:
    """struct(value, issue): the number a text holds, and why not or what was removed. Nothing raises.

    Each pattern is matched once and only where the ones before it fail."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))
    made = lambda value, issue: F.struct(value.cast("double").alias("value"), issue.cast("string").alias("issue"))
    none = F.lit(None)

    def other(text: Column) -> Column:
        def with_unit(part: Column) -> Column:
            value = F.regexp_replace(part, r"\s*[A-Za-z]+$", "").try_cast("double")
            removed = F.concat(F.lit("removed_unit_"), F.lower(F.regexp_extract(part, "[A-Za-z]+$", 0)))
            return F.when(part == "", made(none, F.lit("not_numeric"))).otherwise(_once(value, lambda v: F.when(finite(v), made(v, removed)).otherwise(made(none, F.lit("not_finite")))))

        return F.when(text.rlike(NOT_FINITE), made(none, F.lit("not_finite"))).otherwise(_once(F.regexp_extract(text, WITH_UNIT, 0), with_unit))

    def parsed(text: Column) -> Column:
        plain = F.regexp_replace(text, "_", "").try_cast("double")
        number = _once(plain, lambda v: F.when(finite(v), made(v, none)).otherwise(made(none, F.lit("not_finite"))))
        return F.when(F.upper(text).isin(*MISSING), made(none, F.lit("missing_token"))).when(text.rlike(NUMBER), number).otherwise(other(text))

    return _once(strip(c), parsed)


def safe_divide(n: Column, d: Column) -> Column:
    """n / d, 0.0 where d is 0."""
    return F.when(d == 0, F.lit(0.0)).otherwise(n / d)


def uniform(key: Column, name: str | Column, seed: int | Column) -> Column:
    """A uniform number in (0, 1) that depends on key, name and seed alone, never on partitions."""
    part = lambda x: x.cast("string") if isinstance(x, Column) else F.lit(str(x))
    digest = F.md5(F.concat_ws(":", key.cast("string"), part(name), part(seed)))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def normal(key: Column, name: str, seed: int | Column) -> Column:
    """A standard normal number by Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(key, f"{name}.r", seed))) * F.cos(2 * math.pi * uniform(key, f"{name}.a", seed))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays, added from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def argmax(values: Column) -> Column:
    """Position from 0 of the largest element, the first where several are."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax(z: Column) -> Column:
    """Shares of an array of scores; the largest is taken off first."""
    top = F.array_max(z)
    e = F.transform(z, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))

"""Null, zero-denominator and sentinel rules.

Every helper returns a plain Spark ``Column`` built from built-in functions,
so it stays inside whole-stage codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the source files mark "no date" in DAYS_* columns with this day count.
DAYS_SENTINEL = 365243


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: str | Column, den: str | Column) -> Column:
    """a / b with null for a zero (or null) denominator — no inf, no error."""
    return F.try_divide(col_(num).cast("double"), col_(den).cast("double"))


def flag(pred: Column) -> Column:
    """0/1 integer flag; a null predicate counts as false."""
    return F.when(pred, F.lit(1)).otherwise(F.lit(0))


def sentinel_to_null(c: str | Column, sentinel=DAYS_SENTINEL) -> Column:
    return F.nullif(col_(c), F.lit(sentinel))


def floor_div(c: str | Column, d: int) -> Column:
    """pandas ``//``: rounds down, also for negatives."""
    return F.floor(col_(c) / F.lit(float(d)))


def is_null_flag(c: str | Column) -> Column:
    return col_(c).isNull().cast("int")


def not_null_flag(c: str | Column) -> Column:
    return col_(c).isNotNull().cast("int")

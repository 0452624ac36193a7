"""Portable rounding for engine-to-engine comparison.

Sums of doubles depend on the summation order, so two engines agree only up
to the last bits. ``round(x, 9)`` is not portable (decimal HALF_UP vs binary
rounding). Both sides round to the nearest 2^-20: here ``rint(x * 2^20) / 2^20``,
which stays a double (a ``floor`` to a long would clamp large values, infinity
and NaN), in the oracle ``floor(x * 2^20 + 0.5) / 2^20``. Scaling by a power
of two is exact, and a rational value with a small odd denominator (means of
counts, ratios of decimal amounts) never sits exactly on a binary half-step,
so an ulp of summation noise cannot flip the result the way it does at a
decimal 1e-6 step. Applied to every double column of a compared result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, FloatType

SCALE = 1048576.0  # 2^20


def portable_round(df: DataFrame) -> DataFrame:
    """One projection (one call into the JVM, whatever the width)."""
    exprs = []
    for field in df.schema.fields:
        q = "`" + field.name.replace("`", "``") + "`"
        if isinstance(field.dataType, (DoubleType, FloatType)):
            exprs.append(f"rint(CAST({q} AS DOUBLE) * {SCALE!r}D) / {SCALE!r}D AS {q}")
        else:
            exprs.append(q)
    return df.selectExpr(*exprs)

"""Target-rate and data-profile summaries (A1-A10, L1).

All of them are one aggregate pass. Totals used as denominators are scalar
subqueries (``DataFrame.scalar()``), never a cross join or a window over the
whole result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TARGET = "TARGET"


def target_rate_by(df: DataFrame, keys: str | Column | Sequence[str | Column], target: str = TARGET,
                   sort_by_rate: bool = False) -> DataFrame:
    """A1: ``groupby(k)[target].agg(count='count', default_rate='mean')``; null keys dropped."""
    keys = [keys] if isinstance(keys, (str, Column)) else list(keys)
    key_cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    out = df.groupBy(*key_cols).agg(
        F.count(target).alias("count"),
        F.avg(target).alias("default_rate"),
    )
    names = out.columns[: len(key_cols)]
    for n in names:
        out = out.where(F.col(n).isNotNull())
    if sort_by_rate:  # S4, with a tie-break on the key for a stable order
        out = out.orderBy(F.desc("default_rate"), *[F.asc(n) for n in names])
    return out


def missing_rates(df: DataFrame, features: Sequence[str], target: str = TARGET) -> DataFrame:
    """A3/A7 over several features in one pass.

    One row per (feature, is_missing): rows, default rate of the group, and
    the feature's missing share over all rows.
    """
    stacked = df.select(
        F.col(target),
        F.explode(F.array(*[
            F.struct(F.lit(f).alias("feature"), F.col(f).isNull().alias("is_missing")) for f in features
        ])).alias("s"),
    ).select("s.feature", "s.is_missing", target)
    out = stacked.groupBy("feature", "is_missing").agg(
        F.count(target).alias("count"),
        F.avg(target).alias("default_rate"),
        F.count(F.lit(1)).alias("rows"),
    )
    return out.select(
        "feature",
        F.col("is_missing").cast("int").alias("is_missing"),
        "count",
        "default_rate",
        (F.col("rows") / F.sum("rows").over(Window.partitionBy("feature"))).alias("share"),  # two rows a feature
    )


def value_counts(df: DataFrame, column: str, normalize: bool = False) -> DataFrame:
    """A4/A5: counts per value, nulls ignored (N14); ``normalize`` gives shares."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    if not normalize:
        return counted
    total = counted.select(F.sum("count")).scalar()  # of the grouped counts, not of the rows again
    return counted.select(column, (F.col("count") / total).alias("proportion"))


def value_counts_desc(df: DataFrame, column: str) -> DataFrame:
    """A5 ordered as ``value_counts()`` prints: count descending, ties by value."""
    return value_counts(df, column).orderBy(F.desc("count"), F.asc(column))


def null_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A6 + F2 + S4: (column, Count, pct) for columns with nulls, pct descending.

    One aggregate row holds all counts; it is unpivoted on the executors.
    """
    columns = list(columns or df.columns)
    wide = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(columns)],
    )
    long = wide.select(
        "__rows",
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("Count")) for i, c in enumerate(columns)
        ])).alias("s"),
    )
    return (
        long.select("s.column", "s.Count", (F.col("s.Count") * 100.0 / F.col("__rows")).alias("pct"))
        .where(F.col("Count") > 0)
        .orderBy(F.desc("pct"), F.asc("column"))
    )


def null_count(df: DataFrame, column: str) -> DataFrame:
    """A7."""
    return df.agg(F.count_if(F.col(column).isNull()).alias("null_count"))


def shape(df: DataFrame) -> DataFrame:
    """A10: (rows, columns) as one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def head(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """L1: the first ``n`` rows in a fixed order (top-k: a limit is the feature)."""
    return df.orderBy(*order_by).limit(n)


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact distinct non-null values per string column, as (column, nunique) rows."""
    columns = list(columns or string_columns(df))
    wide = df.agg(*[F.count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(columns)])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("nunique")) for i, c in enumerate(columns)
    ])).alias("s")).select("s.column", "s.nunique")


def column_minimums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum of every column, as (column, min) rows (doubles)."""
    wide = df.agg(*[F.min(F.col(c)).cast("double").alias(f"m{i}") for i, c in enumerate(columns)])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("min_value")) for i, c in enumerate(columns)
    ])).alias("s")).select("s.column", "s.min_value")


def non_negative_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Names of the columns whose minimum is >= 0 (one small row to the driver)."""
    mins = column_minimums(df, columns).collect()
    return [r["column"] for r in mins if r["min_value"] is not None and r["min_value"] >= 0]

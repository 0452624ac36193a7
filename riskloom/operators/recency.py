"""Per-group order: recency rank and the K first rows of each group.

The reference sorts a whole table and takes ``iloc[:K]`` per group. Here the
order lives in a window over the group key only, and the filter
``rank <= K`` lets Catalyst plan a *partial* ``WindowGroupLimit`` before the
shuffle: each map task forwards at most K rows per key, so a key holding a
third of all rows still moves only K rows per task and its final sort sees
K x (map tasks) rows, never the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_columns(order_by: Sequence[str], tie_break: Sequence[str] = (), descending: bool = True) -> list[Column]:
    cols = list(order_by) + [c for c in tie_break if c not in order_by]
    return [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in cols]


def recency_rank(df: DataFrame, key: str, order_by: Sequence[str], tie_break: Sequence[str] = (),
                 descending: bool = True, name: str = "rank_recency", zero_based: bool = True) -> DataFrame:
    """Position of every row inside its group in the given order (0 = first when ``zero_based``).

    A window over the whole group would sort a hot group in one task, so the
    rank is a distributed prefix count instead: rows are range-partitioned by
    (key, order), each row counts the rows of its group before it, and
    ``descending`` counts from the other end (``total - before - 1``). With
    ``descending=True`` and an ascending due day this is
    ``groupby(key).cumcount(ascending=False)`` on the sorted frame.
    """
    from .prefix import prefix_sums

    cols = list(order_by) + [c for c in tie_break if c not in order_by]
    keyed = df.withColumn("_ord", F.struct(*[F.col(c) for c in cols])).withColumn("_one", F.lit(1))
    counted = prefix_sums(keyed, key, "_ord", ["_one"])
    pos = (F.col("_one_total") - F.col("_one_before") - 1) if descending else F.col("_one_before")
    return counted.withColumn(name, pos if zero_based else pos + 1).drop("_ord", "_one", "_one_before", "_one_total")


def first_k_rows(df: DataFrame, key: str, order_by: Sequence[str], k: int, tie_break: Sequence[str] = (),
                 descending: bool = True, rank_name: str = "rk") -> DataFrame:
    """The first ``k`` rows of every group in the given order (1-based ``rank_name``)."""
    return ranked(df, key, order_by, tie_break, descending, rank_name).where(F.col(rank_name) <= k)


def ranked(df: DataFrame, key: str, order_by: Sequence[str], tie_break: Sequence[str] = (),
           descending: bool = True, rank_name: str = "rk") -> DataFrame:
    """All rows with their place in the group (from 1), by a window: for groups that a task can sort."""
    w = Window.partitionBy(key).orderBy(*order_columns(order_by, tie_break, descending))
    return df.withColumn(rank_name, F.row_number().over(w))


def recent_flag(rank: str | Column, k: int) -> Column:
    """0-based recency rank below K."""
    r = F.col(rank) if isinstance(rank, str) else rank
    return r < F.lit(k)

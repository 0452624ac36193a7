"""Spec-driven group rollup (A11-A20) with optional last-K features.

``rollup(df, key, specs)`` = one ``groupBy(key).agg(...)`` over the columns
the spec needs. What it shuffles are the parts that the outputs share (a count and
a sum of each column, not those of each mean); counts come first and the values
of one column lie side by side, so equal and near-equal bytes compress. Specs that look at the K most recent rows are computed from
``first_k_rows`` (a window limited before the shuffle) in a second
aggregate over the same key, and joined to the first on the key: both sides
are one row per key and already hash-partitioned by it, so the join adds no
exchange of its own. Columns that ``derive`` adds row by row are computed after
that shuffle, from raw columns that travel anyway.

Where the rows of a key lie apart, neither the partial aggregates nor the limit
combine anything, and each row travels twice and widened. ``measure`` counts how far
they lie apart; if the plain rows are less than what they would become, these are
shuffled once, and ranked and aggregated where they arrive. A key that holds more than a
shuffle partition's share keeps the two-step form, whose tasks it cannot fill.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, NumericType

from ..sources.sinks import shuffles_freed
from .aggspec import Agg, agg_column, agg_sql, input_columns, part_columns
from .recency import first_k_rows, ranked

_CELLS = 16  # for each shuffle partition, in which the rows are counted
_GAIN = 1.5  # fields saved, below which the bytes are about the same (neighbouring counts and sums compress better)


def _parts(df: DataFrame, specs: Sequence[Agg]):
    types = {f.name: f.dataType for f in df.schema.fields}
    plain = {c for c, of in types.items() if isinstance(of, NumericType) and not isinstance(of, DecimalType)}
    return part_columns(specs, plain)


def _aggregated(df: DataFrame, key: str, specs: Sequence[Agg]) -> DataFrame:
    """The outputs of ``specs`` by ``key``, from shared parts."""
    parts, outputs = _parts(df, specs)
    return df.groupBy(key).agg(*parts).select(key, *outputs)


def plain_rows_are_less(df: DataFrame, key: str, n_parts: int, k: int) -> bool:
    """Whether the rows of ``df`` hold fewer fields than ``n_parts`` aggregates and ``k`` rows of each key and scan task do.

    Counts every row, by passes over the key alone; only the form of the plan hangs on it.
    """
    with shuffles_freed(df.sparkSession):
        seen = df.select(F.struct(F.spark_partition_id(), key).alias("seen"))
        rows, groups = seen.agg(F.count("*"), F.approx_count_distinct("seen")).first()
        if _GAIN * rows * len(df.columns) >= groups * (1 + n_parts) + min(rows, groups * k) * len(df.columns):
            return False
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        cell = F.pmod(F.xxhash64(key), F.lit(partitions * _CELLS))
        return df.groupBy(cell.alias("cell")).count().agg(F.max("count")).first()[0] <= rows / partitions


def rollup(df: DataFrame, key: str, specs: Sequence[Agg], order_by: Sequence[str] = (),
           tie_break: Sequence[str] = (), k: int = 3, descending: bool = True,
           drop_null_keys: bool = True, derive: Callable[[DataFrame], DataFrame] = lambda rows: rows,
           recent_rows: DataFrame | None = None, measure: bool = False) -> DataFrame:
    """``recent_rows``: the same rows with only what the last K read, where ``df`` has more from joins."""
    specs = list(specs)
    full = [a for a in specs if not a.last_k]
    recent = [a for a in specs if a.last_k]
    if drop_null_keys:  # pandas groupby drops null keys (N5)
        df = df.where(F.col(key).isNotNull())
        recent_rows = recent_rows.where(F.col(key).isNotNull()) if recent_rows is not None else None
    if recent and not order_by:
        raise ValueError("last-K features need an order")

    derived = derive(df)
    if recent and measure and plain_rows_are_less(df, key, len(_parts(derived, full)[0]), k):
        rows = derive(ranked(df, key, order_by, tie_break, descending, "rk"))
        parts, outputs = _parts(rows, full)
        last = [F.expr(agg_sql(a, "rk", k)) for a in recent]
        out = rows.groupBy(key).agg(*parts, *last).select(key, *outputs, *[a.name for a in recent])
        return out.select(key, *[a.name for a in specs])

    out = _aggregated(derived.select(key, *[c for c in input_columns(full) if c != key]), key, full)

    if recent:
        top = derive(first_k_rows(df if recent_rows is None else recent_rows, key, order_by, k, tie_break, descending))
        top_agg = top.groupBy(key).agg(*[agg_column(a) for a in recent])
        out = out.join(top_agg, key, "left")

    return out.select(key, *[a.name for a in specs])

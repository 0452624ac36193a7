"""Rollups kept as mergeable states (A11-A20), so that new rows do not read the history again.

``state`` reduces rows to one row per key with what the feature list needs:
counts, sums, extremes, centred second moments and the K most recent rows.
``merge`` joins two such tables on the key, and ``finish`` turns one into the
rollup's outputs. ``finish(merge(state(a), state(b)))`` equals
``rollup(a union b)`` up to the order of floating-point sums.

A state row has a fixed size whatever the length of its group's history, and
both sides of a merge have one row per key, so a hot key costs no more than
any other. Second moments are kept about the mean and merged by the pairwise update,
so of a large offset only the rounding of the means themselves is felt (as in
Spark's own aggregate), not that of sums of squares. The K most recent rows of a union are among
the K most recent rows of its parts, so keeping K of each loses nothing; of rows
that tie in the whole order the one with the larger values stays (the smaller
ones where the order ascends).

Null keys are dropped; null values count as in ``rollup``. An empty table has
an empty state. A batch must be merged once: states do not know their batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .aggspec import Agg, input_columns
from .recency import first_k_rows

RECENT = "recent"
_ROWS = "rows"


def _part(kind: str, column: str) -> str:
    return f"{kind}__{column}"


def _needs(a: Agg) -> list[tuple[str, str]]:
    """(kind, name) of the state columns that one spec row reads."""
    if a.last_k:
        return []
    c = a.column
    return {
        "count": [("n", c)], "rows": [], "mean": [("n", c), ("sum", c)], "max": [("high", c)], "min": [("low", c)],
        "sum": [("sum", c)], "std": [("n", c), ("sum", c), ("m2", c)], "range": [("low", c), ("high", c)],
        "share": [("hits", a.name)], "count_if": [("hits", a.name)], "any": [("hits", a.name)],
    }[a.kind]


def _parts(specs: Sequence[Agg]) -> dict[str, tuple[str, Agg]]:
    """State column -> (kind, a spec row that reads it), each once."""
    return {_part(kind, name): (kind, a) for a in specs for kind, name in _needs(a)}


def _column(kind: str, a: Agg) -> Column:
    c = F.col(f"`{a.column}`")
    if kind == "hits":
        return F.count(F.when(a.pred.column(c), 1))
    if kind == "m2":
        return F.var_pop(c) * F.count(c)
    return {"n": F.count, "sum": F.sum, "low": F.min, "high": F.max}[kind](c)


def state(df: DataFrame, key: str, specs: Sequence[Agg], order_by: Sequence[str] = (), tie_break: Sequence[str] = (),
          k: int = 3, descending: bool = True) -> DataFrame:
    """One row per key of ``df``: the state columns of ``specs``, and ``recent`` if a row of them looks at the last K."""
    specs = list(specs)
    df = df.where(F.col(key).isNotNull())
    full, last = [a for a in specs if not a.last_k], [a for a in specs if a.last_k]
    parts = _parts(full)
    out = df.select(key, *[c for c in input_columns(full) if c != key]).groupBy(key).agg(
        F.count("*").alias(_ROWS), *[_column(kind, a).alias(name) for name, (kind, a) in parts.items()]
    )
    if last:
        if not order_by:
            raise ValueError("last-K features need an order")
        fields = list(dict.fromkeys([*order_by, *tie_break, *input_columns(last)]))
        top = first_k_rows(df.select(key, *[c for c in fields if c != key]), key, order_by, k, tie_break, descending)
        rows = F.collect_list(F.struct(*fields))  # K at most
        out = out.join(top.groupBy(key).agg(F.sort_array(rows, not descending).alias(RECENT)), key, "left")
    return out


def merge(old: DataFrame, new: DataFrame, key: str, specs: Sequence[Agg], k: int = 3, descending: bool = True) -> DataFrame:
    """The state of the rows of both; ``old`` and ``new`` are states of the same ``specs``, one row per key each."""
    a, b = old.alias("a"), new.alias("b")

    def both(name: str) -> tuple[Column, Column]:
        return F.col(f"a.`{name}`"), F.col(f"b.`{name}`")

    def added(name: str) -> Column:
        x, y = both(name)
        return F.coalesce(x + y, x, y)

    def merged(name: str, kind: str, spec: Agg) -> Column:
        x, y = both(name)
        if kind in ("n", "hits", "sum"):
            return added(name)
        if kind in ("low", "high"):
            return (F.least if kind == "low" else F.greatest)(x, y)  # both skip nulls
        (n, m), (s, t) = both(_part("n", spec.column)), both(_part("sum", spec.column))
        apart = t / m - s / n
        return F.when((n > 0) & (m > 0), x + y + apart * apart * (n * (m / (n + m)))).otherwise(F.coalesce(x, y))

    columns = [merged(name, kind, spec).alias(name) for name, (kind, spec) in _parts(specs).items()]
    if RECENT in old.columns:
        x, y = (F.coalesce(c, F.array()) for c in both(RECENT))
        columns.append(F.slice(F.sort_array(F.concat(x, y), not descending), 1, k).alias(RECENT))
    keys = both(key)
    return a.join(b, keys[0] == keys[1], "full_outer").select(F.coalesce(*keys).alias(key), added(_ROWS).alias(_ROWS), *columns)


def _last(a: Agg, integral: bool) -> Column:
    if a.base_kind == "share":
        hits = F.size(F.filter(RECENT, lambda r: a.pred.column(r[a.column])))
        return F.when(F.size(RECENT) > 0, hits / F.size(RECENT))
    values = F.filter(F.transform(RECENT, lambda r: r[a.column]), lambda v: v.isNotNull())
    if a.base_kind == "max":
        return F.array_max(values)
    if a.base_kind == "min":
        return F.array_min(values)
    of = "bigint" if integral else "double"
    total = F.aggregate(values, F.lit(0).cast(of), lambda so_far, v: so_far + v.cast(of))
    if a.base_kind == "sum":
        return total.cast("bigint") if a.int_sum else total
    if a.base_kind == "mean":
        return F.when(F.size(values) > 0, total.cast("double") / F.size(values))
    raise ValueError(a.kind)


def finish(merged: DataFrame, key: str, specs: Sequence[Agg]) -> DataFrame:
    """The outputs of ``rollup`` from a state."""
    fields = {f.name: f.dataType for f in merged.schema[RECENT].dataType.elementType.fields} if RECENT in merged.columns else {}

    def output(a: Agg) -> Column:
        if a.last_k:
            return _last(a, isinstance(fields[a.column], IntegralType))
        of = {kind: F.col(f"`{_part(kind, name)}`") for kind, name in _needs(a)}
        rows = F.col(_ROWS)
        if a.kind == "sum":
            total = F.coalesce(of["sum"], F.lit(0))
            return total.cast("bigint") if a.int_sum else total
        if a.kind == "std":
            return F.when(of["n"] > 1, F.sqrt(of["m2"] / (of["n"] - 1)))
        return {
            "count": lambda: of["n"], "rows": lambda: rows, "mean": lambda: F.when(of["n"] > 0, of["sum"].cast("double") / of["n"]),
            "max": lambda: of["high"], "min": lambda: of["low"], "range": lambda: of["high"] - of["low"],
            "share": lambda: of["hits"] / rows, "count_if": lambda: of["hits"], "any": lambda: (of["hits"] > 0).cast("int"),
        }[a.kind]()

    return merged.select(key, *[output(a).alias(a.name) for a in specs])

"""Declarative group-aggregate specs.

A feature list is data: ``Agg(name, column, kind, pred)`` rows. One list
compiles to a single ``groupBy(key).agg(*columns)`` — one pass, partial
(map-side) aggregation for every kind, no Python per group — and, for the
oracle, to the equivalent SQL select list.

Kinds
-----
count      non-null count                      ``count(c)``
rows       row count                           ``count(*)``
mean       mean, nulls skipped                 ``avg(c)``
max / min
sum        sum, 0 for an all-null group        ``coalesce(sum(c), 0)``
std        sample standard deviation           ``stddev_samp(c)``
range      max - min
share      rows with pred true / all rows      ``avg(case when p then 1 else 0)``
count_if   rows with pred true
any        1 if some row has pred true else 0
last_*     the same kinds over the K first rows of each group in a given
           order (``last_max``, ``last_mean``, ``last_share``, ``last_sum``)
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F



@dataclass(frozen=True)
class Pred:
    op: str  # eq in gt ge lt le isnull notnull
    value: Any = None

    def column(self, c: Column) -> Column:
        op, v = self.op, self.value
        if op == "eq":
            return c == F.lit(v)
        if op == "in":
            return c.isin(list(v))
        if op == "gt":
            return c > F.lit(v)
        if op == "ge":
            return c >= F.lit(v)
        if op == "lt":
            return c < F.lit(v)
        if op == "le":
            return c <= F.lit(v)
        if op == "isnull":
            return c.isNull()
        if op == "notnull":
            return c.isNotNull()
        raise ValueError(op)

    def sql(self, c: str) -> str:
        op, v = self.op, self.value
        if op == "in":
            return f"{c} IN ({', '.join(_sql_lit(x) for x in v)})"
        sym = {"eq": "=", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}.get(op)
        if sym:
            return f"{c} {sym} {_sql_lit(v)}"
        if op == "isnull":
            return f"{c} IS NULL"
        if op == "notnull":
            return f"{c} IS NOT NULL"
        raise ValueError(op)


def _sql_lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def eq(v):
    return Pred("eq", v)


def isin(*vs):
    return Pred("in", tuple(vs))


def gt(v):
    return Pred("gt", v)


def ge(v):
    return Pred("ge", v)


def le(v):
    return Pred("le", v)


def isnull():
    return Pred("isnull")


@dataclass(frozen=True)
class Agg:
    name: str
    column: str
    kind: str
    pred: Pred | None = None
    # DuckDB sums integers to HUGEINT; Spark to BIGINT. Set for integer sums.
    int_sum: bool = False

    @property
    def last_k(self) -> bool:
        return self.kind.startswith("last_")

    @property
    def base_kind(self) -> str:
        return self.kind[5:] if self.last_k else self.kind


def agg_column(a: Agg) -> Column:
    """Spark aggregate expression for one spec row (last-K rows use their base kind: the
    caller has already kept only the K first rows of each group).

    Built as one SQL expression (a single call into the JVM per output, instead
    of one per sub-expression); the text is the same dialect the oracle uses.
    """
    return F.expr(agg_sql(a, gated=False))


def part_columns(specs: list[Agg], plain: set[str]) -> tuple[list[Column], list[Column]]:
    """``(parts, outputs)``: aggregates that the specs share, each once, and every output as an expression of them.

    Equal to ``agg_column`` of each spec; ``plain`` are the columns whose mean is a sum of doubles over a count.
    """
    counts: dict[str, str] = {}
    values: dict[str, dict[str, str]] = {}  # by column, so that its extremes and sums are neighbours

    def part(sql: str, of: str | None = None) -> str:
        held = counts if of is None else values.setdefault(of, {})
        return held.setdefault(sql, f"_part_{'n' if of is None else list(values).index(of)}_{len(held)}")

    outputs = []
    for a in specs:
        c = _ident(a.column)
        if a.kind == "count":
            out = part(f"count({c})")
        elif a.kind == "rows":
            out = part("count(*)")
        elif a.kind == "count_if":
            out = part(f"count(CASE WHEN {a.pred.sql(c)} THEN 1 END)")
        elif a.kind == "share":
            out = f"{part(f'count(CASE WHEN {a.pred.sql(c)} THEN 1 END)')} / {part('count(*)')}"
        elif a.kind == "mean" and a.column in plain:
            out = f"{part(f'sum(CAST({c} AS DOUBLE))', c)} / nullif({part(f'count({c})')}, 0)"
        elif a.kind == "range":
            out = f"{part(f'max({c})', c)} - {part(f'min({c})', c)}"
        else:
            out = part(agg_sql(a, gated=False).rsplit(" AS ", 1)[0], c)
        outputs.append(F.expr(f"{out} AS {_ident(a.name)}"))
    every = counts | {sql: name for held in values.values() for sql, name in held.items()}
    return [F.expr(f"{sql} AS {name}") for sql, name in every.items()], outputs


def agg_sql(a: Agg, rank_col: str = "rk", k: int = 3, gated: bool = True) -> str:
    """SQL rendering of one spec row (valid in Spark SQL and DuckDB).

    With ``gated`` the last-K rows filter on ``rank_col <= k`` inside the
    aggregate (the oracle's form); without, they aggregate every input row.
    """
    c = _ident(a.column)
    if a.last_k and gated:
        # restrict the input to the K first rows; other rows become null
        def gate(expr: str) -> str:
            return f"CASE WHEN {rank_col} <= {k} THEN {expr} END"
    else:
        def gate(expr: str) -> str:
            return expr

    kind = a.base_kind
    if kind == "count":
        out = f"count({gate(c)})"
    elif kind == "rows":
        out = "count(*)"
    elif kind == "mean":
        out = f"avg({gate(c)})"
    elif kind == "max":
        out = f"max({gate(c)})"
    elif kind == "min":
        out = f"min({gate(c)})"
    elif kind == "sum":
        out = f"coalesce(sum({gate(c)}), 0)"
        if a.int_sum:
            out = f"CAST({out} AS BIGINT)"
    elif kind == "std":
        out = f"stddev_samp({gate(c)})"
    elif kind == "range":
        out = f"max({gate(c)}) - min({gate(c)})"
    elif kind == "share":
        out = f"avg({gate(f'CASE WHEN {a.pred.sql(c)} THEN 1e0 ELSE 0e0 END')})"
    elif kind == "count_if":
        out = f"count({gate(f'CASE WHEN {a.pred.sql(c)} THEN 1 END')})"
    elif kind == "any":
        out = f"max({gate(f'CASE WHEN {a.pred.sql(c)} THEN 1 ELSE 0 END')})"
    else:
        raise ValueError(a.kind)
    return f"{out} AS {_ident(a.name)}"


def _ident(name: str) -> str:
    return name if name.replace("_", "").isalnum() and not name[0].isdigit() else f"`{name}`"


def select_list_sql(specs: list[Agg], rank_col: str = "rk", k: int = 3) -> str:
    return ",\n  ".join(agg_sql(a, rank_col, k) for a in specs)


def input_columns(specs: list[Agg]) -> list[str]:
    seen: list[str] = []
    for a in specs:
        if a.kind != "rows" and a.column not in seen:
            seen.append(a.column)
    return seen

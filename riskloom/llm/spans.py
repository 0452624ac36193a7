"""Spans of regular-expression matches as columns: built-in functions only, within the row.

A match's place is not among Spark's functions, but the texts between matches
(``split``) and the matches (``regexp_extract_all``) are, and both come from the
same leftmost, non-overlapping search. Their lengths, summed along the row, are the
places, in code points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: running sums go over slices of so many values, then over the slices, so that very many matches in a text stay cheap
_SLICE = 256
CONTEXT = 40


def _running(values: Column) -> Column:
    start = F.array().cast("array<bigint>")
    return F.aggregate(
        values, start, lambda acc, x: F.concat(acc, F.array(x + F.when(F.size(acc) > 0, F.element_at(acc, -1)).otherwise(F.lit(0))))
    )


def running_sums(values: Column) -> Column:
    """The running sums of an array that is not empty."""
    last = F.floor((F.size(values) - 1) / _SLICE).cast("int")
    slices = F.transform(F.sequence(F.lit(0), last), lambda s: _running(F.slice(values, s * _SLICE + 1, _SLICE)))
    before = F.concat(F.array(F.lit(0).cast("bigint")), _running(F.transform(slices, lambda s: F.element_at(s, -1))))
    return F.flatten(F.transform(F.arrays_zip(slices.alias("s"), F.slice(before, F.lit(1), F.size(slices)).alias("b")),
                                 lambda z: F.transform(z["s"], lambda x: x + z["b"])))


def add_hits(df: DataFrame, text: str, name: str, pattern: str) -> DataFrame:
    """``df`` with the column ``name``: ``start, end, hit, before, after`` of each match (texts next to it up to the next match)."""
    hits, gaps, ends = f"_{name}_hits", f"_{name}_gaps", f"_{name}_ends"
    kept = df.columns
    df = df.withColumn(hits, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    some = F.size(hits) > 0
    df = df.withColumn(gaps, F.when(some, F.split(text, pattern, -1)))
    sizes = F.transform(F.arrays_zip(gaps, hits), lambda z: (F.length(z[gaps]) + F.coalesce(F.length(z[hits]), F.lit(0))).cast("bigint"))
    df = df.withColumn(ends, F.when(some, running_sums(sizes)))
    rows = F.arrays_zip(hits, gaps, F.slice(gaps, 2, F.size(gaps)).alias("next"), ends)
    spans = F.transform(
        F.slice(rows, F.lit(1), F.size(hits)),
        lambda z: F.struct(
            (z[ends] - F.length(z[hits])).alias("start"),
            z[ends].alias("end"),
            z[hits].alias("hit"),
            F.right(z[gaps], F.lit(CONTEXT)).alias("before"),
            F.left(z["next"], F.lit(CONTEXT)).alias("after"),
        ),
    )
    empty = F.array().cast("array<struct<start:bigint,end:bigint,hit:string,before:string,after:string>>")
    return df.withColumn(name, F.when(some, spans).otherwise(empty)).select(*kept, name)


def placed(spans: Column, kind: int) -> Column:
    """``start, kind, end`` of each span, with the kind's number."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def written(spans: Column, kinds: Sequence[str]) -> Column:
    """Placed spans as ``kind:start:end``, by start, then kind, joined by commas."""
    names = F.array(*map(F.lit, kinds))
    each = F.transform(
        F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(each, ",")

"""Exact order statistics of many columns by radix selection (M4, M5, M6, B1).

Every value has an order-preserving 64-bit key. One aggregate gives each column's count, smallest and largest value. Then each
pass counts, in every task and for all columns at once, the next digit of the keys inside the ranges that still hold a wanted
rank; a range ends when its smallest and largest value are equal. What moves between tasks is at most ``CELLS`` counts for
each task, never a value; what reaches the driver is a row for each wanted rank. Rows are neither
stacked, sorted nor checkpointed: a pass is a scan of the columns that are still open. Digits divide the range that a bucket
really spans, so a pass narrows alike whatever the magnitude; measurements need two or three passes.

Nulls are left out. -0.0 counts as 0.0; NaN is larger than every number and equal to itself. The rows must be the same
each time they are read.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1 << 20  # counters of a task, dealt among the open ranges
MOST_DIGITS = 1 << 16
_SIGN = 1 << 63


@dataclass(frozen=True)
class Order:
    """The value at a rank, how many values are smaller, and how many equal it."""

    value: float | int
    below: int
    copies: int


def _keys(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit keys in the order of the values (int64 or float64)."""
    if values.dtype == np.float64:
        values = np.where(np.isnan(values), np.nan, values) + 0.0
        bits = values.view(np.int64)
        bits = bits ^ ((bits >> 63) & np.int64(_SIGN - 1))
    else:
        bits = values.astype(np.int64)
    return bits.view(np.uint64) ^ np.uint64(_SIGN)


def _key(value: float | int, whole: bool) -> int:
    return int(_keys(np.array([value], np.int64 if whole else np.float64))[0])


def _value(key: int, whole: bool) -> float | int:
    bits = (key ^ _SIGN) - (1 << 64 if (key ^ _SIGN) >= _SIGN else 0)
    if whole:
        return bits
    return struct.unpack("<d", struct.pack("<q", bits if bits >= 0 else bits ^ (_SIGN - 1)))[0]


@dataclass(frozen=True)
class _Range:
    """Keys ``low`` to ``high`` of a column, with ``below`` values before them."""

    column: str
    low: int
    high: int
    below: int

    def shift(self, digits: int) -> int:
        return max(0, (self.high - self.low).bit_length() - (digits.bit_length() - 1))


def _digits(ranges: int) -> int:
    """A power of two: how many buckets each of so many ranges gets."""
    return min(MOST_DIGITS, max(2, 1 << ((CELLS // ranges).bit_length() - 1)))


def _count(ranges: Sequence[_Range], at: Mapping[str, int]) -> Callable:
    """Per task: how many keys of each open range have each digit, and the smallest and largest of them."""

    digits = _digits(len(ranges))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(ranges), digits), np.int64)
        least = np.full((len(ranges), digits), 2**64 - 1, np.uint64)
        most = np.zeros((len(ranges), digits), np.uint64)
        for batch in batches:
            keys: dict[str, np.ndarray] = {}
            for i, r in enumerate(ranges):
                if r.column not in keys:
                    keys[r.column] = np.sort(_keys(batch.column(at[r.column]).drop_null().to_numpy(zero_copy_only=False)))
                own = keys[r.column]
                a, z = np.searchsorted(own, np.uint64(r.low)), np.searchsorted(own, np.uint64(r.high), side="right")
                own = own[a:z]
                if len(own):
                    digit = ((own - np.uint64(r.low)) >> np.uint64(r.shift(digits))).astype(np.int64)
                    first = np.flatnonzero(np.diff(digit, prepend=-1))
                    last = np.append(first[1:], len(own)) - 1
                    d = digit[first]
                    n[i, d] += last - first + 1
                    least[i, d] = np.minimum(least[i, d], own[first])
                    most[i, d] = np.maximum(most[i, d], own[last])
        which, digit = np.nonzero(n)
        ends = [(x[which, digit] ^ np.uint64(_SIGN)).view(np.int64) for x in (least, most)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(which, pa.int64()), pa.array(digit, pa.int64()), pa.array(n[which, digit]), *map(pa.array, ends)],
            names=["range", "digit", "n", "least", "most"],
        )

    return count


def order_statistics(df: DataFrame, columns: Mapping[str, Column], ranks: Callable[[str, int], Iterable[int]]) -> dict[str, tuple[int, dict[int, Order]]]:
    """For each column its number of values, and the ``Order`` of each rank that ``ranks(name, number)`` asks for (from 0).

    Columns are ``bigint`` (compared exactly) or anything that casts to ``double``.
    """
    names = list(columns)
    if not names:
        return {}
    typed = df.select(*[columns[c].alias(f"c{i}") for i, c in enumerate(names)])
    whole = {c: typed.schema[i].dataType.typeName() in ("long", "integer", "short", "byte") for i, c in enumerate(names)}
    typed = typed.select(*[F.col(f"c{i}").cast("bigint" if whole[c] else "double").alias(f"c{i}") for i, c in enumerate(names)])
    first = typed.agg(*[f(f"c{i}").alias(f"{k}{i}") for i in range(len(names)) for k, f in (("n", F.count), ("a", F.min), ("z", F.max))]).first()
    found: dict[str, tuple[int, dict[int, Order]]] = {}
    open_ranks: dict[_Range, set[int]] = {}

    def place(r: _Range, rank: int, copies: int) -> None:
        if r.low == r.high:
            found[r.column][1][rank] = Order(_value(r.low, whole[r.column]), r.below, copies)
        else:
            open_ranks.setdefault(r, set()).add(rank)

    for i, c in enumerate(names):
        n = first[f"n{i}"]
        found[c] = n, {}
        if n:
            all_of = _Range(c, _key(first[f"a{i}"], whole[c]), _key(first[f"z{i}"], whole[c]), 0)
            for rank in ranks(c, n):
                place(all_of, rank, n)
    while open_ranks:
        wanted, open_ranks = open_ranks, {}
        ranges = list(wanted)
        used = sorted({names.index(r.column) for r in ranges})
        at = {names[i]: k for k, i in enumerate(used)}
        counts = typed.select(*[f"c{i}" for i in used]).mapInArrow(_count(ranges, at), "range bigint, digit bigint, n bigint, least bigint, most bigint")
        counts = counts.groupBy("range", "digit").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        before = Window.partitionBy("range").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        # the wanted ranks: as many as the caller asked for
        asked = [(i, rank - r.below, rank) for i, r in enumerate(ranges) for rank in wanted[r]]
        asked = df.sparkSession.createDataFrame(asked, "range bigint, inside bigint, rank bigint")
        hits = counts.join(F.broadcast(asked), "range").where((F.col("inside") >= F.col("before")) & (F.col("inside") < F.col("before") + F.col("n")))
        for h in hits.collect():
            r = ranges[h["range"]]
            place(_Range(r.column, (h["least"] + (1 << 64)) % (1 << 64) ^ _SIGN, (h["most"] + (1 << 64)) % (1 << 64) ^ _SIGN, r.below + h["before"]), h["rank"], h["n"])
    return found


def quantiles(df: DataFrame, columns: Mapping[str, Column], probs: Mapping[str, Sequence[float]]) -> dict[str, list[float]]:
    """Exact linear-interpolated quantiles of each column, as doubles (none for a column without values)."""
    doubles = {c: x.cast("double") for c, x in columns.items()}
    found = order_statistics(df, doubles, lambda c, n: {int(f(p * (n - 1))) for p in probs[c] for f in (math.floor, math.ceil)})
    return {c: [_between(order, p * (n - 1)) for p in probs[c]] if n else [] for c, (n, order) in found.items()}


def _between(order: Mapping[int, Order], place: float) -> float:
    """The same interpolation, term for term, as the built-in exact percentile."""
    lo, hi = math.floor(place), math.ceil(place)
    a, b = order[lo].value, order[hi].value
    return a if lo == hi or a == b else (hi - place) * a + (place - lo) * b

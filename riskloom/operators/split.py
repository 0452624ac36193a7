"""Train / validation / test splits (M4, M5).

``hash_split`` gives each row a uniform number from ``md5(seed:id)`` and cuts
it at cumulative fractions: no shuffle, no sampling state, the same rows on
every run and every engine, and per-label shares equal the fractions in
expectation (stratified in distribution). ``exact=True`` cuts each label at
its exact share instead: rows are ordered inside each label by the hash (equal
ones by id), radix selection finds the row at each cut, and the rows are then compared with it
where they are. Nothing is ranked, shuffled or copied.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import order_statistics

SEED = 42
# 70 / 30 then 70 / 30 of the rest (baseline model), and 75 / 25 (tree model).
THREE_WAY = (("train", 0.7), ("validation", 0.21), ("test", 0.09))
TWO_WAY = (("train", 0.75), ("validation", 0.25))


def hash_unit(id_col: str | Column, seed: int = SEED) -> Column:
    """Uniform [0, 1) from the first 32 bits of ``md5('<seed>:<id>')``."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    digest = F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def _cuts(parts: Sequence[tuple[str, float]]) -> list[tuple[str, float]]:
    out, acc = [], 0.0
    for name, frac in parts:
        acc = round(acc + frac, 12)
        out.append((name, acc))
    return out


def hash_split(df: DataFrame, id_col: str, parts: Sequence[tuple[str, float]] = THREE_WAY, seed: int = SEED,
               label: str | None = None, exact: bool = False, name: str = "split") -> DataFrame:
    u = hash_unit(id_col, seed)
    cuts = _cuts(parts)
    if not exact:
        expr = None
        for part, upper in cuts[:-1]:
            expr = F.when(u < F.lit(upper), F.lit(part)) if expr is None else expr.when(u < F.lit(upper), F.lit(part))
        expr = expr.otherwise(F.lit(cuts[-1][0])) if expr is not None else F.lit(cuts[-1][0])
        return df.withColumn(name, expr)
    if label is None:
        raise ValueError("exact split needs the label column")
    split = F.lit(cuts[-1][0])
    for value, first_of in _cut_rows(df, id_col, u, label, [upper for _, upper in cuts[:-1]]).items():
        part = F.lit(cuts[-1][0])
        for (part_name, _), first in zip(reversed(cuts[:-1]), reversed(first_of), strict=True):
            if first is not None:
                h, i = F.lit(first[0]), F.lit(first[1])
                part = F.when((u < h) | ((u == h) & (F.col(id_col) < i)), F.lit(part_name)).otherwise(part)
            else:  # no row of this label is beyond the cut
                part = F.lit(part_name)
        split = F.when(F.col(label).eqNullSafe(F.lit(value)), part).otherwise(split)
    return df.withColumn(name, split)


def _cut_rows(df: DataFrame, id_col: str, u: Column, label: str, uppers: Sequence[float]) -> dict[object, list[tuple[float, int] | None]]:
    """For each label the (hash, id) of the first row whose rank is at least each share of the label's rows; ids are integers."""
    labels = [r[0] for r in df.groupBy(label).count().collect()]  # the classes
    of_label = {str(k): F.when(F.col(label).eqNullSafe(F.lit(v)), u) for k, v in enumerate(labels)}
    start = lambda n: [_first_beyond(n, upper) for upper in uppers]
    hashes = order_statistics(df, of_label, lambda _, n: {r for r in start(n) if r < n})
    # rows that share the hash at a cut are told apart by id
    ties, inside = {}, {}
    for k, (n, order) in hashes.items():
        for j, rank in enumerate(start(n)):
            if rank < n:
                ties[f"{k}:{j}"] = F.when(of_label[k] == F.lit(order[rank].value), F.col(id_col))
                inside[f"{k}:{j}"] = rank - order[rank].below
    ids = order_statistics(df, ties, lambda key, _: [inside[key]])
    out: dict[object, list[tuple[float, int] | None]] = {}
    for k, v in enumerate(labels):
        n, order = hashes[str(k)]
        out[v] = [(order[r].value, ids[f"{k}:{j}"][1][inside[f"{k}:{j}"]].value) if r < n else None for j, r in enumerate(start(n))]
    return out


def _first_beyond(n: int, upper: float) -> int:
    """The smallest rank r with r / n >= upper, in the arithmetic of the comparison."""
    r = min(n, max(0, int(upper * n) - 1))
    while r < n and r / n < upper:
        r += 1
    return r

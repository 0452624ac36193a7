"""Quantile bins, fixed bins and hour bands.

Quantile bins follow ``pd.qcut(x, q, duplicates='drop')``: edges are the
linear-interpolated quantiles 0, 1/q, ..., 1; repeated edges are dropped;
bins are right-closed and the lowest edge is included. Spark's
``Bucketizer``/``QuantileDiscretizer`` are left-closed and ``ntile`` splits
ties, so neither is used.

Edges are found for many features at once by radix selection (``selection``),
which shuffles no values; the summary is then one aggregate over the rows with a
count for each bin. ``quantile_values`` does the same for rows that are already
stacked as (feature, value), with any number of features, by ranking the counted
values with distributed prefix sums.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import selection
from .prefix import prefix_sums


def probabilities(q: int) -> list[float]:
    return [i / q for i in range(q + 1)]


def stack_features(df: DataFrame, features: Sequence[str | tuple[str, Column]], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., feature, value) rows, value as double; null values dropped (F1)."""
    items = []
    for f in features:
        name, expr = (f, F.col(f)) if isinstance(f, str) else f
        items.append(F.struct(F.lit(name).alias("feature"), expr.cast("double").alias("value")))
    return (
        df.select(*keep, F.explode(F.array(*items)).alias("s"))
        .select(*keep, "s.feature", "s.value")
        .where(F.col("value").isNotNull())
    )


def _probs_column(probs: Mapping[str, Sequence[float]]) -> Column:
    """Per-feature probability array as a CASE over the (small, fixed) feature list."""
    lists = {tuple(float(p) for p in ps) for ps in probs.values()}
    if len(lists) == 1:  # one list for every feature: a literal, no CASE
        return F.array(*[F.lit(p) for p in next(iter(lists))])
    expr = None
    for name, ps in probs.items():
        arr = F.array(*[F.lit(float(p)) for p in ps])
        expr = F.when(F.col("feature") == name, arr) if expr is None else expr.when(F.col("feature") == name, arr)
    return expr


def quantile_values(long: DataFrame, probs: Mapping[str, Sequence[float]]) -> DataFrame:
    """Exact linear-interpolated quantiles of stacked (feature, value) rows: (feature, p, value)."""
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt"))
    ranks = prefix_sums(counts, "feature", "value", ["cnt"])
    ranks = ranks.select(
        "feature", "value",
        F.col("cnt_before").alias("rank_start"),  # 0-based rank of the first copy of value
        (F.col("cnt_before") + F.col("cnt")).alias("rank_end"),  # exclusive
        F.col("cnt_total").alias("n"),
    )
    # target positions p*(n-1) with floor/ceil ranks, per feature (small: features x probabilities)
    targets = (
        ranks.groupBy("feature").agg(F.first("n").alias("n"))
        .withColumn("p", F.explode(_probs_column(probs)))
        .withColumn("pos", F.col("p") * (F.col("n") - 1))
        .select("feature", "p", "pos", F.floor("pos").alias("lo"), F.ceil("pos").alias("hi"))
        .groupBy("feature")
        .agg(F.collect_list(F.struct("p", "pos", "lo", "hi")).alias("t"))
    )

    def holds(r: Column) -> Column:
        return (r >= F.col("rank_start")) & (r < F.col("rank_end"))

    hits = ranks.join(F.broadcast(targets), "feature").select(
        "feature", "value", "rank_start", "rank_end",
        F.explode(F.filter("t", lambda x: holds(x["lo"]) | holds(x["hi"]))).alias("x"),
    )
    per_p = hits.groupBy("feature", F.col("x.p").alias("p")).agg(
        F.max(F.when(holds(F.col("x.lo")), F.col("value"))).alias("lo_v"),
        F.max(F.when(holds(F.col("x.hi")), F.col("value"))).alias("hi_v"),
        F.first(F.col("x.pos")).alias("pos"),
        F.first(F.col("x.lo")).alias("lo"),
    )
    # the same interpolation, term for term, as the built-in exact percentile: (hi - pos) * lower value + (pos - lo) * higher value
    hi_rank = F.ceil("pos")
    value = (
        F.when((F.col("lo") == hi_rank) | (F.col("lo_v") == F.col("hi_v")), F.col("lo_v"))
        .otherwise((hi_rank - F.col("pos")) * F.col("lo_v") + (F.col("pos") - F.col("lo")) * F.col("hi_v"))
    )
    return per_p.select("feature", "p", value.alias("value"))


def quantile_edges(long: DataFrame, qs: Mapping[str, int]) -> DataFrame:
    """(feature, edges) for stacked (feature, value) rows; edges ascending, duplicates dropped."""
    values = quantile_values(long, {f: probabilities(q) for f, q in qs.items()})
    return values.groupBy("feature").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("p", "value"))),
                                     lambda s: s["value"])).alias("edges")
    )


def quantile_bin_summary(df: DataFrame, features: Mapping[str, int] | Sequence[tuple[str, Column, int]],
                         target: str = "TARGET") -> DataFrame:
    """A2/U2 for many features at once: (feature, bin, lo, hi, count, default_rate).

    ``features`` maps a column name to q, or lists (name, expression, q) for
    derived inputs (e.g. age in years). Rows with a null feature or target are
    dropped per feature (F1); only bins with rows appear (``observed=True``). A
    feature with one value has a single edge and so no bins, as in pandas.
    """
    if isinstance(features, Mapping):
        items = [(name, F.col(name), q) for name, q in features.items()]
    else:
        items = list(features)
    rows = df.where(F.col(target).isNotNull())
    values = selection.quantiles(rows, {n: e for n, e, _ in items}, {n: probabilities(q) for n, _, q in items})
    edges = {name: sorted(set(values[name])) for name, _, _ in items}
    if not any(len(e) > 1 for e in edges.values()):
        return df.sparkSession.createDataFrame([], "feature string, bin int, lo double, hi double, count bigint, default_rate double")
    # rows and target sums up to each edge, all in one row; a bin is what lies between two of them
    kept = rows.select(F.col(target).alias("t"), *[e.cast("double").alias(f"v{i}") for i, (_, e, _) in enumerate(items)])
    # as SQL text: hundreds of short expressions are slow to build one call at a time
    upto, bins = [], []
    for i, (name, _, _) in enumerate(items):
        quoted = name.replace("\\", "\\\\").replace("'", "\\'")
        for j, edge in enumerate(edges[name][1:], 1):
            inside = f"CASE WHEN v{i} <= {_literal(edge)} THEN t END"
            upto += [f"count({inside}) AS n{i}_{j}", f"coalesce(sum({inside}), 0) AS s{i}_{j}"]
            n, s = (f"{k}{i}_{j} - {k}{i}_{j - 1}" if j > 1 else f"{k}{i}_{j}" for k in "ns")
            bins.append(
                f"named_struct('feature', '{quoted}', 'bin', {j}, 'lo', {_literal(edges[name][j - 1])}, 'hi', {_literal(edge)}, "
                f"'count', {n}, 'default_rate', try_divide(CAST({s} AS DOUBLE), CAST({n} AS DOUBLE)))"
            )
    counted = kept.agg(*map(F.expr, upto))
    return counted.selectExpr(f"inline(array({', '.join(bins)}))").where(F.col("count") > 0)


def _literal(value: float) -> str:
    return f"{value!r}D" if math.isfinite(value) else f"double('{value!r}')"


def fixed_bin(value: str | Column, edges: Sequence[float]) -> Column:
    """B2: ``pd.cut(x, edges, right=True)`` — (lo, hi], lowest edge excluded, outside -> null.

    Returns the 1-based bin number as an int column.
    """
    v = F.col(value) if isinstance(value, str) else value
    expr = None
    for i in range(1, len(edges)):
        cond = (v > F.lit(edges[i - 1])) & (v <= F.lit(edges[i]))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def fixed_bin_summary(df: DataFrame, column: str, edges: Sequence[float], target: str = "TARGET") -> DataFrame:
    """(bin, lo, hi, count, default_rate); values outside every bin are dropped."""
    b = fixed_bin(column, edges)
    edge_arr = F.array(*[F.lit(float(e)) for e in edges])
    out = df.select(b.alias("bin"), F.col(target)).where(F.col("bin").isNotNull())
    out = out.groupBy("bin").agg(F.count(target).alias("count"), F.avg(target).alias("default_rate"))
    return out.select(
        "bin",
        F.element_at(edge_arr, F.col("bin")).alias("lo"),
        F.element_at(edge_arr, F.col("bin") + 1).alias("hi"),
        "count",
        "default_rate",
    )


# Hour bands of the application start hour.
HOUR_BANDS = (("morning", 6, 11), ("afternoon", 12, 17), ("evening", 18, 23))
HOUR_BAND_OTHER = "night"


def hour_band(hour: str | Column) -> Column:
    """6-11 morning, 12-17 afternoon, 18-23 evening, anything else (null too) night."""
    h = F.col(hour) if isinstance(hour, str) else hour
    expr = None
    for name, lo, hi in HOUR_BANDS:
        cond = (h >= lo) & (h <= hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(HOUR_BAND_OTHER))

"""Radix selection against sorted values; plans of what is built on it."""
import math
import struct

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF01
from riskloom.operators import selection, split


def order(values):
    """Sorted as Spark sorts doubles: -0.0 is 0.0, NaN comes last."""
    return sorted((0.0 if v == 0 else v for v in values if v is not None), key=lambda v: (math.isnan(v), 0.0 if math.isnan(v) else v))


def same(a, b):
    return a == b or (math.isnan(a) and math.isnan(b))


_numbers = st.one_of(st.none(), st.floats(), st.sampled_from([0.0, -0.0, 1.0, 5e-324, -1e308, float("nan")]))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(_numbers, st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1))), max_size=40))
def test_every_rank_of_odd_values(spark, rows):
    df = spark.createDataFrame(rows, "x double, k long").repartition(3)
    found = selection.order_statistics(df, {"x": F.col("x"), "k": F.col("k")}, lambda _, n: range(n))
    for c, want in (("x", order([r[0] for r in rows])), ("k", sorted(r[1] for r in rows if r[1] is not None))):
        n, got = found[c]
        assert n == len(want)
        for r, v in enumerate(want):
            assert same(got[r].value, v)
            assert got[r].below == next(i for i, w in enumerate(want) if same(w, v)) and got[r].copies == sum(same(w, v) for w in want)


@settings(max_examples=200, deadline=None)
@given(st.floats(allow_nan=False), st.floats(allow_nan=False), st.integers(-(2**63), 2**63 - 1))
def test_keys_keep_order_and_value(a, b, k):
    ka, kb = selection._key(a, False), selection._key(b, False)
    assert (ka < kb) == (a < b) and (ka == kb) == (a == b)
    assert selection._value(ka, False) == a and selection._value(selection._key(k, True), True) == k
    assert struct.pack("<d", selection._value(selection._key(-0.0, False), False)) == struct.pack("<d", 0.0)


def test_many_columns_of_any_spread(spark):
    df = spark.createDataFrame(
        [(float((i * 2654435761) % 2**61 - 2**60) / 7, (i * 0.6180339887) % 1, float(i % 5), 1e-300 * i if i % 3 == 0 else None, None, 4) for i in range(20_000)],
        "wide double, unit double, few double, tiny double, none double, one int")
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.999, 1.0]
    got = selection.quantiles(df, {c: F.col(c) for c in df.columns}, dict.fromkeys(df.columns, probs))
    assert got["none"] == [] and got["one"] == [4.0] * len(probs)
    for c in df.columns[:4]:
        want = df.agg(F.percentile(c, F.array(*map(F.lit, probs)))).first()[0]
        assert got[c] == want


def test_a_third_of_all_rows_has_one_value(spark):
    df = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") / 9_000).alias("x"))
    n, found = selection.order_statistics(df, {"x": F.col("x")}, lambda _, n: [n // 2])["x"]
    values = sorted(0.5 if i % 3 == 0 else i / 9_000 for i in range(9_000))
    assert (n, found[4_500].value, found[4_500].copies) == (9_000, values[4_500], values.count(values[4_500]))


@pytest.mark.parametrize("name", ["multi_feature_bins", "scaler_stats", "quantile_bins_ties"])
def test_no_values_are_stacked_or_shuffled(spark, name):
    p = entry.queries()[name](spark, SF01)._jdf.queryExecution().executedPlan().toString()
    below = p[p.index("Aggregate"):]
    assert "Generate" not in below and "rangepartitioning" not in p and "hashpartitioning(feature" not in p


def test_exact_split_is_a_filter(spark):
    df = spark.range(5_000).select(F.col("id").alias("k"), F.when(F.col("id") % 7 > 0, (F.col("id") % 10 == 0).cast("int")).alias("y"))
    out = split.hash_split(df, "k", split.THREE_WAY, label="y", exact=True)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    ranked = {}
    for r in df.withColumn("u", split.hash_unit("k")).collect():
        ranked.setdefault(r.y, []).append((r.u, r.k))
    want = {}
    for rows in ranked.values():
        for i, (_, k) in enumerate(sorted(rows)):
            share = i / len(rows)
            want[k] = "train" if share < 0.7 else "validation" if share < 0.91 else "test"
    assert {r.k: r.split for r in out.collect()} == want


def test_exact_split_with_equal_hashes_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(split, "hash_unit", lambda c, seed=42: (F.col(c) % 3) / F.lit(4.0))
    df = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(100, 9)], "k long, y long")
    out = {r.k: r.split for r in split.hash_split(df, "k", split.THREE_WAY, label="y", exact=True).collect()}
    for y in (0, 1, 9):
        rows = sorted((k % 3, k) for k in out if (9 if k == 100 else k % 2) == y)
        share = {k: i / len(rows) for i, (_, k) in enumerate(rows)}
        assert all(out[k] == ("train" if s < 0.7 else "validation" if s < 0.91 else "test") for k, s in share.items())

"""Null, zero-denominator and sentinel rules on literal rows (FIXTURES §4)."""
import math

from pyspark.sql import functions as F

from riskloom.functions import nulls
from riskloom.operators.aggspec import Agg, agg_column, eq, gt, le


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(cols[0]).collect()]


def test_all_null_sum_is_zero_n1(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3.0)], "k int, x double")
    out = df.groupBy("k").agg(agg_column(Agg("s", "x", "sum")), F.max("x").alias("m"), F.count("x").alias("c"))
    assert rows(out, "k", "s", "m", "c") == [(1, 0.0, None, 0), (2, 3.0, 3.0, 1)]


def test_share_keeps_null_rows_in_denominator_n3(spark):
    df = spark.createDataFrame([("C",), (None,)], "s string")
    assert df.agg(agg_column(Agg("r", "s", "share", eq("C")))).first()["r"] == 0.5


def test_over_and_under_pay_need_not_sum_to_one_n4(spark):
    df = spark.createDataFrame([(1, 5.0), (1, None), (1, -1.0)], "k int, u double")
    out = df.groupBy("k").agg(agg_column(Agg("under", "u", "share", gt(0))), agg_column(Agg("over", "u", "share", le(0))))
    r = out.first()
    assert math.isclose(r["under"], 1 / 3) and math.isclose(r["over"], 1 / 3)


def test_null_group_keys_dropped_n5(spark):
    from riskloom.operators.rollup import rollup

    df = spark.createDataFrame([(None, 1.0), (1, 2.0)], "k int, x double")
    out = rollup(df, "k", [Agg("m", "x", "max")])
    assert rows(out, "k", "m") == [(1, 2.0)]


def test_zero_denominator_is_null_n7(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (1.0, 2.0)], "a double, b double")
    got = [r[0] for r in df.select(nulls.safe_div("a", "b")).collect()]
    assert got == [None, None, 0.5]


def test_where_with_null_predicate_takes_else_n8(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert df.select(F.when(F.col("x") > 0, 1).otherwise(2)).first()[0] == 2


def test_std_of_one_row_is_null_n10(spark):
    df = spark.createDataFrame([(1, 1.0)], "k int, x double")
    assert df.groupBy("k").agg(agg_column(Agg("s", "x", "std"))).first()["s"] is None


def test_floor_division_n13(spark):
    df = spark.createDataFrame([(-1500.0,), (1500.0,)], "x double")
    assert [r[0] for r in df.select(nulls.floor_div("x", 1000)).collect()] == [-2, 1]


def test_sentinel_to_null(spark):
    df = spark.createDataFrame([(365243,), (-5,)], "d int")
    assert [r[0] for r in df.select(nulls.sentinel_to_null("d")).collect()] == [None, -5]


def test_any_flag_and_count_if(spark):
    df = spark.createDataFrame([(1, "5"), (1, None), (2, "0")], "k int, s string")
    out = df.groupBy("k").agg(agg_column(Agg("ever", "s", "any", eq("5"))), agg_column(Agg("n", "s", "count_if", eq("5"))))
    assert rows(out, "k", "ever", "n") == [(1, 1, 1), (2, 0, 0)]

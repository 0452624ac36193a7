"""The parts that a rollup's outputs share, and columns derived after the last-K shuffle."""
from pyspark.sql import functions as F

from riskloom.operators.aggspec import Agg, agg_column, eq, gt, isnull, part_columns
from riskloom.operators.rollup import rollup
from riskloom.plans import features as fe

SPECS = [Agg("n", "x", "count"), Agg("m", "x", "mean"), Agg("im", "i", "mean"), Agg("s", "x", "sum"), Agg("hi", "x", "max"),
         Agg("r", "x", "range"), Agg("d", "x", "std"), Agg("sh", "i", "share", gt(2)), Agg("c", "i", "count_if", gt(2)),
         Agg("nul", "x", "share", isnull()), Agg("any", "t", "any", eq("a")), Agg("all", "x", "rows"), Agg("is", "i", "sum", int_sum=True),
         Agg("dm", "dec", "mean")]


def _rows(spark):
    return spark.createDataFrame(
        [(1, 1.5, 1, "a"), (1, None, 3, "b"), (1, -0.25, None, None), (2, None, None, "b"), (3, float("inf"), 4, "a"), (None, 1.0, 1, "a")],
        "k int, x double, i int, t string").withColumn("dec", F.col("i").cast("decimal(10,2)"))


def test_outputs_equal_the_plain_aggregates(spark):
    df = _rows(spark)
    got = rollup(df, "k", SPECS)
    want = df.where("k IS NOT NULL").groupBy("k").agg(*[agg_column(a) for a in SPECS])
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_parts_are_shared():
    means = [Agg("m", "x", "mean"), Agg("n", "x", "count"), Agg("a", "x", "share", gt(0)), Agg("b", "x", "count_if", gt(0))]
    assert len(part_columns(means, {"x"})[0]) == 4  # sum, count, hits, rows


def test_derived_columns_do_not_travel(spark):
    card = spark.createDataFrame([], "SK_ID_PREV bigint, MONTHS_BALANCE int, " + ", ".join(
        f"{c} {'string' if c == 'NAME_CONTRACT_STATUS' else 'double'}" for c in fe.CARD_TIES))
    plan = fe.credit_card_agg(card)._jdf.queryExecution().optimizedPlan().toString()
    limited = plan.split("WindowGroupLimit")[1]
    assert "try_divide" not in limited and " AS loan_rate" not in limited

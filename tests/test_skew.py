"""A hot key holding a third of all rows: results stay exact, and the plan pre-aggregates
(partial aggregate, partial window-group limit) before every shuffle on that key."""
from conftest import SF01
from oracle_compare import compare, duck
from riskloom.functions.rounding import portable_round
from riskloom.plans import features as fe, oracles as orc
from riskloom.sources import adapters

HOT = "CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_orderkey END AS SK_ID_PREV"


def _hot_exprs(view):
    src, where, exprs = adapters.VIEWS[view]
    return src, where, [HOT if e == "l_orderkey AS SK_ID_PREV" else e for e in exprs]


def _spark_view(spark, view):
    src, where, exprs = _hot_exprs(view)
    df = spark.read.parquet(f"{SF01}/{src}.parquet")
    return (df.where(where) if where else df).selectExpr(*[adapters._render(e, "spark") for e in exprs])


def _duck_view(view):
    src, where, exprs = _hot_exprs(view)
    body = ",\n  ".join(adapters._render(e, "duckdb") for e in exprs)
    return f"{view} AS (SELECT {body} FROM {src}" + (f" WHERE {where})" if where else ")")


def test_hot_key_installments(spark):
    inst = _spark_view(spark, "installments")
    assert inst.where("SK_ID_PREV = 1").count() * 4 > inst.count()  # the hot key holds about a third
    got = portable_round(fe.installments_agg(inst))
    sql = orc.round_doubles(f"WITH {_duck_view('installments')},\n{orc._inst_ctes()}\nSELECT * FROM inst_agg")
    assert compare(got, sql, duck(SF01)) == []
    plan = fe.installments_agg(inst)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "WindowGroupLimit" in plan and "Partial" in plan


def test_hot_key_credit_card(spark):
    card = _spark_view(spark, "credit_card")
    got = portable_round(fe.credit_card_agg(card))
    sql = orc.round_doubles(f"WITH {_duck_view('credit_card')},\n{orc._cc_ctes()}\nSELECT * FROM cc_agg")
    assert compare(got, sql, duck(SF01)) == []


def test_hot_key_recency(spark):
    """A third of the instalments under one loan: ranks equal those of a plain window."""
    from pyspark.sql import Window, functions as F

    from riskloom.operators.recency import recency_rank

    inst = _spark_view(spark, "installments").select("SK_ID_PREV", "DAYS_INSTALMENT", *fe.INSTALLMENT_TIES[:3])
    order = ["DAYS_INSTALMENT", *fe.INSTALLMENT_TIES[:3]]
    got = recency_rank(inst, "SK_ID_PREV", order[:1], order[1:]).orderBy("SK_ID_PREV", *order)
    w = Window.partitionBy("SK_ID_PREV").orderBy(*[F.col(c).desc() for c in order])
    expected = inst.withColumn("rank_recency", (F.row_number().over(w) - 1)).orderBy("SK_ID_PREV", *order)
    assert [r["rank_recency"] for r in got.collect()] == [r["rank_recency"] for r in expected.collect()]

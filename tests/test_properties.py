"""Properties over the sf0.01 fixture."""
import math

from pyspark.sql import functions as F

from riskloom.operators import binning
from riskloom.plans import eda, features as fe


def test_bin_counts_add_up_to_non_null_rows(spark, tables01):
    app = tables01.application
    out = eda.all_quantile_bins(app)
    per_feature = {r["feature"]: r["n"] for r in out.groupBy("feature").agg(F.sum("count").alias("n")).collect()}
    for name, expr, _ in eda.quantile_features():
        expected = app.where(expr.isNotNull() & F.col("TARGET").isNotNull()).count()
        assert per_feature[name] == expected, name


def test_rank_edges_equal_the_built_in_percentile(spark, tables01):
    long = binning.stack_features(tables01.application, [(n, e) for n, e, _ in eda.quantile_features()])
    qs = {n: q for n, _, q in eda.quantile_features()}
    got = {r["feature"]: r["edges"] for r in binning.quantile_edges(long, qs).collect()}
    for name, q in qs.items():
        probs = F.array(*[F.lit(p) for p in binning.probabilities(q)])
        expected = sorted(set(long.where(F.col("feature") == name).agg(F.percentile("value", probs)).first()[0]))
        assert len(got[name]) == len(expected)
        assert all(math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-12) for x, y in zip(got[name], expected))


def test_status_shares_add_up(spark, tables01):
    bb = tables01.bureau_balance
    agg = fe.bureau_balance_agg(bb)
    null_share = bb.groupBy("SK_ID_BUREAU").agg(F.avg(F.col("STATUS").isNull().cast("double")).alias("ns"))
    joined = agg.join(null_share, "SK_ID_BUREAU")
    total = (F.col("prepaid_ratio") + F.col("bad_dpd_ratio") + F.col("small_dpd_ratio") + F.col("paid_in_time_ratio")
             + F.col("unknown_ratio") + F.col("ns"))
    assert joined.where(F.abs(total - 1) > 1e-9).count() == 0


def test_counts_agree_with_shares(spark, tables01):
    agg = fe.bureau_balance_agg(tables01.bureau_balance)
    bad = agg.where(F.abs(F.col("bad_dpd_count") - F.col("bad_dpd_ratio") * F.col("loan_duration")) > 1e-6)
    assert bad.count() == 0


def test_every_loan_keeps_one_row(spark, tables01):
    enriched = fe.bureau_enriched(tables01.bureau, fe.bureau_balance_agg(tables01.bureau_balance))
    assert enriched.count() == tables01.bureau.count()
    inst = fe.installments_agg(tables01.installments)
    assert inst.count() == tables01.installments.select("SK_ID_PREV").distinct().count()

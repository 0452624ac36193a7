"""Golden rows for binning, recency, last-K, encoding, split and metrics."""
import math

import pytest
from pyspark.sql import functions as F

from riskloom.operators import binning, encode, metrics, split
from riskloom.operators.aggspec import Agg, gt
from riskloom.operators.recency import recency_rank
from riskloom.operators.rollup import rollup


def _bins(spark, values, q):
    df = spark.createDataFrame([(float(v), 0) for v in values], "x double, TARGET int")
    out = binning.quantile_bin_summary(df, {"x": q})
    return [(r["bin"], r["lo"], r["hi"], r["count"]) for r in out.orderBy("bin").collect()]


def test_quantile_bins(spark):
    got = _bins(spark, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10.5], 4)
    assert [g[3] for g in got] == [3, 2, 2, 3]
    assert [g[1] for g in got] == [1.0, 3.25, 5.5, 7.75]


def test_quantile_bins_duplicate_edges(spark):
    got = _bins(spark, [0, 0, 0, 0, 1, 2, 3], 4)
    assert [(g[0], g[3]) for g in got] == [(1, 5), (2, 2)]
    assert got[0][2] == 1.5


def test_fixed_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 4, 100, 101]], "x double")
    got = [r[0] for r in df.select(binning.fixed_bin("x", [0, 1, 2, 3, 5, 10, 100])).collect()]
    assert got == [None, 1, 2, 4, 6, None]


def test_hour_bands(spark):
    df = spark.createDataFrame([(h,) for h in [5, 6, 12, 18, 23, 0, None]], "h int")
    got = [r[0] for r in df.select(binning.hour_band("h")).collect()]
    assert got == ["night", "morning", "afternoon", "evening", "evening", "night", "night"]


def test_recency_rank(spark):
    df = spark.createDataFrame([(1, 10), (1, 20), (1, 30)], "k int, d int")
    out = recency_rank(df, "k", ["d"], descending=True)
    assert [r["rank_recency"] for r in out.orderBy("d").collect()] == [2, 1, 0]


def test_last_k_small_groups_and_direction(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (1, 3, 3.0), (1, 4, 4.0), (2, 1, 5.0)], "k int, d int, x double")
    specs = [Agg("recent_mean", "x", "last_mean"), Agg("recent_pos", "x", "last_share", gt(2.5)), Agg("n", "x", "count")]
    newest = {r["k"]: r for r in rollup(df, "k", specs, order_by=["d"], k=3, descending=True).collect()}
    oldest = {r["k"]: r for r in rollup(df, "k", specs, order_by=["d"], k=3, descending=False).collect()}
    assert newest[1]["recent_mean"] == 3.0 and oldest[1]["recent_mean"] == 2.0
    assert math.isclose(newest[1]["recent_pos"], 2 / 3) and math.isclose(oldest[1]["recent_pos"], 1 / 3)
    assert newest[2]["recent_mean"] == 5.0 and newest[1]["n"] == 4


def test_label_codes_and_one_hot(spark):
    df = spark.createDataFrame([(1, "N", "x"), (2, "Y", "y"), (3, None, None), (4, "N", "z")], "id int, b string, m string")
    out, vocab = encode.encode(df)
    assert vocab.binary == {"b": ["N", "Y"]} and vocab.onehot == {"m": ["x", "y", "z"]}
    got = [(r["b"], r["m_x"], r["m_y"], r["m_z"]) for r in out.orderBy("id").collect()]
    assert got == [(0, 1, 0, 0), (1, 0, 1, 0), (None, 0, 0, 0), (0, 0, 0, 1)]


def test_vocabulary_has_no_limit_and_unique_names(spark):
    df = spark.createDataFrame([(f"v{i:04d}",) for i in range(1500)] + [("A B",), ("A-B",)], "k string")
    vocab = encode.fit_vocabulary(df)
    names = vocab.onehot_names()
    assert len(vocab.onehot["k"]) == len(set(names)) == 1502 and {"k_A_B", "k_A_B_2"} <= set(names)
    few = spark.createDataFrame([("A B",), ("A-B",), ("c",)], "k string")
    out = encode.one_hot(few, encode.fit_vocabulary(few))
    assert out.columns == ["k_A_B", "k_A_B_2", "k_c"] and sorted(map(tuple, out.collect())) == [(0, 0, 1), (0, 1, 0), (1, 0, 0)]


def test_constant_feature_has_no_bins(spark):
    assert _bins(spark, [2, 2, 2], 4) == []


def test_exact_split_keeps_rows_without_label(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, None), (4, 0)], "k int, y int")
    out = split.hash_split(df, "k", split.THREE_WAY, label="y", exact=True)
    assert sorted(r["k"] for r in out.collect()) == [1, 2, 3, 4]


def test_auc_of_large_counts_and_nulls(spark):
    big = spark.createDataFrame([(0.0, 0), (1.0, 1)], "score double, label int")
    counts = big.withColumn("n", F.lit(4_000_000_000))
    pos, neg = counts.agg(F.sum(F.col("n") * F.col("label")), F.sum(F.col("n") * (1 - F.col("label")))).first()
    assert float(pos) * float(neg) > 9.3e18  # such counts overflow a product of longs; the metric multiplies doubles
    assert metrics.auc(big).first()["auc"] == 1.0
    for bad in [(None, 1), (0.5, None)]:
        with pytest.raises(Exception, match="null in one of"):
            metrics.auc(spark.createDataFrame([(0.0, 0), (1.0, 1), bad], "score double, label int")).collect()


def test_rounding_keeps_large_and_special_values(spark):
    from riskloom.functions.rounding import portable_round

    values = [1e13, -1e13, float("inf"), float("nan"), 0.5, 1 / 3, -1 / 3, None]
    got = [r[0] for r in portable_round(spark.createDataFrame([(v,) for v in values], "x double")).collect()]
    assert got[:3] == values[:3] and math.isnan(got[3]) and got[4] == 0.5 and got[7] is None
    assert got[5] == math.floor(2**20 / 3 + 0.5) / 2**20 and got[6] == math.floor(-(2**20) / 3 + 0.5) / 2**20


def test_median_is_mean_of_middles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    long = binning.stack_features(df, ["x"])
    got = binning.quantile_values(long, {"x": [0.5]}).first()["value"]
    assert got == 2.5


def test_hash_split_disjoint_and_shares(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    out = split.hash_split(df, "k")
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert sum(counts.values()) == 20000
    for name, frac in split.THREE_WAY:
        sd = math.sqrt(20000 * frac * (1 - frac))
        assert abs(counts[name] - 20000 * frac) < 3 * sd


def test_exact_stratified_split(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    out = split.hash_split(df, "k", split.THREE_WAY, label="y", exact=True)
    counts = {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()}
    assert counts[(1, "train")] == 70 and counts[(0, "train")] == 630


def _scored(spark, pairs):
    return spark.createDataFrame([(float(s), int(y)) for s, y in pairs], "score double, label int")


def test_auc_ties_and_invariance(spark):
    pairs = [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)]
    base = metrics.auc(_scored(spark, pairs)).first()["auc"]
    # hand count: pos 0.35 beats 0.1 (1); 0.8 beats both (2); 0.4 beats 0.1, ties 0.4 (1.5) -> 4.5 / 6
    assert math.isclose(base, 4.5 / 6)
    mono = metrics.auc(_scored(spark, [(s * 10 + 3, y) for s, y in pairs])).first()["auc"]
    neg = metrics.auc(_scored(spark, [(-s, y) for s, y in pairs])).first()["auc"]
    assert math.isclose(mono, base) and math.isclose(neg, 1 - base)


def test_threshold_sweep_recall_non_increasing(spark):
    pairs = [(i / 50, int(i % 3 == 0)) for i in range(50)]
    sweep = metrics.threshold_sweep(_scored(spark, pairs)).orderBy("threshold").collect()
    recalls = [r["recall"] for r in sweep]
    assert len(sweep) == 9 and all(a >= b for a, b in zip(recalls, recalls[1:]))
    empty = metrics.threshold_sweep(_scored(spark, [(0.05, 1), (0.0, 0)])).orderBy("threshold").collect()
    assert all(r["precision"] == 0.0 for r in empty)


def test_prefix_sums_match_running_sum(spark):
    from riskloom.operators.prefix import prefix_sums

    df = spark.range(1, 501).select(F.lit("g").alias("g"), F.col("id").alias("o"), F.col("id").alias("v"))
    out = prefix_sums(df, "g", "o", ["v"], partitions=7)
    got = {r["o"]: (r["v_before"], r["v_total"]) for r in out.collect()}
    assert got[1] == (0, 125250) and got[500] == (sum(range(1, 500)), 125250)

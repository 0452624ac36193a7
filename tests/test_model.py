"""Model rows: regularisation mapping vs a Newton solve, planted signal, determinism."""
import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from riskloom.operators import metrics
from riskloom.operators import model as ml


def _newton(X, y, w, C=1.0, iters=50):
    n, d = X.shape
    Xb = np.hstack([X, np.ones((n, 1))])
    beta = np.zeros(d + 1)
    reg = np.eye(d + 1) / C
    reg[-1, -1] = 0.0  # intercept not penalised
    for _ in range(iters):
        p = 1 / (1 + np.exp(-Xb @ beta))
        g = Xb.T @ (w * (p - y)) + reg @ beta
        H = Xb.T @ (Xb * (w * p * (1 - p))[:, None]) + reg
        beta -= np.linalg.solve(H, g)
    return beta


def test_lr_matches_weighted_l2_objective(spark):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(60, 2))
    y = (X[:, 0] - 0.5 * X[:, 1] + rng.normal(scale=1.5, size=60) > 0.3).astype(float)
    w = np.where(y == 1, 60 / (2 * y.sum()), 60 / (2 * (60 - y.sum())))
    expected = _newton(X, y, w)
    schema = StructType([StructField("features", VectorUDT()), StructField("TARGET", DoubleType()),
                         StructField("class_weight", DoubleType())])
    df = spark.createDataFrame([(Vectors.dense(x.tolist()), float(t), float(v)) for x, t, v in zip(X, y, w)], schema)
    lr = LogisticRegression(labelCol="TARGET", weightCol="class_weight", regParam=1.0 / w.sum(), elasticNetParam=0.0,
                            standardization=False, maxIter=1000, tol=1e-10).fit(df)
    got = np.array(list(lr.coefficients) + [lr.intercept])
    assert np.allclose(got, expected, atol=1e-4)


def _planted(spark, n=3000):
    df = spark.range(n).select(
        F.col("id").alias("SK_ID_CURR"),
        (F.col("id") % 97 / 97.0).alias("x1"),
        ((F.col("id") * 31) % 89 / 89.0).alias("x2"),
    )
    df = df.withColumn("TARGET", ((F.col("x1") * 2 + F.col("x2") * 0.3) > 1.2).cast("int"))
    df = df.withColumn("split", F.when(F.col("SK_ID_CURR") % 4 == 0, "validation").otherwise("train"))
    return ml.with_class_weights(df)


def test_planted_signal_lr_and_gbt(spark):
    df = _planted(spark)
    train = df.where("split = 'train'")
    fit = ml.fit_lr(train, ["x1", "x2"], max_iter=200)
    aucs = {r["split"]: r["auc"] for r in ml.evaluate(fit, df, ["train", "validation"]).collect()}
    assert aucs["validation"] > 0.9
    gbt = ml.fit_gbt(train, ["x1", "x2"], ml.GbtParams(rounds=5, colsample="all"))
    g = {r["split"]: r["auc"] for r in ml.evaluate(gbt, df, ["validation"]).collect()}
    assert g["validation"] > 0.9
    imp = {r["feature"]: r["importance"] for r in ml.importances(gbt).collect()}
    assert imp["x1"] > imp["x2"] and abs(sum(imp.values()) - 1) < 1e-9


def test_same_seed_same_metrics(spark):
    df = _planted(spark, 1000)
    train = df.where("split = 'train'")
    a = ml.evaluate(ml.fit_gbt(train, ["x1", "x2"], ml.GbtParams(rounds=3)), df, ["validation"]).first()["auc"]
    b = ml.evaluate(ml.fit_gbt(train, ["x1", "x2"], ml.GbtParams(rounds=3)), df, ["validation"]).first()["auc"]
    assert a == b


def test_medians_and_all_null_column_dropped(spark):
    df = spark.createDataFrame([(1.0, None, 1), (2.0, None, 0), (3.0, None, 1), (4.0, None, 0)],
                               "a double, b double, TARGET int").withColumn("split", F.lit("train"))
    med = ml.fit_medians(df, ["a", "b"])
    assert med == {"a": 2.5}


def test_univariate_selection_ranks_signal_first(spark):
    df = _planted(spark, 2000)
    noise = df.withColumn("x3", (F.col("SK_ID_CURR") * 7 % 13) / 13.0)
    picked = ml.univariate_select(noise.where("split = 'train'"), ["x1", "x2", "x3"], k=1)
    assert picked == ["x1"]


def test_f_scores_equal_the_definition_and_rank_strong_features(spark):
    """p-values underflow for strong features; F does not. Values with a large offset keep their digits."""
    import numpy as np

    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 4000)
    x = np.c_[y * 1.0 + rng.normal(size=4000), y * 9.0 + rng.normal(size=4000), 1e9 + rng.normal(size=4000), np.full(4000, 7.0)]
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "x1 double, x2 double, x3 double, x4 double, TARGET int")
    got = ml.f_scores(df, ["x1", "x2", "x3", "x4"])
    for j, name in enumerate(["x1", "x2", "x3"]):
        a, b = x[y == 0, j], x[y == 1, j]
        between = len(a) * (a.mean() - x[:, j].mean()) ** 2 + len(b) * (b.mean() - x[:, j].mean()) ** 2
        within = ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()
        assert abs(got[name] - between / (within / 3998)) <= 1e-4 * max(1, got[name])
    assert got["x4"] == 0.0
    assert ml.univariate_select(df, ["x1", "x2", "x3", "x4"], k=2) == ["x2", "x1"]


def test_fitted_coefficients_zero_the_gradient(spark):
    """At the fitted coefficients the gradient of the weighted, regularised loss is zero to the solver's tolerance."""
    import numpy as np

    df = ml.with_class_weights(_planted(spark, 1500)).where("split = 'train'")
    fit = ml.fit_lr(df, ["x1", "x2"])
    scaler, lr = fit.model.stages[1], fit.model.stages[2]
    rows = np.array([(r.x1, r.x2, r.TARGET, r.class_weight) for r in df.collect()], float)
    x = (rows[:, :2] - scaler.mean.toArray()) / scaler.std.toArray()
    y, w, b = rows[:, 2], rows[:, 3], lr.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ b + lr.intercept)))
    gradient = ((w * (p - y))[:, None] * x).sum(0) / w.sum() + b / w.sum()
    assert np.abs(gradient).max() < 5e-3 and abs((w * (p - y)).sum() / w.sum()) < 5e-3


def test_sweep_pick_threshold(spark):
    scored = spark.createDataFrame([(i / 20, int(i >= 12)) for i in range(20)], "score double, label int")
    sweep = metrics.threshold_sweep(scored)
    best = metrics.pick_threshold(sweep, 0.99).first()
    assert best["recall"] == 1.0 and best["threshold"] == 0.6


def test_a_fit_keeps_its_own_columns_on_disk(spark):
    rows = [(i, i % 2, float(i), "x", 1.0) for i in range(10)]
    train = spark.createDataFrame(rows, "SK_ID_CURR long, TARGET int, a double, other string, class_weight double")
    kept = ml._kept(train, ["a"], {"a": 1.0})
    assert kept.columns == ["a", "TARGET", "class_weight"]
    assert kept.storageLevel.useDisk and not kept.storageLevel.useMemory
    kept.unpersist()


def test_trees_need_no_table_of_node_ids(spark):
    """Spark keeps no node id of each row between the levels of a tree; the trees are those of a fit that does."""
    train = _planted(spark, 800).where("split = 'train'")
    pipeline = ml.gbt_pipeline(["x1", "x2"], ml.GbtParams(rounds=3))
    assert not pipeline.getStages()[-1].getCacheNodeIds()
    plain = pipeline.fit(train).stages[-1].toDebugString
    pipeline.getStages()[-1].setCacheNodeIds(True)
    named = lambda text: text.split("\n", 1)[1]  # noqa: E731  (the first line has the uid)
    assert named(plain) == named(pipeline.fit(train).stages[-1].toDebugString)

"""Models: median imputation, logistic regression, boosted trees.

Spark ML trains with distributed iterative jobs (one aggregate per L-BFGS
step; one histogram aggregate per tree level). The columns of the fit are kept on
disk for it (Spark ML keeps its own form of the rows in memory), and the tree lineage
is checkpointed every few rounds into the session's shared checkpoint folder.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..session import ensure_checkpoint_dir
from . import metrics, selection

LABEL = "TARGET"
WEIGHT = "class_weight"
SEED = 42


def feature_columns(df: DataFrame, exclude: Sequence[str] = ("SK_ID_CURR", LABEL, "split", WEIGHT)) -> list[str]:
    """M3: every numeric column except id, label, split and weight."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def fit_medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """M6: exact medians (mean of the two middle values, as scikit-learn), fitted on train.

    Radix selection over all columns at once; only one number per column reaches the driver. A column without values has none.
    """
    found = selection.quantiles(train, {c: F.col(f"`{c}`") for c in columns}, {c: [0.5] for c in columns})
    return {c: values[0] for c, values in found.items() if values}


def impute(df: DataFrame, medians: Mapping[str, float]) -> DataFrame:
    return df.fillna({c: float(v) for c, v in medians.items() if v is not None and c in df.columns}) \
        if medians else df


def with_class_weights(df: DataFrame, label: str = LABEL, fit_on: DataFrame | None = None) -> DataFrame:
    """Balanced weights n / (classes * n_class), counted on ``fit_on`` (the train rows) or ``df``:
    one count per class to the driver, then a literal CASE column."""
    counts = {r[0]: r[1] for r in (fit_on if fit_on is not None else df).groupBy(label).count().collect()}
    n = sum(counts.values())
    expr = None
    for k, v in counts.items():
        w = F.lit(n / (len(counts) * v))
        expr = F.when(F.col(label) == k, w) if expr is None else expr.when(F.col(label) == k, w)
    return df.withColumn(WEIGHT, expr)


def _as_double(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def lr_pipeline(features: Sequence[str], n_train_weight: float, c: float = 1.0, max_iter: int = 1000,
                tol: float = 1e-4) -> Pipeline:
    """M8/M9: assemble → standardise → weighted L2 logistic regression.

    scikit-learn minimises C * sum(w * loss) + ||b||^2 / 2; Spark averages the
    weighted loss, so the same optimum needs regParam = 1 / (C * sum(w)).
    Spark's scaler divides by the sample deviation (n - 1), scikit-learn's by
    the population one (n): a factor sqrt(n / (n - 1)) that vanishes at scale.
    ``tol`` is scikit-learn's default stopping tolerance (Spark's is 1e-6).
    """
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="raw_features", handleInvalid="error"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(featuresCol="features", labelCol=LABEL, weightCol=WEIGHT, maxIter=max_iter,
                           regParam=1.0 / (c * n_train_weight), elasticNetParam=0.0, standardization=False,
                           tol=tol),
    ])


@dataclass
class GbtParams:
    """M10. Spark trees grow level-wise: depth 5 allows up to 32 leaves (reference: 31 leaves)."""
    rounds: int = 300
    learning_rate: float = 0.05
    max_depth: int = 5
    subsample: float = 1.0  # D17: the reference's 0.8 has no effect without a bagging frequency
    colsample: str = "0.8"
    seed: int = SEED
    checkpoint_interval: int = 10


def gbt_pipeline(features: Sequence[str], params: GbtParams = GbtParams()) -> Pipeline:
    # no cached node ids: a row finds its node in five comparisons at most, while a cache would be a further
    # table of the rows, made, kept and read again at every level of every tree (the trees are the same)
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error"),
        GBTClassifier(featuresCol="features", labelCol=LABEL, weightCol=WEIGHT, maxIter=params.rounds,
                      stepSize=params.learning_rate, maxDepth=params.max_depth, subsamplingRate=params.subsample,
                      featureSubsetStrategy=params.colsample, seed=params.seed,
                      checkpointInterval=params.checkpoint_interval, cacheNodeIds=False),
    ])


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ("SK_ID_CURR", LABEL, "split")) -> DataFrame:
    """Class-1 probability as ``score``."""
    out = model.transform(df)
    return out.select(*[c for c in keep if c in df.columns], vector_to_array("probability")[1].alias("score"))


@dataclass
class FitResult:
    model: PipelineModel
    features: list[str]
    medians: dict[str, float]


def prepare(table: DataFrame, features: Sequence[str], medians: Mapping[str, float] | None = None) -> DataFrame:
    return _as_double(impute(table, medians or {}), features)


def _kept(train: DataFrame, features: Sequence[str], medians: Mapping[str, float]) -> DataFrame:
    """The prepared columns of a fit, on disk: the few passes before the first step read them, the steps do not."""
    return prepare(train, features, medians).select(*features, LABEL, WEIGHT).persist(StorageLevel.DISK_ONLY)


def fit_lr(train: DataFrame, features: Sequence[str], max_iter: int = 1000,
           medians: Mapping[str, float] | None = None) -> FitResult:
    """Fit M6 + M7 + M8 on the train rows (class weights must be on ``train``; ``medians`` if already fitted)."""
    ensure_checkpoint_dir(train.sparkSession)
    medians = medians or fit_medians(train, features)
    features = [f for f in features if medians.get(f) is not None]  # all-null columns are dropped
    prepared = _kept(train, features, medians)
    n_weight = prepared.agg(F.sum(WEIGHT)).first()[0]
    model = lr_pipeline(features, n_weight, max_iter=max_iter).fit(prepared)
    prepared.unpersist()
    return FitResult(model, list(features), medians)


def fit_gbt(train: DataFrame, features: Sequence[str], params: GbtParams = GbtParams()) -> FitResult:
    ensure_checkpoint_dir(train.sparkSession)
    medians = fit_medians(train, features)
    features = [f for f in features if medians.get(f) is not None]
    prepared = _kept(train, features, medians)
    model = gbt_pipeline(features, params).fit(prepared)
    prepared.unpersist()
    return FitResult(model, list(features), medians)


def evaluate(fit: FitResult, table: DataFrame, splits: Sequence[str] = ("train", "validation", "test")) -> DataFrame:
    """ROC-AUC of the fitted model per split, scored with that model."""
    scored = score(fit.model, prepare(table, fit.features, fit.medians)).where(F.col("split").isin(list(splits)))
    return metrics.auc(scored, "score", LABEL, by="split")


def importances(fit: FitResult) -> DataFrame:
    """Normalised importance per feature, descending (one value per feature: bounded)."""
    tree = fit.model.stages[-1]
    values = tree.featureImportances.toArray().tolist()
    total = sum(values) or 1.0
    rows = sorted(((f, v / total) for f, v in zip(fit.features, values)), key=lambda r: (-r[1], r[0]))
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")


def f_scores(prepared: DataFrame, features: Sequence[str], label: str = LABEL) -> dict[str, float]:
    """The ANOVA F of each feature against the label (``f_classif``), by one aggregate over the rows.

    Per class and feature only count, sum and sum of squares reach the driver; values are taken from the
    feature's value in any one row first, so that large offsets do not cancel digits.
    """
    offset = prepared.select(*features).first()
    if offset is None:
        return {}
    shifted = [F.col(f"`{f}`") - F.lit(float(offset[f] or 0.0)) for f in features]
    rows = prepared.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.count("*").alias("n"),
        *[F.sum(x).alias(f"s{i}") for i, x in enumerate(shifted)],
        *[F.sum(x * x).alias(f"q{i}") for i, x in enumerate(shifted)],
    ).collect()
    n, k = sum(r["n"] for r in rows), len(rows)
    out = {}
    for i, f in enumerate(features):
        total = sum(r[f"s{i}"] for r in rows)
        within = sum(r[f"q{i}"] - r[f"s{i}"] ** 2 / r["n"] for r in rows)
        between = sum(r[f"s{i}"] ** 2 / r["n"] for r in rows) - total**2 / n
        spread = sum(r[f"q{i}"] for r in rows)
        if k < 2 or n <= k or between <= 1e-12 * spread:
            out[f] = 0.0
        else:
            out[f] = math.inf if within <= 1e-12 * spread else (between / (k - 1)) / (within / (n - k))
    return out


def univariate_select(train: DataFrame, features: Sequence[str], k: int = 20,
                      medians: Mapping[str, float] | None = None) -> list[str]:
    """The ``k`` features with the largest ANOVA F against the label; equal F keep the column order."""
    scores = f_scores(prepare(train, features, medians or fit_medians(train, features)), features)
    return sorted(features, key=lambda f: -scores.get(f, 0.0))[:k]


def ablation(train: DataFrame, table: DataFrame, features: Sequence[str], groups: Mapping[str, Sequence[str]],
             max_iter: int = 1000) -> DataFrame:
    """Validation AUC without each whole feature group, and its change against all features.

    Medians are fitted once; every fit has the baseline's step limit.
    """
    medians = fit_medians(train, features)
    base = evaluate(fit_lr(train, features, max_iter, medians), table, ["validation"]).first()["auc"]
    rows = [("none", base, 0.0)]
    for name, cols in groups.items():
        kept = [f for f in features if f not in set(cols)]
        a = evaluate(fit_lr(train, kept, max_iter, medians), table, ["validation"]).first()["auc"]
        rows.append((name, a, a - base))
    return train.sparkSession.createDataFrame(rows, "dropped_group string, validation_auc double, delta_auc double")

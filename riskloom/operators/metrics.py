"""Evaluation: exact ROC-AUC, recall/precision per threshold, threshold choice.

* AUC = sum over distinct scores of pos(s) * (neg below s + neg(s) / 2) / (P * N):
  one aggregate per distinct score and a distributed prefix sum, so ties are
  handled exactly and no task sees all scores. (``BinaryClassificationEvaluator``
  down-samples the curve to 1000 bins by default.)
* The threshold sweep is one aggregate pass with one conditional count per
  threshold; the nine thresholds are ``i / 10`` so both engines compare the
  same doubles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import prefix_sums

THRESHOLDS = [i / 10 for i in range(1, 10)]


def complete(scored: DataFrame, *columns: str) -> DataFrame:
    """``scored``, failing on a row where one of the columns is null: leaving rows out is for the caller to decide and say."""
    missing = F.raise_error(F.lit(f"null in one of {', '.join(columns)}: drop or fill such rows before evaluating"))
    checked = {c: F.when(F.col(c).isNull(), missing.cast(scored.schema[c].dataType)).otherwise(F.col(c)) for c in columns}
    return scored.withColumns(checked)


def auc(scored: DataFrame, score: str = "score", label: str = "label", by: str | None = None) -> DataFrame:
    """One row per ``by`` group (or one row): (auc, n_pos, n_neg). A null score or label is an error."""
    group = F.col(by) if by else F.lit(0)
    by_score = (
        complete(scored, score, label)
        .groupBy(group.alias("auc_group"), F.col(score).cast("double").alias("score"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    )
    cum = prefix_sums(by_score, "auc_group", "score", ["neg"])
    if by:
        cum = cum.groupBy(F.col("auc_group").alias(by))
    return cum.agg(
        F.try_divide(  # null for a group with one class only
            F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") * 0.5)),
            F.sum("pos").cast("double") * F.sum("neg").cast("double"),  # a product of longs would overflow
        ).alias("auc"),
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
    )


def threshold_sweep(scored: DataFrame, score: str = "score", label: str = "label",
                    thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """(threshold, recall, precision, predicted_positive): predicted positive = score >= threshold.

    Precision with no predicted positive is 0 (the scikit-learn convention). A null score or label is an error.
    """
    s, y = F.col(score), F.col(label)
    counts = complete(scored, score, label).agg(
        F.count_if(y == 1).alias("positives"),
        *[F.count_if((s >= F.lit(t)) & (y == 1)).alias(f"tp{i}") for i, t in enumerate(thresholds)],
        *[F.count_if(s >= F.lit(t)).alias(f"pp{i}") for i, t in enumerate(thresholds)],
    )
    rows = counts.select(
        "positives",
        F.explode(F.array(*[
            F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"pp{i}").alias("pp"))
            for i, t in enumerate(thresholds)
        ])).alias("r"),
    )
    return rows.select(
        F.col("r.threshold").alias("threshold"),
        F.coalesce(F.try_divide(F.col("r.tp").cast("double"), F.col("positives").cast("double")), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(F.col("r.tp").cast("double"), F.col("r.pp").cast("double")), F.lit(0.0)).alias("precision"),
        F.col("r.pp").alias("predicted_positive"),
    )


def pick_threshold(sweep: DataFrame, min_recall: float) -> DataFrame:
    """Among thresholds with recall >= ``min_recall``, the one with the best precision
    (ties: the higher threshold, i.e. fewer declined applications). Top-1 is the feature."""
    return (
        sweep.where(F.col("recall") >= F.lit(min_recall))
        .orderBy(F.desc("precision"), F.desc("threshold"))
        .limit(1)
    )

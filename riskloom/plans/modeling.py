"""Train and evaluate: split → impute → scale → classify → AUC → threshold sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, model as ml, split
from ..sources import sinks
from ..sources.committed import Build
from . import processed as pr, specs

# Whole feature groups for the ablation report: every column of a group leaves together.
ABLATION_GROUPS = {
    "ext_sources": ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "ext_source_1_missing", "ext_source_3_missing"],
    "bureau_history": [*specs.bureau_output_columns(), "has_credit_history"],
    "previous_applications": [a.name for a in specs.PREVIOUS],
    "ratios": ["credit_income_ratio", "annuity_income_ratio", "credit_annuity_ratio", "credit_over_goods_price"],
}


def _written(t, name: str) -> DataFrame | None:
    """A table of the feature build (``sinks.build_features`` or a committed one), if ``t`` says where they are (SRC-10)."""
    folder = getattr(t, "features_dir", None)
    if not folder:
        return None
    committed = Build(t.spark, folder)
    return committed.table(name) if committed.exists() else t.spark.read.parquet(f"{folder.rstrip('/')}/{name}")


def model_inputs(t, with_previous: bool = True, parts=split.THREE_WAY) -> tuple[DataFrame, list[str]]:
    """Model table with split and balanced class weights (fitted on the train rows).

    Reads the processed table and the previous-application aggregate where they are written, else builds them.
    """
    with sinks.intermediate(t.spark):
        processed = _written(t, "processed")
        if processed is not None:
            table = pr.model_ratios(pr.history_flags(processed))
            if with_previous:
                table = table.join(_written(t, "previous_agg"), "SK_ID_CURR", "left")
        else:
            extra = (t.previous_application, t.pos_cash, t.installments, t.credit_card) if with_previous else ()
            table, _ = pr.model_table(t.application, t.bureau, t.bureau_balance, *extra)
        # one materialisation as Parquet in the shared checkpoint folder: medians, weights and
        # every optimiser step then read it instead of re-running both history rollups, and a
        # lost executor recomputes from the written table
        with sinks.shuffles_freed(t.spark):
            table = sinks.materialize(table)
    return _prepared(table, parts)


def tree_inputs(t) -> tuple[DataFrame, list[str]]:
    """The tree model's own input: the processed table without the baseline's fills and ratios, 75 / 25."""
    with sinks.intermediate(t.spark):
        processed = _written(t, "processed")
        if processed is None:
            processed, _ = pr.processed_features(t.application, t.bureau, t.bureau_balance)
        with sinks.shuffles_freed(t.spark):
            processed = sinks.materialize(processed)
    return _prepared(processed, split.TWO_WAY)


def _prepared(table: DataFrame, parts) -> tuple[DataFrame, list[str]]:
    with sinks.shuffles_freed(table.sparkSession):
        # stratified on the label, at the exact share of each class; the cuts are literals, so no copy is made
        table = split.hash_split(table, "SK_ID_CURR", parts, label=ml.LABEL, exact=True)
        table = ml.with_class_weights(table, ml.LABEL, fit_on=table.where(F.col("split") == "train"))
    return table, ml.feature_columns(table)


def baseline_scores(t, max_iter: int = 1000) -> DataFrame:
    """Logistic regression, AUC on train / validation / test."""
    table, fit = lr_fit(t, max_iter)
    return ml.evaluate(fit, table)


def baseline_sweep(t, max_iter: int = 1000) -> DataFrame:
    """Recall and precision of the LR validation scores at thresholds 0.1 ... 0.9."""
    table, fit = lr_fit(t, max_iter)
    scored = ml.score(fit.model, ml.prepare(table.where(F.col("split") == "validation"), fit.features, fit.medians))
    return metrics.threshold_sweep(scored, "score", ml.LABEL)


def tree_sweep(t, params: ml.GbtParams = ml.GbtParams()) -> DataFrame:
    """The same sweep on the boosted-tree validation scores."""
    table, fit = tree_fit(t, params)
    scored = ml.score(fit.model, ml.prepare(table.where(F.col("split") == "validation"), fit.features, fit.medians))
    return metrics.threshold_sweep(scored, "score", ml.LABEL)


# Fitted models of this process, so the score, importance and sweep queries of one
# data set share a single training run. The key holds what tells data sets apart: the application, the folder, the
# parameters, and the files of the source tables with their sizes and times, so changed data are trained anew.
_FITS: dict = {}


def _files(t) -> tuple:
    jvm, conf = t.spark.sparkContext._jvm, t.spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(t.sf_dir)
    tables = folder.getFileSystem(conf).listStatus(folder)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in tables))


def _memo(kind: str, t, params, build):
    key = (t.spark.sparkContext.applicationId, t.sf_dir, getattr(t, "features_dir", None), _files(t), kind, repr(params))
    if key not in _FITS:
        _FITS[key] = build()
    return _FITS[key]


def lr_fit(t, max_iter: int = 1000):
    """Baseline: model table with the 70/21/9 split, LR fitted on the train rows."""
    def build():
        table, feats = model_inputs(t)
        return table, ml.fit_lr(table.where(F.col("split") == "train"), feats, max_iter)
    return _memo("lr", t, max_iter, build)


def tree_fit(t, params: ml.GbtParams = ml.GbtParams()):
    """Boosted trees on a 75 / 25 split."""
    def build():
        table, feats = tree_inputs(t)
        return table, ml.fit_gbt(table.where(F.col("split") == "train"), feats, params)
    return _memo("gbt", t, params, build)


def tree_scores(t, params: ml.GbtParams = ml.GbtParams()) -> DataFrame:
    table, fit = tree_fit(t, params)
    return ml.evaluate(fit, table, ["train", "validation"])


def tree_importance(t, params: ml.GbtParams = ml.GbtParams()) -> DataFrame:
    return ml.importances(tree_fit(t, params)[1])


def selected_features(t, k: int = 20) -> DataFrame:
    table, feats = model_inputs(t)
    names = ml.univariate_select(table.where(F.col("split") == "train"), feats, k)
    return table.sparkSession.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "rank int, feature string")


def ablation_report(t, max_iter: int = 1000) -> DataFrame:
    table, feats = model_inputs(t)
    with sinks.shuffles_freed(t.spark):
        return ml.ablation(table.where(F.col("split") == "train"), table, feats, ABLATION_GROUPS, max_iter)


def ext_source_scores(app: DataFrame) -> DataFrame:
    """A deterministic risk score in [0, 1] for the SQL-checkable sweep: 1 - EXT_SOURCE_2, of the applicants that have one."""
    return app.where(F.col("EXT_SOURCE_2").isNotNull()).select(
        "SK_ID_CURR", (F.lit(1.0) - F.col("EXT_SOURCE_2")).alias("score"), F.col("TARGET").alias("label")
    )


def document_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Document length as a score of the quality label (labels ⋈ documents)."""
    return labels.join(documents.select("doc_id", "n_chars"), "doc_id").select(
        F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label")
    )


def class_weights(app: DataFrame) -> DataFrame:
    """M7: balanced weight of each class, counted on the train rows: (TARGET, n, class_weight)."""
    train = split.hash_split(app, "SK_ID_CURR").where("split = 'train'")
    counts = train.groupBy("TARGET").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    return counts.join(F.broadcast(total)).select(  # one row
        "TARGET", "n", (F.col("total") / (F.col("classes") * F.col("n"))).alias("class_weight")
    )


def scaler_stats(app: DataFrame, columns) -> DataFrame:
    """M6 + M7: mean and population deviation of the train rows after median imputation: (feature, mean, std)."""
    train = split.hash_split(app, "SK_ID_CURR").where("split = 'train'").select(*columns)
    filled = ml.prepare(train, columns, ml.fit_medians(train, columns))
    each = [F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")) for c in columns]
    return filled.agg(F.array(*each).alias("stats")).select(F.inline("stats"))  # one row


def f_statistics(app: DataFrame, columns) -> DataFrame:
    """The ANOVA F of each column against TARGET on the train rows: (feature, f_score)."""
    train = split.hash_split(app, "SK_ID_CURR").where("split = 'train'").select("TARGET", *columns)
    scores = ml.f_scores(ml.prepare(train, columns, ml.fit_medians(train, columns)), list(columns))
    return app.sparkSession.createDataFrame(sorted(scores.items()), "feature string, f_score double")


def sweep(app: DataFrame) -> DataFrame:
    return metrics.threshold_sweep(ext_source_scores(app))

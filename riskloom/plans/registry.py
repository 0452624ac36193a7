"""Registered queries: name -> (Spark query, DuckDB oracle SQL or None).

Every query reads whole test tables through the adapter views; double
columns are passed through the portable rounding so the two engines can be
compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.rounding import portable_round
from ..operators import summary
from ..sources import committed, quoted, readers, schemas, sinks
from ..sources.adapters import Tables
from ..operators import encode as enc
from ..operators import binning, metrics, model, sparse, split
from . import build, eda, features as fe, increments, modeling, oracles as orc, processed as pr

SparkQuery = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, tuple[SparkQuery, Callable[[], str] | None]] = {}


def register(name: str, sql: Callable[[], str] | None = None):
    def deco(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from ..session import ensure_defaults

            ensure_defaults(spark)
            return portable_round(fn(Tables(spark, sf_dir)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        _REGISTRY[name] = (run, sql)
        return fn

    return deco


def queries() -> dict[str, SparkQuery]:
    return {name: q for name, (q, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (_, sql) in _REGISTRY.items():
        if sql is None:
            continue
        out[name] = orc.round_doubles(sql())
    return out


def _prev(t: Tables):
    return t.previous_application, t.pos_cash, t.installments, t.credit_card


# ------------------------------------------------------------------ EDA
@register("shape", orc.shape_sql)
def _shape(t):
    return summary.shape(t.application)


@register("head", orc.head_sql)
def _head(t):
    return summary.head(t.application, ["SK_ID_CURR"], 5)


@register("target_distribution", orc.target_distribution_sql)
def _target_distribution(t):
    return eda.target_distribution(t.application)


@register("value_counts_desc", lambda: orc.value_counts_sql("previous_application", "CODE_REJECT_REASON"))
def _value_counts(t):
    return summary.value_counts_desc(t.previous_application, "CODE_REJECT_REASON")


@register("rate_by_category", orc.category_rates_sql)
def _rate_by_category(t):
    return eda.category_rates(t.application)


@register("rate_by_missing", orc.missing_rates_sql)
def _rate_by_missing(t):
    return eda.missing_rates(t.application)


@register("quantile_bins_q10", lambda: orc.quantile_bins_sql(["age_years"]))
def _bins_q10(t):
    return eda.age_bins(t.application)


@register("quantile_bins_q9_floor", lambda: orc.quantile_bins_sql(["income_thousands"]))
def _bins_q9(t):
    return eda.income_bins(t.application)


@register("quantile_bins_ties", lambda: orc.quantile_bins_sql(["REGION_POPULATION_RELATIVE", "OWN_CAR_AGE"]))
def _bins_ties(t):
    return eda.tied_bins(t.application)


@register("multi_feature_bins", orc.quantile_bins_sql)
def _bins_all(t):
    return eda.all_quantile_bins(t.application)


@register("multi_feature_bins_rank", orc.quantile_bins_sql)
def _bins_all_rank(t):
    """The same summaries (there is one path, by rank, whatever the number of distinct values)."""
    return eda.all_quantile_bins(t.application)


@register("fixed_bins_family", lambda: orc.fixed_bins_sql("CNT_FAM_MEMBERS"))
def _fixed_family(t):
    return eda.family_bins(t.application)


@register("fixed_bins_children", lambda: orc.fixed_bins_sql("CNT_CHILDREN"))
def _fixed_children(t):
    return eda.children_bins(t.application)


@register("hour_band", orc.hour_band_sql)
def _hour_band(t):
    return eda.hour_band_rates(t.application)


@register("distinct_per_string_column",
          lambda: orc.distinct_counts_sql(["CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "NAME_INCOME_TYPE"]))
def _distinct(t):
    return summary.distinct_counts(t.application)


# ------------------------------------------------------------------ features
@register("bureau_balance_agg", orc.bureau_balance_agg_sql)
def _bb(t):
    return fe.bureau_balance_agg(t.bureau_balance)


@register("bureau_agg", orc.bureau_agg_sql)
def _bureau(t):
    return fe.bureau_agg(t.bureau, t.bureau_balance)


@register("application_bureau_join", orc.application_bureau_join_sql)
def _app_bureau(t):
    return fe.application_bureau(t.application, t.bureau, t.bureau_balance)


@register("application_bureau_join_reduced", orc.application_bureau_join_sql)
def _app_bureau_reduced(t):
    """J1, J2 with history rows of unknown applicants dropped in the scan."""
    return fe.application_bureau(t.application, t.bureau, t.bureau_balance, reduce=True)


@register("pos_cash_agg", orc.pos_cash_agg_sql)
def _pos(t):
    return fe.pos_cash_agg(t.pos_cash)


@register("installments_agg", orc.installments_agg_sql)
def _inst(t):
    return fe.installments_agg(t.installments)


@register("installments_agg_as_written", lambda: orc.installments_agg_sql(as_written=True))
def _inst_as_written(t):
    return fe.installments_agg(t.installments, as_written=True)


@register("installments_recency", orc.installments_recency_sql)
def _inst_recency(t):
    """W1 + W3: recency rank of every instalment (0 = latest due day) and the recent flag."""
    from ..operators.recency import recency_rank, recent_flag

    inst = t.installments.where("SK_ID_PREV IS NOT NULL").select(
        "SK_ID_PREV", "DAYS_INSTALMENT", "NUM_INSTALMENT_NUMBER", "NUM_INSTALMENT_VERSION", "SK_ID_CURR")
    ranked = recency_rank(inst, "SK_ID_PREV", ["DAYS_INSTALMENT"], fe.INSTALLMENT_TIES[:3], descending=True)
    return ranked.withColumn("is_recent", recent_flag("rank_recency", 3))


@register("credit_card_agg", orc.credit_card_agg_sql)
def _cc(t):
    return fe.credit_card_agg(t.credit_card)


@register("previous_enriched", orc.previous_enriched_sql)
def _prev_enriched(t):
    return fe.previous_enriched(*_prev(t))


@register("previous_agg", orc.previous_agg_sql)
def _prev_agg(t):
    return fe.previous_agg(*_prev(t))


@register("previous_agg_as_written", lambda: orc.previous_agg_sql(as_written=True))
def _prev_agg_as_written(t):
    return fe.previous_agg(*_prev(t), as_written=True)


@register("application_previous_join", orc.application_previous_join_sql)
def _app_prev(t):
    return fe.application_previous(t.application, *_prev(t))


@register("application_previous_join_reduced", orc.application_previous_join_sql)
def _app_prev_reduced(t):
    """J3-J6 with history rows of unknown applicants dropped in the scan."""
    return fe.application_previous(t.application, *_prev(t), reduce=True)


# ------------------------------------------------------------------ encoding and model table
def _app_strings(t):
    app = t.application
    return app, enc.fit_vocabulary(app)


@register("label_encode", orc.label_encode_sql)
def _label_encode(t):
    app, vocab = _app_strings(t)
    return enc.label_encode(app, vocab).select("SK_ID_CURR", *vocab.binary)


@register("one_hot", orc.one_hot_sql)
def _one_hot(t):
    app, vocab = _app_strings(t)
    return enc.one_hot(app.select("SK_ID_CURR", *vocab.onehot), vocab)


@register("application_recode", orc.application_recode_sql)
def _recode(t):
    return pr.processed_features(t.application, t.bureau, t.bureau_balance)[0]


@register("null_report", orc.null_report_sql)
def _null_report(t):
    return summary.null_report(pr.processed_features(t.application, t.bureau, t.bureau_balance)[0])


@register("credit_history_flags", orc.credit_history_flags_sql)
def _history_flags(t):
    return pr.history_flags(pr.processed_features(t.application, t.bureau, t.bureau_balance)[0])


@register("model_ratios", orc.model_ratios_sql)
def _model_ratios(t):
    return pr.model_table(t.application, t.bureau, t.bureau_balance)[0]


@register("model_table_full", orc.model_table_full_sql)
def _model_table_full(t):
    """Everything the models train on: applications, both history chains, recodes, flags, ratios."""
    return pr.model_table(t.application, t.bureau, t.bureau_balance, *_prev(t))[0]


# ------------------------------------------------------------------ rollups from mergeable states
@register("bureau_balance_agg_merged", orc.bureau_balance_agg_sql)
def _bb_merged(t):
    """A11-A20 from states: the rows arrive in three batches, each merged into the written state."""
    return increments.in_batches("bureau_balance", t.bureau_balance)


@register("bureau_agg_merged", orc.bureau_agg_sql)
def _bureau_merged(t):
    enriched = fe.bureau_enriched(t.bureau, increments.in_batches("bureau_balance", t.bureau_balance))
    return fe.with_debt_ratio(increments.in_batches("bureau", enriched))


@register("pos_cash_agg_merged", orc.pos_cash_agg_sql)
def _pos_merged(t):
    return increments.in_batches("pos_cash", t.pos_cash)


@register("installments_agg_merged", orc.installments_agg_sql)
def _installments_merged(t):
    return increments.in_batches("installments", fe.installments_enriched(t.installments))


@register("credit_card_agg_merged", orc.credit_card_agg_sql)
def _card_merged(t):
    return increments.in_batches("credit_card", fe.credit_card_enriched(t.credit_card))


@register("previous_agg_merged", orc.previous_agg_sql)
def _previous_merged(t):
    with sinks.intermediate(t.spark):
        return increments.in_batches("previous", fe.previous_enriched(*_prev(t)))


# ------------------------------------------------------------------ sparse one-hot
@register("one_hot_dictionary", orc.one_hot_dictionary_sql)
def _one_hot_dictionary(t):
    """The vocabulary as a table with dense ids."""
    return sparse.dictionary(t.application, orc.SPARSE_COLUMNS)


@register("one_hot_sparse", orc.one_hot_sparse_sql)
def _one_hot_sparse(t):
    """M2: each application's ids in the vocabulary."""
    rows = t.application.select("SK_ID_CURR", *orc.SPARSE_COLUMNS)
    encoded = sparse.encode(rows, sparse.dictionary(rows, orc.SPARSE_COLUMNS), orc.SPARSE_COLUMNS)
    return encoded.select("SK_ID_CURR", F.array_join(F.transform("one_hot", lambda i: i.cast("string")), ",").alias("one_hot"))


# ------------------------------------------------------------------ split, metrics, models
@register("hash_split", orc.hash_split_sql)
def _hash_split(t):
    return split.hash_split(t.application.select("SK_ID_CURR", "TARGET"), "SK_ID_CURR")


@register("hash_split_exact", orc.hash_split_exact_sql)
def _hash_split_exact(t):
    """Exact per-label shares: rank inside each label by the hash (distributed prefix sums)."""
    return split.hash_split(t.application.select("SK_ID_CURR", "TARGET"), "SK_ID_CURR", label="TARGET", exact=True)


def _medians(t):
    train = split.hash_split(t.application, "SK_ID_CURR").where("split = 'train'")
    return t.spark.createDataFrame(sorted(model.fit_medians(train, orc.MEDIAN_COLUMNS).items()), "feature string, median double")


@register("median_impute", orc.median_impute_sql)
def _median_impute(t):
    return _medians(t)


@register("median_impute_rank", orc.median_impute_sql)
def _median_impute_rank(t):
    """The same medians from stacked rows, by rank."""
    train = split.hash_split(t.application, "SK_ID_CURR").where("split = 'train'")
    values = binning.quantile_values(binning.stack_features(train, orc.MEDIAN_COLUMNS), {c: [0.5] for c in orc.MEDIAN_COLUMNS})
    return values.select("feature", values["value"].alias("median"))


@register("auc_exact", orc.auc_exact_sql)
def _auc(t):
    return metrics.auc(modeling.document_scores(t.raw("documents"), t.raw("labels")))


@register("threshold_sweep", orc.threshold_sweep_sql)
def _sweep(t):
    return modeling.sweep(t.application)


@register("pick_threshold", orc.pick_threshold_sql)
def _pick(t):
    return metrics.pick_threshold(modeling.sweep(t.application), 0.5)


@register("class_weights", orc.class_weights_sql)
def _class_weights(t):
    return modeling.class_weights(t.application)


@register("scaler_stats", orc.scaler_stats_sql)
def _scaler_stats(t):
    return modeling.scaler_stats(t.application, orc.MEDIAN_COLUMNS)


@register("f_statistics", orc.f_statistics_sql)
def _f_statistics(t):
    return modeling.f_statistics(t.application, orc.MEDIAN_COLUMNS)


@register("tree_split", orc.tree_split_sql)
def _tree_split(t):
    """M5: the 75 / 25 split of the tree model."""
    return split.hash_split(t.application.select("SK_ID_CURR", "TARGET"), "SK_ID_CURR", split.TWO_WAY)


@register("tree_split_exact", lambda: orc.hash_split_exact_sql([("train", "0.75e0")], "validation"))
def _tree_split_exact(t):
    """M5 as the tree model uses it: stratified, at the exact shares of each class."""
    return split.hash_split(t.application.select("SK_ID_CURR", "TARGET"), "SK_ID_CURR", split.TWO_WAY, label="TARGET", exact=True)


@register("lr_score")
def _lr_score(t):
    return modeling.baseline_scores(t)


@register("lr_threshold_sweep")
def _lr_sweep(t):
    return modeling.baseline_sweep(t)


@register("gbt_threshold_sweep")
def _gbt_sweep(t):
    return modeling.tree_sweep(t)


@register("gbt_score")
def _gbt_score(t):
    return modeling.tree_scores(t)


@register("gbt_importance")
def _gbt_importance(t):
    return modeling.tree_importance(t)


@register("univariate_select")
def _select(t):
    return modeling.selected_features(t)


@register("ablation")
def _ablation(t):
    return modeling.ablation_report(t)


# ------------------------------------------------------------------ sources and sinks
@register("csv_quoted_cells", orc.csv_quoted_cells_sql)
def _csv_quoted(t):
    """SRC-01..07: cells with commas, quote marks and line breaks, written as CSV and read in parallel."""
    path = sinks.scratch_path(t.spark, "csv")
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    t.raw("documents").select("doc_id", "lang", "text").write.options(header=True, quoteAll=True, escape='"', **keep).csv(path)
    read = quoted.read_raw(t.spark, path)
    return read.select(F.col("doc_id").cast("bigint"), "lang", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


@register("csv_source_roundtrip", lambda: orc._ctes(["application"], [], "SELECT * FROM application"))
def _csv_roundtrip(t):
    """SRC-01 + SRC-11: the application table written as CSV (nulls as 'NA') and read back
    through the existence check, the null tokens and the declared schema."""
    path = sinks.scratch_path(t.spark, "csv")
    t.application.write.option("header", True).option("nullValue", "NA").csv(path)
    readers.check_inputs(t.spark, {"application": path})
    return readers.read_csv(t.spark, path, schemas.APPLICATION)


@register("materialized_bureau_agg", orc.bureau_agg_sql)
def _materialized(t):
    """SNK-01 + SRC-08: the bureau aggregate written to Parquet and read back."""
    return sinks.materialize(fe.bureau_agg(t.bureau, t.bureau_balance))


def _built(t) -> committed.Build:
    """All outputs of the feature build, committed."""
    done = committed.Build(t.spark, sinks.scratch_path(t.spark, "build"))
    sources = {name: getattr(t, name) for name in schemas.SOURCES}
    done.run(build.TABLES, sources, dict.fromkeys(sources, committed.fingerprint(t.spark, t.sf_dir)))
    return done


@register("built_application_bureau_join", orc.application_bureau_join_sql)
def _built_bureau(t):
    """SNK-01..05, SRC-08..10, J2: from committed tables with the same buckets."""
    return build.application_bureau(_built(t))


@register("built_application_previous_join", orc.application_previous_join_sql)
def _built_previous(t):
    """SNK-01..05, SRC-08..10, J6: from committed tables with the same buckets."""
    return build.application_previous(_built(t))


# ------------------------------------------------------------------ small profiles
@register("bureau_column_minimums", orc.bureau_column_minimums_sql)
def _bureau_mins(t):
    """Minimum of every bureau-aggregate column."""
    agg = fe.bureau_agg(t.bureau, t.bureau_balance)
    return summary.column_minimums(agg, [c for c in agg.columns if c != "SK_ID_CURR"])


@register("non_negative_bureau_columns", lambda: orc.bureau_column_minimums_sql(non_negative_only=True))
def _bureau_non_negative(t):
    """Bureau-aggregate columns whose minimum is >= 0 (the optional column selector)."""
    agg = fe.bureau_agg(t.bureau, t.bureau_balance)
    mins = summary.column_minimums(agg, [c for c in agg.columns if c != "SK_ID_CURR"])
    return mins.where(mins["min_value"] >= 0)


@register("null_count", orc.null_count_sql)
def _null_count(t):
    """Missing DAYS_EMPLOYED after the sentinel is cleared."""
    return summary.null_count(eda.employed_missing(t.application), "DAYS_EMPLOYED")


@register("value_counts_yield_group", lambda: orc.value_counts_sql("previous_application", "NAME_YIELD_GROUP"))
def _value_counts_yield(t):
    return summary.value_counts_desc(t.previous_application, "NAME_YIELD_GROUP")


@register("value_counts_pos_status", lambda: orc.value_counts_sql("pos_cash", "NAME_CONTRACT_STATUS"))
def _value_counts_pos(t):
    return summary.value_counts_desc(t.pos_cash, "NAME_CONTRACT_STATUS")


@register("capped_children", orc.capped_children_sql)
def _capped_children(t):
    """P25 (optional in the reference)."""
    return pr.capped_children(t.application.select("SK_ID_CURR", "CNT_CHILDREN"))

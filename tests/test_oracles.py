"""Every registered query with an oracle vs DuckDB at sf0.01 (the correctness gate, run locally)."""
import pytest

import __spark_entry__ as entry
from conftest import SF01
from oracle_compare import compare, duck

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF01)
    assert compare(df, SQL[name], con) == []


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "bureau_agg" not in df.columns


def test_every_survey_query_key_is_registered():
    keys = set(entry.queries())
    expected = {
        "shape", "head", "target_distribution", "value_counts_desc", "null_report", "rate_by_category",
        "rate_by_missing", "quantile_bins_q10", "quantile_bins_q9_floor", "quantile_bins_ties", "multi_feature_bins",
        "fixed_bins_family", "fixed_bins_children", "hour_band", "distinct_per_string_column", "bureau_balance_agg",
        "bureau_agg", "application_bureau_join", "pos_cash_agg", "installments_agg", "installments_agg_as_written",
        "credit_card_agg", "previous_enriched", "previous_agg", "application_previous_join", "label_encode", "one_hot",
        "application_recode", "model_ratios", "credit_history_flags", "hash_split", "median_impute", "auc_exact",
        "threshold_sweep", "pick_threshold", "lr_score", "gbt_score", "gbt_importance", "univariate_select", "ablation",
    }
    assert expected <= keys

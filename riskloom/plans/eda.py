"""Exploratory default-rate summaries over the application table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import floor_div, sentinel_to_null
from ..operators import binning, summary

DAYS_PER_YEAR = 365.25

# Family-size and children bin edges.
FAMILY_EDGES = [0, 1, 2, 3, 5, 10, 100]


def _years(c: str):
    return -F.col(c) / F.lit(DAYS_PER_YEAR)


def quantile_features():
    """(name, expression, q) of the twelve quantile summaries E1-E6, E8-E10, E15-E17."""
    return [
        ("age_years", _years("DAYS_BIRTH"), 10),  # E1 (P1)
        ("income_thousands", floor_div("AMT_INCOME_TOTAL", 1000), 9),  # E2 (P2)
        ("credit_thousands", floor_div("AMT_CREDIT", 1000), 10),  # E3 (P3)
        ("AMT_ANNUITY", F.col("AMT_ANNUITY"), 10),  # E4
        ("REGION_POPULATION_RELATIVE", F.col("REGION_POPULATION_RELATIVE"), 10),  # E5
        ("employed_years", -sentinel_to_null("DAYS_EMPLOYED") / F.lit(DAYS_PER_YEAR), 10),  # E6 (P4)
        ("year_reg_duration", _years("DAYS_REGISTRATION"), 10),  # E8 (P5)
        ("id_reg_duration", _years("DAYS_ID_PUBLISH"), 10),  # E9 (P6)
        ("OWN_CAR_AGE", F.col("OWN_CAR_AGE"), 10),  # E10
        ("EXT_SOURCE_1", F.col("EXT_SOURCE_1"), 10),  # E15
        ("EXT_SOURCE_2", F.col("EXT_SOURCE_2"), 10),  # E16
        ("EXT_SOURCE_3", F.col("EXT_SOURCE_3"), 10),  # E17
    ]


def _subset(names):
    return [f for f in quantile_features() if f[0] in names]


def age_bins(app: DataFrame) -> DataFrame:
    """Default rate per age decile."""
    return binning.quantile_bin_summary(app, _subset({"age_years"}))


def income_bins(app: DataFrame) -> DataFrame:
    """Income in thousands (floor division), 9 bins."""
    return binning.quantile_bin_summary(app, _subset({"income_thousands"}))


def tied_bins(app: DataFrame) -> DataFrame:
    """E5 + E10: few distinct values, so several deciles coincide and edges are dropped."""
    return binning.quantile_bin_summary(app, _subset({"REGION_POPULATION_RELATIVE", "OWN_CAR_AGE"}))


def all_quantile_bins(app: DataFrame) -> DataFrame:
    """All twelve quantile summaries in one edge job and one binning job."""
    return binning.quantile_bin_summary(app, quantile_features())


def family_bins(app: DataFrame) -> DataFrame:
    """E11."""
    return binning.fixed_bin_summary(app, "CNT_FAM_MEMBERS", FAMILY_EDGES)


def children_bins(app: DataFrame) -> DataFrame:
    """E12 (no children falls outside (0, 1] and is dropped, as in the reference)."""
    return binning.fixed_bin_summary(app, "CNT_CHILDREN", FAMILY_EDGES)


def hour_band_rates(app: DataFrame) -> DataFrame:
    """Default rate per application-hour band, highest rate first."""
    banded = app.select(binning.hour_band("HOUR_APPR_PROCESS_START").alias("process_start_group"), "TARGET")
    return summary.target_rate_by(banded, "process_start_group", sort_by_rate=True)


# The categorical columns summarised in E13 and E19.
CATEGORY_COLUMNS = ["CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "REGION_RATING_CLIENT_W_CITY"]


def category_rates(app: DataFrame) -> DataFrame:
    """E13 + E19: (feature, category, count, default_rate) for each categorical column."""
    stacked = app.select(
        "TARGET",
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in CATEGORY_COLUMNS
        ])).alias("s"),
    ).select("s.feature", "s.category", "TARGET")
    rates = summary.target_rate_by(stacked, ["feature", "category"])
    return rates.orderBy("feature", F.desc("default_rate"), "category")  # each column by rate, highest first


def employed_missing(app: DataFrame) -> DataFrame:
    return app.withColumn("DAYS_EMPLOYED", sentinel_to_null("DAYS_EMPLOYED"))


def missing_rates(app: DataFrame) -> DataFrame:
    """E7 + E18: default rate by missing / present, and missing share."""
    return summary.missing_rates(employed_missing(app), ["DAYS_EMPLOYED", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"])


def target_distribution(app: DataFrame) -> DataFrame:
    """Normalised value counts of the target."""
    return summary.value_counts(app, "TARGET", normalize=True)

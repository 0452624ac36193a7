"""Model-ready application table (feature build and model preparation).

application ⋈ bureau aggregate (J2) → recode and fill (P20-P27) → encode
(M1, M2) → processed table (SNK-03) → history flags and fills (P50-P53) →
ratios (P54-P57). The previous-application aggregate joins on the same key
(J6, D3). All steps are column expressions on one row per applicant; the
only shuffles are the rollups and their joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import flag, is_null_flag, not_null_flag, safe_div, sentinel_to_null
from ..operators.encode import Vocabulary, encode
from ..sources import sinks
from . import features as fe
from .specs import bureau_output_columns

# Column lists named by the reference.
EXT_SOURCES = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
ENQUIRY_COLUMNS = [
    "AMT_REQ_CREDIT_BUREAU_HOUR",
    "AMT_REQ_CREDIT_BUREAU_DAY",
    "AMT_REQ_CREDIT_BUREAU_WEEK",
    "AMT_REQ_CREDIT_BUREAU_MON",
    "AMT_REQ_CREDIT_BUREAU_QRT",
    "AMT_REQ_CREDIT_BUREAU_YEAR",
]
MANY_CHILDREN = 3
FILL = -1


def recode(df: DataFrame) -> DataFrame:
    """P20-P27 as one projection. Every expression reads the incoming columns, so the
    missing flags see the values before their fills, as in the reference's order."""
    employed = sentinel_to_null("DAYS_EMPLOYED")
    return df.withColumns({
        "DAYS_EMPLOYED": F.coalesce(employed, F.lit(FILL)),
        "days_employed_missing": is_null_flag(employed),
        "credit_income_ratio": safe_div("AMT_CREDIT", "AMT_INCOME_TOTAL"),
        "annuity_income_ratio": safe_div("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
        "log_income": F.log1p("AMT_INCOME_TOTAL"),
        "log_credit": F.log1p("AMT_CREDIT"),
        "has_many_children": flag(F.col("CNT_CHILDREN") >= MANY_CHILDREN),
        "ext_source_1_missing": is_null_flag("EXT_SOURCE_1"),
        "ext_source_3_missing": is_null_flag("EXT_SOURCE_3"),
        **{c: F.coalesce(F.col(c), F.lit(float(FILL))) for c in EXT_SOURCES},
    })


def capped_children(df: DataFrame, cap: int = MANY_CHILDREN) -> DataFrame:
    """P25 (optional, commented out in the reference): children capped at 3, null kept."""
    c = F.col("CNT_CHILDREN")
    return df.withColumn("cnt_children_capped", F.when(c.isNull(), c).otherwise(F.least(c, F.lit(cap))))


def processed_features(application: DataFrame, bureau: DataFrame, bureau_balance: DataFrame,
                       vocab: Vocabulary | None = None) -> tuple[DataFrame, Vocabulary]:
    """SNK-03 content: J2 + recode + encoding. ``SK_ID_CURR`` is kept (the reference drops it)."""
    df = recode(fe.application_bureau(application, bureau, bureau_balance))
    return encode(df, vocab)


def history_flags(df: DataFrame) -> DataFrame:
    """P50-P53 as one projection: history / enquiry flags read the values before the -1 fills
    (D10: enquiries come from the application)."""
    fills = {c: F.coalesce(F.col(c), F.lit(FILL)) for c in bureau_output_columns() if c in df.columns}
    fills.update({c: F.coalesce(F.col(c), F.lit(float(FILL))) for c in ENQUIRY_COLUMNS if c in df.columns})
    return df.withColumns({
        "has_credit_history": not_null_flag("first_credit_time"),
        "has_credit_enquiries": not_null_flag("AMT_REQ_CREDIT_BUREAU_YEAR"),
        **fills,
    })


def model_ratios(df: DataFrame) -> DataFrame:
    """P54-P57."""
    return df.withColumns({
        "credit_annuity_ratio": safe_div("AMT_ANNUITY", "AMT_CREDIT"),
        "credit_over_goods_price": F.col("AMT_CREDIT") - F.col("AMT_GOODS_PRICE"),
        "days_without_work": F.col("DAYS_BIRTH") - F.col("DAYS_EMPLOYED"),
        "credit_per_family_member": safe_div("AMT_CREDIT", "CNT_FAM_MEMBERS"),
        "annuity_per_family_member": safe_div("AMT_ANNUITY", "CNT_FAM_MEMBERS"),
        "income_per_family_member": safe_div("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
    })


def model_table(application: DataFrame, bureau: DataFrame, bureau_balance: DataFrame,
                previous: DataFrame | None = None, pos_cash: DataFrame | None = None,
                installments: DataFrame | None = None, card: DataFrame | None = None,
                vocab: Vocabulary | None = None) -> tuple[DataFrame, Vocabulary]:
    """The table the models train on: processed features + flags + ratios (+ J6 when given)."""
    df, vocab = processed_features(application, bureau, bureau_balance, vocab)
    df = model_ratios(history_flags(df))
    if previous is not None:
        # written before the bureau chain runs, and what it was made from is deleted: the disk holds one chain at a time
        with sinks.intermediate(previous.sparkSession), sinks.shuffles_freed(previous.sparkSession):
            previous_agg = sinks.bucketed(fe.previous_agg(previous, pos_cash, installments, card), "SK_ID_CURR", "previous",
                                          compression="zstd")
        df = df.join(previous_agg, "SK_ID_CURR", "left")
    return df, vocab

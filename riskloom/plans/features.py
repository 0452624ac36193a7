"""Feature build: history rollups joined to the applications.

Shape of the plan (one lazy DAG per chain, no driver loop):

* bureau chain: bureau_balance --agg(SK_ID_BUREAU)--> J1 --derive--> agg(SK_ID_CURR) --> J2
* previous chain: POS_CASH / installments / credit_card --agg(SK_ID_PREV)--> J3-J5
  --derive--> agg(SK_ID_CURR) --> J6; the three are written one after another, so that the
  disk holds the shuffle of one of them at a time

Every child table is aggregated to one row per key *before* it is joined
(no fan-out), so each join is 1:1 on a unique key and no join key is hot.
Skewed group keys only meet partial aggregation, which pre-combines rows in
every map task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import flag, safe_div, sentinel_to_null
from ..operators import keyset
from ..operators.rollup import rollup
from ..sources import sinks
from . import specs

ACTIVE = "Active"

# The five previous-application day columns that carry the 365243 sentinel.
PREVIOUS_DATE_COLUMNS = [
    "DAYS_FIRST_DRAWING",
    "DAYS_FIRST_DUE",
    "DAYS_LAST_DUE_1ST_VERSION",
    "DAYS_LAST_DUE",
    "DAYS_TERMINATION",
]

# rows with the same due day or month are ordered by these columns of the raw files (all that is left to tell them apart)
INSTALLMENT_TIES = ["NUM_INSTALMENT_NUMBER", "NUM_INSTALMENT_VERSION", "SK_ID_CURR", "DAYS_ENTRY_PAYMENT", "AMT_INSTALMENT",
                    "AMT_PAYMENT"]
CARD_TIES = ["SK_ID_CURR", "AMT_DRAWINGS_ATM_CURRENT", "CNT_DRAWINGS_ATM_CURRENT", "AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL",
             "AMT_DRAWINGS_CURRENT", "AMT_PAYMENT_TOTAL_CURRENT", "AMT_RECEIVABLE_PRINCIPAL", "AMT_RECIVABLE",
             "AMT_TOTAL_RECEIVABLE", "NAME_CONTRACT_STATUS", "CNT_DRAWINGS_CURRENT", "CNT_INSTALMENT_MATURE_CUM", "SK_DPD",
             "SK_DPD_DEF"]
PREVIOUS_TIES = ["SK_ID_PREV"]


def _where(pred: Column, value: Column, other=0) -> Column:
    """``np.where(pred, value, other)``: a null predicate takes ``other``."""
    return F.when(pred, value).otherwise(F.lit(other))


# ---------------------------------------------------------------- bureau chain
def bureau_balance_agg(bureau_balance: DataFrame) -> DataFrame:
    return rollup(bureau_balance, "SK_ID_BUREAU", specs.BUREAU_BALANCE)


def bureau_enriched(bureau: DataFrame, bb_agg: DataFrame) -> DataFrame:
    """J1 + P11-P18."""
    active = F.col("CREDIT_ACTIVE") == F.lit(ACTIVE)
    joined = bureau.join(bb_agg, "SK_ID_BUREAU", "left")
    return joined.withColumns(
        {
            "early_closure_days": F.col("DAYS_CREDIT_ENDDATE") - F.col("DAYS_ENDDATE_FACT"),
            "credit_duration": F.abs(F.col("DAYS_CREDIT") - F.col("DAYS_ENDDATE_FACT")),
            "cnt_curent_overdue": flag(active & (F.col("CREDIT_DAY_OVERDUE") > 0)),
            "overdue_days_active": _where(active, F.col("CREDIT_DAY_OVERDUE")),
            "ever_overdue_flag": flag(F.col("AMT_CREDIT_MAX_OVERDUE") > 0),
            "overdue_ratio": _where(
                F.col("AMT_CREDIT_SUM") > 0,
                F.col("AMT_CREDIT_SUM_OVERDUE") / F.col("AMT_CREDIT_SUM"),
                0.0,
            ),
            "credit_sum_active": _where(active, F.col("AMT_CREDIT_SUM"), 0.0),
            "annuity_active": _where(active, F.col("AMT_ANNUITY"), 0.0),
        }
    )


def bureau_agg(bureau: DataFrame, bureau_balance: DataFrame) -> DataFrame:
    """A20 two-level rollup: balance rows -> loan -> applicant (BU-01..45 + P19)."""
    enriched = bureau_enriched(bureau, bureau_balance_agg(bureau_balance))
    return with_debt_ratio(rollup(enriched, "SK_ID_CURR", specs.BUREAU))


def with_debt_ratio(out: DataFrame) -> DataFrame:
    """P19."""
    return out.withColumn(
        "debt_ratio_mean",
        _where(F.col("credit_sum_mean") > 0, F.col("debt_mean") / F.col("credit_sum_mean"), 0.0),
    )


def bureau_of(application: DataFrame, bureau: DataFrame, bureau_balance: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The loans of these applicants and the balances of those loans (with a few others, see ``keyset``)."""
    bureau = keyset.reduce_to(bureau, "SK_ID_CURR", application)
    return bureau, keyset.reduce_to(bureau_balance, "SK_ID_BUREAU", bureau)


def application_bureau(application: DataFrame, bureau: DataFrame, bureau_balance: DataFrame,
                       reduce: bool = False) -> DataFrame:
    """Left join keeps every application row. ``reduce`` for applicants who are a part of those in the histories."""
    if reduce:
        bureau, bureau_balance = bureau_of(application, bureau, bureau_balance)
    return application.join(bureau_agg(bureau, bureau_balance), "SK_ID_CURR", "left")


# -------------------------------------------------------------- previous chain
def pos_cash_agg(pos_cash: DataFrame) -> DataFrame:
    return rollup(pos_cash, "SK_ID_PREV", specs.POS_CASH)


def installments_enriched(installments: DataFrame) -> DataFrame:
    """P28-P30 (inf from a zero instalment becomes null, as the reference replaces it)."""
    return installments.withColumns(
        {
            "delay_days": F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT"),
            "underpay_amt": F.col("AMT_INSTALMENT") - F.col("AMT_PAYMENT"),
            "payment_ratio": safe_div("AMT_PAYMENT", "AMT_INSTALMENT"),
        }
    )


def installments_agg(installments: DataFrame, as_written: bool = False,
                     tie_break: Sequence[str] = INSTALLMENT_TIES, measure: bool = False) -> DataFrame:
    """IN-01..IN-15. Recent = the 3 latest due days (D6); ``as_written`` takes the 3 oldest. ``measure`` as in ``rollup``."""
    return rollup(
        installments,
        "SK_ID_PREV",
        specs.INSTALLMENTS,
        order_by=["DAYS_INSTALMENT"],
        tie_break=tie_break,
        k=specs.LAST_K,
        descending=not as_written,
        derive=installments_enriched,
        measure=measure,
    )


def credit_card_enriched(card: DataFrame) -> DataFrame:
    """P31-P37."""
    latest_active = (F.col("NAME_CONTRACT_STATUS") == F.lit(ACTIVE)) & (F.col("MONTHS_BALANCE") == -1)
    return card.withColumns(
        {
            "balance_rate": safe_div("AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL"),
            "spend_rate": safe_div("AMT_DRAWINGS_CURRENT", "AMT_BALANCE"),
            "interest_rate": safe_div(
                F.col("AMT_RECIVABLE") - F.col("AMT_RECEIVABLE_PRINCIPAL"), "AMT_RECEIVABLE_PRINCIPAL"
            ),
            "cost_ratio": safe_div("AMT_TOTAL_RECEIVABLE", "AMT_RECEIVABLE_PRINCIPAL"),
            "loan_rate": safe_div("AMT_BALANCE", "AMT_RECEIVABLE_PRINCIPAL"),
            "current_debt": _where(latest_active, F.col("AMT_TOTAL_RECEIVABLE"), 0.0),
            "has_credit_limit": flag(F.col("AMT_CREDIT_LIMIT_ACTUAL") > 0),
            "zero_balance": flag(F.col("AMT_BALANCE") == 0),
            "zero_principal": flag(F.col("AMT_RECEIVABLE_PRINCIPAL") == 0),
        }
    )


def credit_card_agg(card: DataFrame, tie_break: Sequence[str] = CARD_TIES, measure: bool = False) -> DataFrame:
    """CC-01..CC-27; recent = the 3 latest months. ``measure`` as in ``rollup``."""
    return rollup(
        card,
        "SK_ID_PREV",
        specs.CREDIT_CARD,
        order_by=["MONTHS_BALANCE"],
        tie_break=tie_break,
        k=specs.LAST_K,
        descending=True,
        derive=credit_card_enriched,
        measure=measure,
    )


def _approved() -> Column:
    return flag(F.col("NAME_CONTRACT_STATUS").isin("Approved", "Unused offer"))  # D1


def previous_derived(previous: DataFrame) -> DataFrame:
    """P38-P49 on previous applications that already carry the three child aggregates.

    One projection: the sentinel-cleaned day columns and the two status flags are
    expressions reused by the derived columns, so every output reads the cleaned values.
    """
    status = F.col("NAME_CONTRACT_STATUS")
    day = {c: sentinel_to_null(c) for c in PREVIOUS_DATE_COLUMNS}
    approved = _approved()
    refused = flag(status == F.lit("Refused"))  # D1
    return previous.withColumns({
        **day,
        "is_approved": approved,
        "is_refused": refused,
        "approved_annuity": F.col("AMT_ANNUITY") * approved,
        "approved_credit": F.when(approved == 1, F.col("AMT_CREDIT")),
        "refused_credit": F.when(refused == 1, F.col("AMT_CREDIT")),
        "request_diff": F.col("AMT_APPLICATION") - F.col("AMT_CREDIT"),
        "was_disbursed": flag((refused == 0) & day["DAYS_FIRST_DRAWING"].isNotNull()),  # D2
        "grace_period": day["DAYS_FIRST_DUE"] - day["DAYS_FIRST_DRAWING"],
        "delay": day["DAYS_TERMINATION"] - day["DAYS_LAST_DUE_1ST_VERSION"],
        "prolongation": day["DAYS_LAST_DUE"] - day["DAYS_LAST_DUE_1ST_VERSION"],
        "loan_duration": day["DAYS_LAST_DUE_1ST_VERSION"] - day["DAYS_FIRST_DUE"],
        "unpaid_ratio": safe_div("unpaid_inst_cnt", "inst_cnt"),  # D18
    })


def previous_enriched(previous: DataFrame, pos_cash: DataFrame, installments: DataFrame,
                      card: DataFrame) -> DataFrame:
    """J3-J5 (all on SK_ID_PREV: one shuffle of the previous applications serves the three).

    The children are written first, one row per key each, and joined without a further exchange: a plan over all of them
    would keep the shuffles of their rows on disk until its last task ends.
    """
    card_agg = child_written(credit_card_agg(card, measure=True))
    inst_agg = child_written(installments_agg(installments, measure=True))
    return previous_with(previous, child_written(pos_cash_agg(pos_cash)), inst_agg, card_agg)


def child_written(aggregate: DataFrame) -> DataFrame:
    with sinks.shuffles_freed(aggregate.sparkSession):
        return sinks.bucketed(aggregate, "SK_ID_PREV", "child", compression="zstd")


def previous_with(previous: DataFrame, *aggregates: DataFrame) -> DataFrame:
    """J3-J5 on child aggregates (computed here, or written before and read back: SRC-09)."""
    for aggregate in aggregates:
        previous = previous.join(aggregate, "SK_ID_PREV", "left")
    return previous_derived(previous)


def previous_agg(previous: DataFrame, pos_cash: DataFrame, installments: DataFrame, card: DataFrame,
                 as_written: bool = False) -> DataFrame:
    """PREV-01..PREV-94 by SK_ID_CURR; recent = the 3 latest decisions."""
    return previous_rollup(previous_enriched(previous, pos_cash, installments, card), as_written, previous)


def previous_rollup(enriched: DataFrame, as_written: bool = False, previous: DataFrame | None = None) -> DataFrame:
    """``previous``: the rows of ``enriched`` before its joins. The last K read no column of a child, so they are taken there."""
    feature_list = specs.previous_as_written() if as_written else specs.PREVIOUS
    recent = previous.select("SK_ID_CURR", "DAYS_DECISION", *PREVIOUS_TIES, _approved().alias("is_approved")) \
        if previous is not None else None
    return rollup(
        enriched,
        "SK_ID_CURR",
        feature_list,
        order_by=["DAYS_DECISION"],
        tie_break=PREVIOUS_TIES,
        k=specs.LAST_K,
        descending=True,
        recent_rows=recent,
    )


def previous_of(application: DataFrame, previous: DataFrame, *children: DataFrame) -> tuple[DataFrame, ...]:
    """The previous applications of these applicants and the child rows of those (with a few others)."""
    previous = keyset.reduce_to(previous, "SK_ID_CURR", application)
    return previous, *[keyset.reduce_to(child, "SK_ID_PREV", previous) for child in children]


def application_previous(application: DataFrame, previous: DataFrame, pos_cash: DataFrame,
                         installments: DataFrame, card: DataFrame, reduce: bool = False) -> DataFrame:
    """J6 (D3): the previous-application aggregate joined to the applications; ``reduce`` as in J2."""
    if reduce:
        previous, pos_cash, installments, card = previous_of(application, previous, pos_cash, installments, card)
    return application.join(previous_agg(previous, pos_cash, installments, card), "SK_ID_CURR", "left")

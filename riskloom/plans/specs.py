"""Feature lists of the five history rollups, as data.

Fixed values: the output names (misspellings included — names are API),
the category literals and the aggregate kind of each output are those of the
reference workflow and must stay as they are for equal results.
"""

from __future__ import annotations

from ..operators.aggspec import Agg, eq, ge, gt, isin, isnull, le

# Fixed value: number of most recent rows the "recent" features look at.
LAST_K = 3
# Fixed value: "recent application" horizon in days.
YEAR_DAYS = 360

# ---- bureau_balance by SK_ID_BUREAU (BB-01..BB-10) --------------------------------
BUREAU_BALANCE = [
    Agg("loan_duration", "MONTHS_BALANCE", "count"),
    Agg("prepaid_ratio", "STATUS", "share", eq("C")),
    Agg("default_ever", "STATUS", "any", eq("5")),
    Agg("bad_dpd_ratio", "STATUS", "share", isin("2", "3", "4", "5")),
    Agg("bad_dpd_count", "STATUS", "count_if", isin("2", "3", "4", "5")),
    Agg("small_dpd_ratio", "STATUS", "share", eq("1")),
    Agg("small_dpd_count", "STATUS", "count_if", eq("1")),
    Agg("paid_in_time_ratio", "STATUS", "share", eq("0")),
    Agg("paid_in_time_count", "STATUS", "count_if", eq("0")),
    Agg("unknown_ratio", "STATUS", "share", eq("X")),
]

# ---- bureau by SK_ID_CURR (BU-01..BU-45) ---------------------------------------------
BUREAU = [
    Agg("sold_times", "CREDIT_ACTIVE", "count_if", isin("Sold", "Bad debt")),
    Agg("closed_ratio", "CREDIT_ACTIVE", "share", eq("Closed")),
    Agg("active_credits", "CREDIT_ACTIVE", "count_if", eq("Active")),
    Agg("first_credit_time", "DAYS_CREDIT", "min"),
    Agg("overdue_days_mean", "CREDIT_DAY_OVERDUE", "mean"),
    Agg("overdue_days_active_mean", "overdue_days_active", "mean"),
    Agg("overdue_active_max", "CREDIT_DAY_OVERDUE", "max"),
    Agg("overdue_historical_max", "AMT_CREDIT_MAX_OVERDUE", "max"),
    Agg("loans_ever_overdue", "ever_overdue_flag", "sum", int_sum=True),
    Agg("loans_overdue_ratio", "ever_overdue_flag", "mean"),
    Agg("overdue_credits_active", "cnt_curent_overdue", "sum", int_sum=True),
    Agg("overdue_ammount_active", "AMT_CREDIT_SUM_OVERDUE", "sum"),
    Agg("overdue_ratio_max", "overdue_ratio", "max"),
    Agg("early_closure_days_ratio", "early_closure_days", "mean"),
    Agg("credit_duration_mean", "credit_duration", "mean"),
    Agg("prolonged_max", "CNT_CREDIT_PROLONG", "max"),
    Agg("prolonged_times", "CNT_CREDIT_PROLONG", "sum", int_sum=True),
    Agg("credit_sum_mean", "AMT_CREDIT_SUM", "mean"),
    Agg("active_credit_sum", "credit_sum_active", "sum"),
    Agg("debt_max", "AMT_CREDIT_SUM_DEBT", "max"),
    Agg("debt_mean", "AMT_CREDIT_SUM_DEBT", "mean"),
    Agg("credit_limit_max", "AMT_CREDIT_SUM_LIMIT", "max"),
    Agg("has_credit_card", "CREDIT_TYPE", "any", eq("Credit card")),
    Agg("credit_card_cnt", "CREDIT_TYPE", "count_if", eq("Credit card")),
    Agg("low_risk_loans", "CREDIT_TYPE", "count_if", isin("Car loan", "Mortgage", "Loan for business development")),
    Agg("has_microloan", "CREDIT_TYPE", "any", eq("Microloan")),
    Agg("consumer_credit_sum", "CREDIT_TYPE", "count_if", eq("Consumer credit")),
    Agg("last_credit_update", "DAYS_CREDIT_UPDATE", "max"),
    Agg("first_credit_update", "DAYS_CREDIT_UPDATE", "min"),
    Agg("current_annuity", "annuity_active", "sum"),
    Agg("annuity_mean", "AMT_ANNUITY", "mean"),
    Agg("loan_duration_avg", "loan_duration", "mean"),
    Agg("loan_duration_max", "loan_duration", "max"),
    Agg("prepaid_ratio_avg", "prepaid_ratio", "mean"),
    Agg("defaults", "default_ever", "sum", int_sum=True),
    Agg("worst_dpd", "bad_dpd_ratio", "max"),
    Agg("bad_dpd_avg", "bad_dpd_ratio", "mean"),
    Agg("bad_dpd_cnt", "bad_dpd_count", "sum", int_sum=True),
    Agg("bad_dpd_times_max", "bad_dpd_count", "max"),
    Agg("bigest_small_dpd", "small_dpd_ratio", "max"),
    Agg("small_dpd_avg", "small_dpd_ratio", "mean"),
    Agg("small_dpd_cnt", "small_dpd_count", "sum", int_sum=True),
    Agg("paid_in_time_avg", "paid_in_time_ratio", "mean"),
    Agg("paid_in_time_cnt", "paid_in_time_count", "sum", int_sum=True),
    Agg("unkown_ratio_avg", "unknown_ratio", "mean"),
]

# ---- POS_CASH_balance by SK_ID_PREV (PC-01..PC-06) ----------------------------------
POS_CASH = [
    Agg("max_cnt_installment", "CNT_INSTALMENT", "max"),
    Agg("is_completed", "NAME_CONTRACT_STATUS", "any", eq("Completed")),
    Agg("sk_dpd_days", "SK_DPD", "mean"),
    Agg("sk_dpd_max", "SK_DPD", "max"),
    Agg("sk_dpd_def_days", "SK_DPD_DEF", "mean"),
    Agg("sk_dpd_def_max", "SK_DPD_DEF", "max"),
]

# ---- installments_payments by SK_ID_PREV (IN-01..IN-15); order: due day -------------
INSTALLMENTS = [
    Agg("inst_cnt", "AMT_INSTALMENT", "count"),
    Agg("payments_duration", "DAYS_INSTALMENT", "range"),
    Agg("delay_days_mean", "delay_days", "mean"),
    Agg("delay_days_max", "delay_days", "max"),
    Agg("delay_freq_mean", "delay_days", "share", gt(0)),
    Agg("underpay_amt_max", "underpay_amt", "max"),
    Agg("underpay_freq_mean", "underpay_amt", "share", gt(0)),
    Agg("overpay_freq_mean", "underpay_amt", "share", le(0)),
    Agg("payment_ratio_min", "payment_ratio", "min"),
    Agg("delay_days_std", "delay_days", "std"),
    Agg("payment_ratio_std", "payment_ratio", "std"),
    Agg("delay_recent_max", "delay_days", "last_max"),
    Agg("delay_recent_mean", "delay_days", "last_mean"),
    Agg("underpay_recent_freq", "underpay_amt", "last_share", gt(0)),
    Agg("unpaid_inst_cnt", "DAYS_ENTRY_PAYMENT", "count_if", isnull()),
]

# ---- credit_card_balance by SK_ID_PREV (CC-01..CC-27); order: month, newest first ---
CREDIT_CARD = [
    Agg("has_credit_card", "MONTHS_BALANCE", "count"),
    Agg("cc_limit_max", "AMT_CREDIT_LIMIT_ACTUAL", "max"),
    Agg("cc_spend_mean", "spend_rate", "mean"),
    Agg("cc_balance_rate", "balance_rate", "mean"),
    Agg("cc_payment_mean", "AMT_PAYMENT_TOTAL_CURRENT", "mean"),
    Agg("cc_interest_mean", "interest_rate", "mean"),
    Agg("cc_cost_mean", "cost_ratio", "mean"),
    Agg("cc_cost_worst", "cost_ratio", "max"),
    Agg("cc_loan_rate_mean", "loan_rate", "mean"),
    Agg("cc_loan_rate_worst", "loan_rate", "min"),
    Agg("cc_dpd_max", "SK_DPD", "max"),
    Agg("cc_dpd", "SK_DPD", "sum", int_sum=True),
    Agg("cc_dpd_freq", "SK_DPD", "share", gt(0)),
    Agg("cc_dpd_def_max", "SK_DPD_DEF", "max"),
    Agg("cc_dpd_def", "SK_DPD_DEF", "sum", int_sum=True),
    Agg("cc_dpd_def_freq", "SK_DPD_DEF", "share", gt(0)),
    Agg("cc_draw_mean", "CNT_DRAWINGS_CURRENT", "mean"),
    Agg("cc_inst_mean", "CNT_INSTALMENT_MATURE_CUM", "mean"),
    Agg("cc_has_limit_mean", "has_credit_limit", "mean"),
    Agg("cc_zero_balance_mean", "zero_balance", "mean"),
    Agg("cc_zero_principal_mean", "zero_principal", "mean"),
    Agg("cc_recent_limit_max", "AMT_CREDIT_LIMIT_ACTUAL", "last_max"),
    Agg("cc_recent_dpd_freq", "SK_DPD", "last_share", gt(0)),
    Agg("cc_recent_dpd_max", "SK_DPD", "last_max"),
    Agg("cc_recent_balance_rate", "balance_rate", "last_mean"),
    Agg("cc_recent_loan_rate", "loan_rate", "last_mean"),
    Agg("cc_current_debt", "current_debt", "sum"),
]

# ---- previous_application by SK_ID_CURR (PREV-01..PREV-94); order: decision day, newest first
# Defects fixed as SURVEY §0.1 decides: D4 (two cost outputs), D5 (mean), D7 (count of
# recent rows), D8 (max = latest), D9 (max), D19 (prev_ prefix). The as-written
# variants are in PREVIOUS_AS_WRITTEN_OVERRIDES.
PREVIOUS = [
    Agg("prev_PC_installment_mean", "max_cnt_installment", "mean"),
    Agg("prev_dpd_max", "sk_dpd_max", "max"),
    Agg("prev_PC_dpd_mean", "sk_dpd_days", "mean"),
    Agg("prev_PC_dpd_def_max", "sk_dpd_def_max", "max"),
    Agg("prev_PC_dpd_def_mean", "sk_dpd_def_days", "mean"),
    Agg("prev_PC_completed_mean", "is_completed", "mean"),
    Agg("prev_inst_mean", "inst_cnt", "mean"),
    Agg("prev_inst_duration_max", "payments_duration", "max"),
    Agg("prev_inst_duration_mean", "payments_duration", "mean"),
    Agg("prev_inst_delay_max", "delay_days_max", "max"),
    Agg("prev_inst_delay_mean", "delay_days_mean", "mean"),
    Agg("prev_inst_delay_freq_mean", "delay_freq_mean", "mean"),
    Agg("prev_inst_underpay_amt_max", "underpay_amt_max", "max"),
    Agg("prev_inst_underpay_freq_mean", "underpay_freq_mean", "mean"),
    Agg("prev_inst_overpay_freq_mean", "overpay_freq_mean", "mean"),
    Agg("prev_inst_payment_ratio_mean", "payment_ratio_min", "mean"),
    Agg("prev_inst_payment_ratio_worst", "payment_ratio_min", "min"),
    Agg("prev_inst_delay_std_max", "delay_days_std", "max"),
    Agg("prev_inst_delay_std_mean", "delay_days_std", "mean"),
    Agg("prev_inst_delay_std_std", "delay_days_std", "std"),
    Agg("prev_inst_pay_ratio_std_max", "payment_ratio_std", "max"),
    Agg("prev_inst_pay_ratio_std_mean", "payment_ratio_std", "mean"),
    Agg("prev_inst_pay_ratio_std_std", "payment_ratio_std", "std"),
    Agg("prev_inst_delay_recent_max", "delay_recent_max", "max"),
    Agg("prev_inst_delay_recent_mean", "delay_recent_mean", "mean"),
    Agg("prev_inst_underpay_recent_freq", "underpay_recent_freq", "mean"),
    Agg("prev_inst_unpaid_ratio_max", "unpaid_ratio", "max"),
    Agg("prev_inst_unpaid_ratio_mean", "unpaid_ratio", "mean"),
    Agg("prev_has_credit_card", "has_credit_card", "any", gt(0)),
    Agg("prev_cc_limit_max", "cc_limit_max", "max"),
    Agg("prev_cc_spend_mean", "cc_spend_mean", "mean"),
    Agg("prev_cc_balance_rate_mean", "cc_balance_rate", "mean"),
    Agg("prev_cc_balance_rate_max", "cc_balance_rate", "max"),
    Agg("prev_cc_payment_mean", "cc_payment_mean", "mean"),
    Agg("prev_cc_interest_mean", "cc_interest_mean", "mean"),
    Agg("prev_cc_cost_mean", "cc_cost_mean", "mean"),
    Agg("prev_cc_cost_max", "cc_cost_worst", "max"),
    Agg("prev_cc_loan_rate_mean", "cc_loan_rate_mean", "mean"),
    Agg("prev_cc_loan_rate_worst", "cc_loan_rate_worst", "min"),
    Agg("prev_cc_dpd_max", "cc_dpd_max", "max"),
    Agg("prev_cc_dpd_mean", "cc_dpd", "mean"),
    Agg("prev_cc_dpd_freq", "cc_dpd_freq", "mean"),
    Agg("prev_cc_dpd_def_max", "cc_dpd_def_max", "max"),
    Agg("prev_cc_dpd_def", "cc_dpd_def", "mean"),
    Agg("prev_cc_dpd_def_freq", "cc_dpd_def_freq", "mean"),
    Agg("prev_cc_draw_mean", "cc_draw_mean", "mean"),
    Agg("prev_cc_inst_mean", "cc_inst_mean", "mean"),
    Agg("prev_cc_has_limit_mean", "cc_has_limit_mean", "mean"),
    Agg("prev_cc_zero_balance_mean", "cc_zero_balance_mean", "mean"),
    Agg("prev_cc_zero_principal_mean", "cc_zero_principal_mean", "mean"),
    Agg("prev_cc_recent_limit_max", "cc_recent_limit_max", "max"),
    Agg("prev_cc_recent_dpd_freq", "cc_recent_dpd_freq", "mean"),
    Agg("prev_cc_recent_dpd_max", "cc_recent_dpd_max", "max"),
    Agg("prev_cc_recent_balance_rate", "cc_recent_balance_rate", "mean"),
    Agg("prev_cc_recent_loan_rate", "cc_recent_loan_rate", "mean"),
    Agg("cc_current_debt", "cc_current_debt", "sum"),
    Agg("prev_annuity_mean", "approved_annuity", "mean"),
    Agg("prev_annuity_max", "approved_annuity", "max"),
    Agg("prev_credit_mean", "approved_credit", "mean"),
    Agg("prev_credit_max", "approved_credit", "max"),
    Agg("prev_refused_credit_mean", "refused_credit", "mean"),
    Agg("prev_refused_credit_max", "refused_credit", "max"),
    Agg("prev_request_diff_mean", "request_diff", "mean"),
    Agg("prev_applic_cnt", "SK_ID_PREV", "count"),
    Agg("prev_approved_cnt", "is_approved", "sum", int_sum=True),
    Agg("prev_refused_cnt", "is_refused", "sum", int_sum=True),
    Agg("prev_downpayment_mean", "AMT_DOWN_PAYMENT", "mean"),
    Agg("prev_downpayment_max", "AMT_DOWN_PAYMENT", "max"),
    Agg("prev_no_downpayment_mean", "AMT_DOWN_PAYMENT", "share", isnull()),
    Agg("prev_downpayment_rate_mean", "RATE_DOWN_PAYMENT", "mean"),
    Agg("prev_downpayment_rate_max", "RATE_DOWN_PAYMENT", "max"),
    Agg("prev_refused_sco_cnt", "CODE_REJECT_REASON", "count_if", isin("SCO", "SCOFR")),
    Agg("prev_refused_limit_cnt", "CODE_REJECT_REASON", "count_if", eq("LIMIT")),
    Agg("prev_refused_hc_cnt", "CODE_REJECT_REASON", "count_if", isin("HC", "SYSTEM")),
    Agg("prev_refused_client_cnt", "CODE_REJECT_REASON", "count_if", eq("CLIENT")),
    Agg("prev_last_application", "DAYS_DECISION", "max"),
    Agg("prev_recent_applications_cnt", "DAYS_DECISION", "count_if", ge(-YEAR_DAYS)),
    Agg("prev_recent_approved", "is_approved", "last_sum", int_sum=True),
    Agg("prev_high_yield_cnt", "NAME_YIELD_GROUP", "count_if", eq("high")),
    Agg("prev_middle_yield_cnt", "NAME_YIELD_GROUP", "count_if", eq("middle")),
    Agg("prev_low_yeild_cnt", "NAME_YIELD_GROUP", "count_if", isin("low_normal", "low_action")),
    Agg("prev_was_disbursed", "was_disbursed", "mean"),
    Agg("prev_grace_period_mean", "grace_period", "mean"),
    Agg("prev_delay_mean", "delay", "mean"),
    Agg("prev_delay_max", "delay", "max"),
    Agg("prev_prolong_mean", "prolongation", "mean"),
    Agg("prev_prolong_max", "prolongation", "max"),
    Agg("prev_loan_duration_mean", "loan_duration", "mean"),
    Agg("prev_loan_duration_max", "loan_duration", "max"),
    Agg("prev_insured_mean", "NFLAG_INSURED_ON_APPROVAL", "mean"),
    Agg("prev_type_pos", "NAME_PORTFOLIO", "count_if", eq("POS")),
    Agg("prev_type_cash", "NAME_PORTFOLIO", "count_if", eq("Cash")),
    Agg("prev_cnt_payment_max", "CNT_PAYMENT", "max"),
    Agg("prev_cnt_paymnet_mean", "CNT_PAYMENT", "mean"),
]

# As-written values of the defects that run but mean something else (kept for comparison).
PREVIOUS_AS_WRITTEN_OVERRIDES = {
    "prev_last_application": Agg("prev_last_application_as_written", "DAYS_DECISION", "min"),  # D8
    "prev_recent_applications_cnt": Agg("prev_recent_applications_cnt_as_written", "DAYS_DECISION", "rows"),  # D7
    "prev_prolong_max": Agg("prev_prolong_max_as_written", "prolongation", "mean"),  # D9
}


def previous_as_written() -> list[Agg]:
    return [PREVIOUS_AS_WRITTEN_OVERRIDES.get(a.name, a) for a in PREVIOUS]


# Bureau aggregate columns that a missing bureau history leaves null (P51 fill list).
def bureau_output_columns() -> list[str]:
    return [a.name for a in BUREAU] + ["debt_ratio_mean"]

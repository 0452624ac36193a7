"""Explicit schemas of the seven raw credit files.

The reference infers types from CSV on every read; here every source has a
declared ``StructType`` so a CSV read needs no inference pass and the types
do not depend on the data. Only the columns the workflow uses are declared
as required; other columns of a file are read as they come (strings are
encoded later, numbers kept).
"""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _schema(*cols: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in cols])


L, I, D, S = LongType(), IntegerType(), DoubleType(), StringType()

APPLICATION = _schema(
    ("SK_ID_CURR", L), ("TARGET", I), ("NAME_CONTRACT_TYPE", S), ("CODE_GENDER", S), ("FLAG_OWN_CAR", S),
    ("FLAG_OWN_REALTY", S), ("CNT_CHILDREN", I), ("AMT_INCOME_TOTAL", D), ("AMT_CREDIT", D), ("AMT_ANNUITY", D),
    ("AMT_GOODS_PRICE", D), ("NAME_INCOME_TYPE", S), ("REGION_POPULATION_RELATIVE", D), ("DAYS_BIRTH", I),
    ("DAYS_EMPLOYED", I), ("DAYS_REGISTRATION", D), ("DAYS_ID_PUBLISH", I), ("OWN_CAR_AGE", D),
    ("CNT_FAM_MEMBERS", D), ("REGION_RATING_CLIENT", I), ("REGION_RATING_CLIENT_W_CITY", I),
    ("HOUR_APPR_PROCESS_START", I), ("EXT_SOURCE_1", D), ("EXT_SOURCE_2", D), ("EXT_SOURCE_3", D),
    ("AMT_REQ_CREDIT_BUREAU_HOUR", D), ("AMT_REQ_CREDIT_BUREAU_DAY", D), ("AMT_REQ_CREDIT_BUREAU_WEEK", D),
    ("AMT_REQ_CREDIT_BUREAU_MON", D), ("AMT_REQ_CREDIT_BUREAU_QRT", D), ("AMT_REQ_CREDIT_BUREAU_YEAR", D),
)

BUREAU = _schema(
    ("SK_ID_CURR", L), ("SK_ID_BUREAU", L), ("CREDIT_ACTIVE", S), ("CREDIT_CURRENCY", S), ("DAYS_CREDIT", I),
    ("CREDIT_DAY_OVERDUE", I), ("DAYS_CREDIT_ENDDATE", D), ("DAYS_ENDDATE_FACT", D), ("AMT_CREDIT_MAX_OVERDUE", D),
    ("CNT_CREDIT_PROLONG", I), ("AMT_CREDIT_SUM", D), ("AMT_CREDIT_SUM_DEBT", D), ("AMT_CREDIT_SUM_LIMIT", D),
    ("AMT_CREDIT_SUM_OVERDUE", D), ("CREDIT_TYPE", S), ("DAYS_CREDIT_UPDATE", I), ("AMT_ANNUITY", D),
)

BUREAU_BALANCE = _schema(("SK_ID_BUREAU", L), ("MONTHS_BALANCE", I), ("STATUS", S))

PREVIOUS_APPLICATION = _schema(
    ("SK_ID_PREV", L), ("SK_ID_CURR", L), ("NAME_CONTRACT_TYPE", S), ("AMT_ANNUITY", D), ("AMT_APPLICATION", D),
    ("AMT_CREDIT", D), ("AMT_DOWN_PAYMENT", D), ("AMT_GOODS_PRICE", D), ("RATE_DOWN_PAYMENT", D),
    ("NAME_CONTRACT_STATUS", S), ("DAYS_DECISION", I), ("CODE_REJECT_REASON", S), ("NAME_PORTFOLIO", S),
    ("CNT_PAYMENT", D), ("NAME_YIELD_GROUP", S), ("DAYS_FIRST_DRAWING", D), ("DAYS_FIRST_DUE", D),
    ("DAYS_LAST_DUE_1ST_VERSION", D), ("DAYS_LAST_DUE", D), ("DAYS_TERMINATION", D),
    ("NFLAG_INSURED_ON_APPROVAL", D),
)

POS_CASH_BALANCE = _schema(
    ("SK_ID_PREV", L), ("SK_ID_CURR", L), ("MONTHS_BALANCE", I), ("CNT_INSTALMENT", D),
    ("CNT_INSTALMENT_FUTURE", D), ("NAME_CONTRACT_STATUS", S), ("SK_DPD", I), ("SK_DPD_DEF", I),
)

INSTALLMENTS_PAYMENTS = _schema(
    ("SK_ID_PREV", L), ("SK_ID_CURR", L), ("NUM_INSTALMENT_VERSION", D), ("NUM_INSTALMENT_NUMBER", I),
    ("DAYS_INSTALMENT", D), ("DAYS_ENTRY_PAYMENT", D), ("AMT_INSTALMENT", D), ("AMT_PAYMENT", D),
)

CREDIT_CARD_BALANCE = _schema(
    ("SK_ID_PREV", L), ("SK_ID_CURR", L), ("MONTHS_BALANCE", I), ("AMT_BALANCE", D), ("AMT_CREDIT_LIMIT_ACTUAL", I),
    ("AMT_DRAWINGS_ATM_CURRENT", D), ("AMT_DRAWINGS_CURRENT", D), ("AMT_DRAWINGS_OTHER_CURRENT", D),
    ("AMT_DRAWINGS_POS_CURRENT", D), ("AMT_INST_MIN_REGULARITY", D), ("AMT_PAYMENT_CURRENT", D),
    ("AMT_PAYMENT_TOTAL_CURRENT", D), ("AMT_RECEIVABLE_PRINCIPAL", D), ("AMT_RECIVABLE", D),
    ("AMT_TOTAL_RECEIVABLE", D), ("CNT_DRAWINGS_ATM_CURRENT", D), ("CNT_DRAWINGS_CURRENT", I),
    ("CNT_DRAWINGS_OTHER_CURRENT", D), ("CNT_DRAWINGS_POS_CURRENT", D), ("CNT_INSTALMENT_MATURE_CUM", D),
    ("NAME_CONTRACT_STATUS", S), ("SK_DPD", I), ("SK_DPD_DEF", I),
)

# Source name -> (file name in the raw folder, schema)
SOURCES = {
    "application": ("application_train.csv", APPLICATION),
    "bureau": ("bureau.csv", BUREAU),
    "bureau_balance": ("bureau_balance.csv", BUREAU_BALANCE),
    "previous_application": ("previous_application.csv", PREVIOUS_APPLICATION),
    "pos_cash": ("POS_CASH_balance.csv", POS_CASH_BALANCE),
    "installments": ("installments_payments.csv", INSTALLMENTS_PAYMENTS),
    "credit_card": ("credit_card_balance.csv", CREDIT_CARD_BALANCE),
}

# Join keys that must never be null.
KEYS = {
    "application": ["SK_ID_CURR"],
    "bureau": ["SK_ID_BUREAU", "SK_ID_CURR"],
    "bureau_balance": ["SK_ID_BUREAU"],
    "previous_application": ["SK_ID_PREV", "SK_ID_CURR"],
    "pos_cash": ["SK_ID_PREV"],
    "installments": ["SK_ID_PREV"],
    "credit_card": ["SK_ID_PREV"],
}

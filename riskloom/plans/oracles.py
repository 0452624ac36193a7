"""DuckDB oracle SQL for the registered queries.

Each query is plain ANSI SQL over the pre-registered test tables; the adapter
views are inlined as CTEs. Derived columns are written out by hand here
(independently of the Spark code); the history rollups render the same
feature lists (``plans.specs``) to SQL aggregate expressions.

Doubles are compared after ``floor(x * 2^20 + 0.5) / 2^20`` on both sides. To
know which output columns are doubles, the SQL is bound (not run) once on a
private in-memory DuckDB over the test files.
"""

from __future__ import annotations

import functools

from ..operators.aggspec import select_list_sql
from ..sources.adapters import VIEWS, with_views
from . import specs

TEST_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
DEFAULT_BIND_DIR = "/root/testdata/sf0.01"


@functools.lru_cache(maxsize=1)
def _binder(sf_dir: str = DEFAULT_BIND_DIR):
    import duckdb

    con = duckdb.connect()
    for t in TEST_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def round_doubles(sql: str) -> str:
    """Wrap ``sql`` so every DOUBLE output column goes through the portable rounding."""
    try:
        rel = _binder().sql(sql)
        cols = list(zip(rel.columns, [str(t) for t in rel.types]))
    except Exception:  # no DuckDB or no test files: leave the query unwrapped
        return sql
    exprs = []
    for name, typ in cols:
        q = _quote(name)
        if typ in ("DOUBLE", "FLOAT"):
            exprs.append(f"floor({q} * 1048576e0 + 5e-1) / 1048576e0 AS {q}")
        else:
            exprs.append(q)
    return f"SELECT {', '.join(exprs)}\nFROM (\n{sql}\n) AS oracle_result"


# ------------------------------------------------------------------ building blocks
def _bb_agg_cte() -> str:
    return (
        "bb_agg AS (\nSELECT SK_ID_BUREAU,\n  "
        + select_list_sql(specs.BUREAU_BALANCE)
        + "\nFROM bureau_balance WHERE SK_ID_BUREAU IS NOT NULL GROUP BY SK_ID_BUREAU\n)"
    )


_BUREAU_ENRICHED = """bureau_enriched AS (
SELECT *,
  DAYS_CREDIT_ENDDATE - DAYS_ENDDATE_FACT AS early_closure_days,
  abs(DAYS_CREDIT - DAYS_ENDDATE_FACT) AS credit_duration,
  CASE WHEN CREDIT_ACTIVE = 'Active' AND CREDIT_DAY_OVERDUE > 0 THEN 1 ELSE 0 END AS cnt_curent_overdue,
  CASE WHEN CREDIT_ACTIVE = 'Active' THEN CREDIT_DAY_OVERDUE ELSE 0 END AS overdue_days_active,
  CASE WHEN AMT_CREDIT_MAX_OVERDUE > 0 THEN 1 ELSE 0 END AS ever_overdue_flag,
  CASE WHEN AMT_CREDIT_SUM > 0 THEN AMT_CREDIT_SUM_OVERDUE / AMT_CREDIT_SUM ELSE 0e0 END AS overdue_ratio,
  CASE WHEN CREDIT_ACTIVE = 'Active' THEN AMT_CREDIT_SUM ELSE 0e0 END AS credit_sum_active,
  CASE WHEN CREDIT_ACTIVE = 'Active' THEN AMT_ANNUITY ELSE 0e0 END AS annuity_active
FROM bureau LEFT JOIN bb_agg USING (SK_ID_BUREAU)
)"""


def _bureau_agg_cte() -> str:
    return (
        "bureau_agg0 AS (\nSELECT SK_ID_CURR,\n  "
        + select_list_sql(specs.BUREAU)
        + "\nFROM bureau_enriched WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR\n),\n"
        "bureau_agg AS (\nSELECT *, CASE WHEN credit_sum_mean > 0 THEN debt_mean / credit_sum_mean ELSE 0e0 END"
        " AS debt_ratio_mean FROM bureau_agg0\n)"
    )


def _bureau_ctes() -> str:
    return ",\n".join([_bb_agg_cte(), _BUREAU_ENRICHED, _bureau_agg_cte()])


def _ctes(views: list[str], extra: list[str], final: str) -> str:
    body = ",\n".join(extra)
    sql = with_views("SELECT 1", views)[: -len("SELECT 1")].rstrip()
    return f"{sql},\n{body}\n{final}" if extra else f"{sql}\n{final}"


def bureau_balance_agg_sql() -> str:
    return _ctes(["bureau_balance"], [_bb_agg_cte()], "SELECT * FROM bb_agg")


def bureau_agg_sql() -> str:
    return _ctes(["bureau", "bureau_balance"], [_bureau_ctes()], "SELECT * FROM bureau_agg")


def application_bureau_join_sql() -> str:
    return _ctes(
        ["application", "bureau", "bureau_balance"],
        [_bureau_ctes()],
        "SELECT * FROM application LEFT JOIN bureau_agg USING (SK_ID_CURR)",
    )


# ------------------------------------------------------------------ previous chain
def _pos_agg_cte() -> str:
    return (
        "pos_agg AS (\nSELECT SK_ID_PREV,\n  "
        + select_list_sql(specs.POS_CASH)
        + "\nFROM pos_cash WHERE SK_ID_PREV IS NOT NULL GROUP BY SK_ID_PREV\n)"
    )


def _inst_ctes(as_written: bool = False) -> str:
    d = "ASC NULLS FIRST" if as_written else "DESC NULLS LAST"
    return f"""inst_enriched AS (
SELECT *,
  DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT AS delay_days,
  AMT_INSTALMENT - AMT_PAYMENT AS underpay_amt,
  AMT_PAYMENT / nullif(AMT_INSTALMENT, 0) AS payment_ratio,
  row_number() OVER (PARTITION BY SK_ID_PREV ORDER BY DAYS_INSTALMENT {d}, NUM_INSTALMENT_NUMBER {d}, NUM_INSTALMENT_VERSION {d}, SK_ID_CURR {d}) AS rk
FROM installments
),
inst_agg AS (
SELECT SK_ID_PREV,
  {select_list_sql(specs.INSTALLMENTS, "rk", specs.LAST_K)}
FROM inst_enriched WHERE SK_ID_PREV IS NOT NULL GROUP BY SK_ID_PREV
)"""


def _cc_ctes() -> str:
    d = "DESC NULLS LAST"
    return f"""cc_enriched AS (
SELECT *,
  AMT_BALANCE / nullif(CAST(AMT_CREDIT_LIMIT_ACTUAL AS DOUBLE), 0) AS balance_rate,
  AMT_DRAWINGS_CURRENT / nullif(AMT_BALANCE, 0) AS spend_rate,
  (AMT_RECIVABLE - AMT_RECEIVABLE_PRINCIPAL) / nullif(AMT_RECEIVABLE_PRINCIPAL, 0) AS interest_rate,
  AMT_TOTAL_RECEIVABLE / nullif(AMT_RECEIVABLE_PRINCIPAL, 0) AS cost_ratio,
  AMT_BALANCE / nullif(AMT_RECEIVABLE_PRINCIPAL, 0) AS loan_rate,
  CASE WHEN NAME_CONTRACT_STATUS = 'Active' AND MONTHS_BALANCE = -1 THEN AMT_TOTAL_RECEIVABLE ELSE 0e0 END AS current_debt,
  CASE WHEN AMT_CREDIT_LIMIT_ACTUAL > 0 THEN 1 ELSE 0 END AS has_credit_limit,
  CASE WHEN AMT_BALANCE = 0 THEN 1 ELSE 0 END AS zero_balance,
  CASE WHEN AMT_RECEIVABLE_PRINCIPAL = 0 THEN 1 ELSE 0 END AS zero_principal,
  row_number() OVER (PARTITION BY SK_ID_PREV ORDER BY MONTHS_BALANCE {d}, SK_ID_CURR {d}, AMT_DRAWINGS_ATM_CURRENT {d}, CNT_DRAWINGS_ATM_CURRENT {d}) AS rk
FROM credit_card
),
cc_agg AS (
SELECT SK_ID_PREV,
  {select_list_sql(specs.CREDIT_CARD, "rk", specs.LAST_K)}
FROM cc_enriched WHERE SK_ID_PREV IS NOT NULL GROUP BY SK_ID_PREV
)"""


_PREV_ENRICHED = """prev_joined AS (
SELECT * FROM previous_application
  LEFT JOIN pos_agg USING (SK_ID_PREV)
  LEFT JOIN inst_agg USING (SK_ID_PREV)
  LEFT JOIN cc_agg USING (SK_ID_PREV)
),
prev_clean AS (
SELECT * REPLACE (
  nullif(DAYS_FIRST_DRAWING, 365243) AS DAYS_FIRST_DRAWING,
  nullif(DAYS_FIRST_DUE, 365243) AS DAYS_FIRST_DUE,
  nullif(DAYS_LAST_DUE_1ST_VERSION, 365243) AS DAYS_LAST_DUE_1ST_VERSION,
  nullif(DAYS_LAST_DUE, 365243) AS DAYS_LAST_DUE,
  nullif(DAYS_TERMINATION, 365243) AS DAYS_TERMINATION),
  CASE WHEN NAME_CONTRACT_STATUS IN ('Approved', 'Unused offer') THEN 1 ELSE 0 END AS is_approved,
  CASE WHEN NAME_CONTRACT_STATUS = 'Refused' THEN 1 ELSE 0 END AS is_refused
FROM prev_joined
),
prev_enriched AS (
SELECT *,
  AMT_ANNUITY * is_approved AS approved_annuity,
  CASE WHEN is_approved = 1 THEN AMT_CREDIT END AS approved_credit,
  CASE WHEN is_refused = 1 THEN AMT_CREDIT END AS refused_credit,
  AMT_APPLICATION - AMT_CREDIT AS request_diff,
  CASE WHEN is_refused = 0 AND DAYS_FIRST_DRAWING IS NOT NULL THEN 1 ELSE 0 END AS was_disbursed,
  DAYS_FIRST_DUE - DAYS_FIRST_DRAWING AS grace_period,
  DAYS_TERMINATION - DAYS_LAST_DUE_1ST_VERSION AS delay,
  DAYS_LAST_DUE - DAYS_LAST_DUE_1ST_VERSION AS prolongation,
  DAYS_LAST_DUE_1ST_VERSION - DAYS_FIRST_DUE AS loan_duration,
  CAST(unpaid_inst_cnt AS DOUBLE) / nullif(CAST(inst_cnt AS DOUBLE), 0) AS unpaid_ratio,
  row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY DAYS_DECISION DESC NULLS LAST, SK_ID_PREV DESC NULLS LAST) AS rk
FROM prev_clean
)"""


def _prev_agg_cte(as_written: bool = False) -> str:
    feature_list = specs.previous_as_written() if as_written else specs.PREVIOUS
    return (
        "prev_agg AS (\nSELECT SK_ID_CURR,\n  "
        + select_list_sql(feature_list, "rk", specs.LAST_K)
        + "\nFROM prev_enriched WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR\n)"
    )


_PREV_VIEWS = ["previous_application", "pos_cash", "installments", "credit_card"]


def _prev_ctes(as_written: bool = False) -> list[str]:
    return [_pos_agg_cte(), _inst_ctes(), _cc_ctes(), _PREV_ENRICHED, _prev_agg_cte(as_written)]


def pos_cash_agg_sql() -> str:
    return _ctes(["pos_cash"], [_pos_agg_cte()], "SELECT * FROM pos_agg")


def installments_agg_sql(as_written: bool = False) -> str:
    return _ctes(["installments"], [_inst_ctes(as_written)], "SELECT * FROM inst_agg")


def installments_recency_sql() -> str:
    d = "DESC NULLS LAST"
    final = f"""SELECT SK_ID_PREV, DAYS_INSTALMENT, NUM_INSTALMENT_NUMBER, NUM_INSTALMENT_VERSION, SK_ID_CURR, rank_recency,
  CASE WHEN rank_recency < 3 THEN true ELSE false END AS is_recent
FROM (
  SELECT *, row_number() OVER (PARTITION BY SK_ID_PREV ORDER BY DAYS_INSTALMENT {d}, NUM_INSTALMENT_NUMBER {d}, NUM_INSTALMENT_VERSION {d}, SK_ID_CURR {d}) - 1
    AS rank_recency
  FROM installments WHERE SK_ID_PREV IS NOT NULL
)"""
    return _ctes(["installments"], [], final)


def credit_card_agg_sql() -> str:
    return _ctes(["credit_card"], [_cc_ctes()], "SELECT * FROM cc_agg")


def previous_enriched_sql() -> str:
    return _ctes(_PREV_VIEWS, [_pos_agg_cte(), _inst_ctes(), _cc_ctes(), _PREV_ENRICHED],
                 "SELECT * EXCLUDE (rk) FROM prev_enriched")


def previous_agg_sql(as_written: bool = False) -> str:
    return _ctes(_PREV_VIEWS, _prev_ctes(as_written), "SELECT * FROM prev_agg")


def application_previous_join_sql() -> str:
    return _ctes(["application"] + _PREV_VIEWS, _prev_ctes(),
                 "SELECT * FROM application LEFT JOIN prev_agg USING (SK_ID_CURR)")


# ------------------------------------------------------------------ EDA
QUANTILE_FEATURES_SQL = [
    ("age_years", "-CAST(DAYS_BIRTH AS DOUBLE) / 365.25e0", 10),
    ("income_thousands", "floor(AMT_INCOME_TOTAL / 1000e0)", 9),
    ("credit_thousands", "floor(AMT_CREDIT / 1000e0)", 10),
    ("AMT_ANNUITY", "AMT_ANNUITY", 10),
    ("REGION_POPULATION_RELATIVE", "REGION_POPULATION_RELATIVE", 10),
    ("employed_years", "-CAST(nullif(DAYS_EMPLOYED, 365243) AS DOUBLE) / 365.25e0", 10),
    ("year_reg_duration", "-DAYS_REGISTRATION / 365.25e0", 10),
    ("id_reg_duration", "-CAST(DAYS_ID_PUBLISH AS DOUBLE) / 365.25e0", 10),
    ("OWN_CAR_AGE", "OWN_CAR_AGE", 10),
    ("EXT_SOURCE_1", "EXT_SOURCE_1", 10),
    ("EXT_SOURCE_2", "EXT_SOURCE_2", 10),
    ("EXT_SOURCE_3", "EXT_SOURCE_3", 10),
]


def _probs_sql(q: int) -> str:
    return "[" + ", ".join(f"{i / q!r}e0" if "e" not in repr(i / q) else repr(i / q) for i in range(q + 1)) + "]"


def quantile_bins_sql(names: list[str] | None = None) -> str:
    feats = [f for f in QUANTILE_FEATURES_SQL if names is None or f[0] in names]
    long = "\n  UNION ALL\n  ".join(
        f"SELECT '{n}' AS feature, CAST({e} AS DOUBLE) AS value, TARGET FROM application WHERE TARGET IS NOT NULL"
        for n, e, _ in feats
    )
    edges = "\n  UNION ALL\n  ".join(
        f"SELECT '{n}' AS feature, list_sort(list_distinct(quantile_cont(value, {_probs_sql(q)}))) AS edges "
        f"FROM long_values WHERE feature = '{n}'"
        for n, _, q in feats
    )
    extra = [
        f"long_all AS (\n  {long}\n)",
        "long_values AS (SELECT * FROM long_all WHERE value IS NOT NULL)",
        f"edges AS (\n  {edges}\n)",
        "binned AS (\nSELECT l.feature, l.TARGET, e.edges,\n"
        "  CAST(greatest(1, len(list_filter(e.edges, lambda x: x < l.value))) AS INTEGER) AS bin\n"
        "FROM long_values l JOIN edges e ON l.feature = e.feature\n)",
    ]
    final = (
        "SELECT feature, bin, any_value(edges[bin]) AS lo,\n"
        "  any_value(edges[bin + 1]) AS hi,\n"
        "  count(TARGET) AS count, avg(TARGET) AS default_rate\n"
        "FROM binned WHERE len(edges) > 1 GROUP BY feature, bin"
    )
    return _ctes(["application"], extra, final)


def fixed_bins_sql(column: str, edges=(0, 1, 2, 3, 5, 10, 100)) -> str:
    cases = " ".join(f"WHEN {column} > {edges[i - 1]} AND {column} <= {edges[i]} THEN {i}" for i in range(1, len(edges)))
    los = " ".join(f"WHEN {i} THEN CAST({edges[i - 1]} AS DOUBLE)" for i in range(1, len(edges)))
    his = " ".join(f"WHEN {i} THEN CAST({edges[i]} AS DOUBLE)" for i in range(1, len(edges)))
    final = (
        f"SELECT bin, CASE bin {los} END AS lo, CASE bin {his} END AS hi, count, default_rate FROM (\n"
        f"  SELECT CASE {cases} END AS bin, count(TARGET) AS count, avg(TARGET) AS default_rate\n"
        f"  FROM application GROUP BY 1\n) WHERE bin IS NOT NULL"
    )
    return _ctes(["application"], [], final)


def hour_band_sql() -> str:
    final = (
        "SELECT process_start_group, count(TARGET) AS count, avg(TARGET) AS default_rate FROM (\n"
        "  SELECT CASE WHEN HOUR_APPR_PROCESS_START BETWEEN 6 AND 11 THEN 'morning'\n"
        "    WHEN HOUR_APPR_PROCESS_START BETWEEN 12 AND 17 THEN 'afternoon'\n"
        "    WHEN HOUR_APPR_PROCESS_START BETWEEN 18 AND 23 THEN 'evening' ELSE 'night' END AS process_start_group,\n"
        "    TARGET FROM application\n) GROUP BY process_start_group"
    )
    return _ctes(["application"], [], final)


def category_rates_sql() -> str:
    cols = ["CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "REGION_RATING_CLIENT_W_CITY"]
    parts = "\n  UNION ALL\n  ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS category, TARGET FROM application" for c in cols
    )
    final = (
        f"SELECT feature, category, count(TARGET) AS count, avg(TARGET) AS default_rate FROM (\n  {parts}\n)\n"
        "WHERE category IS NOT NULL GROUP BY feature, category"
    )
    return _ctes(["application"], [], final)


def missing_rates_sql() -> str:
    feats = {"DAYS_EMPLOYED": "nullif(DAYS_EMPLOYED, 365243)", "EXT_SOURCE_1": "EXT_SOURCE_1",
             "EXT_SOURCE_2": "EXT_SOURCE_2", "EXT_SOURCE_3": "EXT_SOURCE_3"}
    parts = "\n  UNION ALL\n  ".join(
        f"SELECT '{n}' AS feature, CASE WHEN {e} IS NULL THEN 1 ELSE 0 END AS is_missing, TARGET FROM application"
        for n, e in feats.items()
    )
    final = (
        "SELECT feature, is_missing, count(TARGET) AS count, avg(TARGET) AS default_rate,\n"
        "  count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM application) AS share\n"
        f"FROM (\n  {parts}\n) GROUP BY feature, is_missing"
    )
    return _ctes(["application"], [], final)


def target_distribution_sql() -> str:
    final = ("SELECT TARGET, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM application WHERE TARGET IS NOT NULL)"
             " AS proportion FROM application WHERE TARGET IS NOT NULL GROUP BY TARGET")
    return _ctes(["application"], [], final)


def value_counts_sql(view: str, column: str) -> str:
    return _ctes([view], [], f"SELECT {column}, count(*) AS count FROM {view} WHERE {column} IS NOT NULL GROUP BY {column}")


def shape_sql() -> str:
    n_cols = len(VIEWS["application"][2])
    return _ctes(["application"], [], f"SELECT count(*) AS n_rows, {n_cols} AS n_cols FROM application")


def head_sql(n: int = 5) -> str:
    return _ctes(["application"], [], f"SELECT * FROM application ORDER BY SK_ID_CURR LIMIT {n}")


def distinct_counts_sql(columns: list[str]) -> str:
    parts = "\n  UNION ALL\n  ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS nunique FROM application" for c in columns
    )
    return _ctes(["application"], [], parts)


# ------------------------------------------------------------------ encoding and processed table
# Fixture vocabulary (the values the adapter views produce at every scale factor).
GENDER_VALUES = ["F", "M", "XNA"]
INCOME_TYPE_VALUES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _label_codes_sql() -> str:
    return ("CASE FLAG_OWN_CAR WHEN 'N' THEN 0 WHEN 'Y' THEN 1 END AS FLAG_OWN_CAR, "
            "CASE FLAG_OWN_REALTY WHEN 'N' THEN 0 WHEN 'Y' THEN 1 END AS FLAG_OWN_REALTY")


def _dummies_sql() -> str:
    parts = [f"CASE WHEN CODE_GENDER = '{v}' THEN 1 ELSE 0 END AS CODE_GENDER_{v}" for v in GENDER_VALUES]
    parts += [f"CASE WHEN NAME_INCOME_TYPE = '{v}' THEN 1 ELSE 0 END AS NAME_INCOME_TYPE_{v}" for v in INCOME_TYPE_VALUES]
    return ",\n  ".join(parts)


def label_encode_sql() -> str:
    return _ctes(["application"], [], f"SELECT SK_ID_CURR, {_label_codes_sql()} FROM application")


def one_hot_sql() -> str:
    return _ctes(["application"], [], f"SELECT SK_ID_CURR,\n  {_dummies_sql()}\nFROM application")


# string columns of the application view, in name order
SPARSE_COLUMNS = ["CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "NAME_INCOME_TYPE"]


def _dictionary_cte() -> str:
    cells = " UNION ALL ".join(f"SELECT '{c}' AS c, {c} AS v FROM application" for c in SPARSE_COLUMNS)
    return ("dictionary AS (SELECT c, v, count(*) AS n, row_number() OVER (ORDER BY c, v) - 1 AS id "
            f"FROM ({cells}) WHERE v IS NOT NULL GROUP BY c, v)")


def one_hot_dictionary_sql() -> str:
    return _ctes(["application"], [_dictionary_cte()], 'SELECT c AS "column", v AS "value", id, n FROM dictionary')


def one_hot_sparse_sql() -> str:
    joins = "\n".join(f"LEFT JOIN dictionary d{i} ON d{i}.c = '{c}' AND d{i}.v = a.{c}" for i, c in enumerate(SPARSE_COLUMNS))
    ids = ", ".join(f"d{i}.id" for i in range(len(SPARSE_COLUMNS)))
    return _ctes(["application"], [_dictionary_cte()], f"SELECT a.SK_ID_CURR, concat_ws(',', {ids}) AS one_hot FROM application a\n{joins}")


_RECODE = """recoded AS (
SELECT * REPLACE (
    coalesce(nullif(DAYS_EMPLOYED, 365243), -1) AS DAYS_EMPLOYED,
    coalesce(EXT_SOURCE_1, -1e0) AS EXT_SOURCE_1,
    coalesce(EXT_SOURCE_2, -1e0) AS EXT_SOURCE_2,
    coalesce(EXT_SOURCE_3, -1e0) AS EXT_SOURCE_3),
  CASE WHEN nullif(DAYS_EMPLOYED, 365243) IS NULL THEN 1 ELSE 0 END AS days_employed_missing,
  AMT_CREDIT / nullif(AMT_INCOME_TOTAL, 0) AS credit_income_ratio,
  AMT_ANNUITY / nullif(AMT_INCOME_TOTAL, 0) AS annuity_income_ratio,
  ln(1 + AMT_INCOME_TOTAL) AS log_income,
  ln(1 + AMT_CREDIT) AS log_credit,
  CASE WHEN CNT_CHILDREN >= 3 THEN 1 ELSE 0 END AS has_many_children,
  CASE WHEN EXT_SOURCE_1 IS NULL THEN 1 ELSE 0 END AS ext_source_1_missing,
  CASE WHEN EXT_SOURCE_3 IS NULL THEN 1 ELSE 0 END AS ext_source_3_missing
FROM application LEFT JOIN bureau_agg USING (SK_ID_CURR)
)"""


def _encoded_cte() -> str:
    return (
        "processed AS (\nSELECT * EXCLUDE (CODE_GENDER, NAME_INCOME_TYPE) REPLACE ("
        + _label_codes_sql()
        + "),\n  "
        + _dummies_sql()
        + "\nFROM recoded\n)"
    )


def _flags_cte() -> str:
    fills = ",\n    ".join(f"coalesce({c}, -1) AS {c}" for c in specs.bureau_output_columns())
    enq = ",\n    ".join(
        f"coalesce({c}, -1e0) AS {c}"
        for c in ["AMT_REQ_CREDIT_BUREAU_HOUR", "AMT_REQ_CREDIT_BUREAU_DAY", "AMT_REQ_CREDIT_BUREAU_WEEK",
                  "AMT_REQ_CREDIT_BUREAU_MON", "AMT_REQ_CREDIT_BUREAU_QRT", "AMT_REQ_CREDIT_BUREAU_YEAR"]
    )
    return (
        "flagged AS (\nSELECT * REPLACE (\n    " + fills + ",\n    " + enq + "),\n"
        "  CASE WHEN first_credit_time IS NOT NULL THEN 1 ELSE 0 END AS has_credit_history,\n"
        "  CASE WHEN AMT_REQ_CREDIT_BUREAU_YEAR IS NOT NULL THEN 1 ELSE 0 END AS has_credit_enquiries\n"
        "FROM processed\n)"
    )


_RATIOS = """model_ready AS (
SELECT *,
  AMT_ANNUITY / nullif(AMT_CREDIT, 0) AS credit_annuity_ratio,
  AMT_CREDIT - AMT_GOODS_PRICE AS credit_over_goods_price,
  DAYS_BIRTH - DAYS_EMPLOYED AS days_without_work,
  AMT_CREDIT / nullif(CNT_FAM_MEMBERS, 0) AS credit_per_family_member,
  AMT_ANNUITY / nullif(CNT_FAM_MEMBERS, 0) AS annuity_per_family_member,
  AMT_INCOME_TOTAL / nullif(CNT_FAM_MEMBERS, 0) AS income_per_family_member
FROM flagged
)"""

_BUREAU_VIEWS = ["application", "bureau", "bureau_balance"]


def application_recode_sql() -> str:
    return _ctes(_BUREAU_VIEWS, [_bureau_ctes(), _RECODE, _encoded_cte()], "SELECT * FROM processed")


def credit_history_flags_sql() -> str:
    return _ctes(_BUREAU_VIEWS, [_bureau_ctes(), _RECODE, _encoded_cte(), _flags_cte()], "SELECT * FROM flagged")


def model_ratios_sql() -> str:
    return _ctes(_BUREAU_VIEWS, [_bureau_ctes(), _RECODE, _encoded_cte(), _flags_cte(), _RATIOS],
                 "SELECT * FROM model_ready")


def model_table_full_sql() -> str:
    """Model-ready table with the previous-application aggregate joined."""
    return _ctes(_BUREAU_VIEWS + _PREV_VIEWS,
                 [_bureau_ctes(), _RECODE, _encoded_cte(), _flags_cte(), _RATIOS] + _prev_ctes(),
                 "SELECT * FROM model_ready LEFT JOIN prev_agg USING (SK_ID_CURR)")


def null_report_sql() -> str:
    """A6 over the processed table: one UNION ALL branch per column (columns read from the bound query)."""
    base = application_recode_sql()
    cols = _binder().sql(base).columns
    ctes = [_bureau_ctes(), _RECODE, _encoded_cte()]
    parts = "\n  UNION ALL\n  ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({_quote(c)}) AS Count, "
        f"(count(*) - count({_quote(c)})) * 100e0 / count(*) AS pct FROM processed"
        for c in cols
    )
    return _ctes(_BUREAU_VIEWS, ctes, f"SELECT * FROM (\n  {parts}\n) WHERE Count > 0")


# ------------------------------------------------------------------ split, medians, metrics
def _hash_unit_sql(id_col: str, seed: int = 42) -> str:
    return f"CAST(('0x' || substr(md5('{seed}:' || CAST({id_col} AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296e0"


def hash_split_sql() -> str:
    u = _hash_unit_sql("SK_ID_CURR")
    final = (f"SELECT SK_ID_CURR, TARGET, CASE WHEN {u} < 0.7e0 THEN 'train' WHEN {u} < 0.91e0 THEN 'validation' "
             "ELSE 'test' END AS split FROM application")
    return _ctes(["application"], [], final)


def csv_quoted_cells_sql() -> str:
    return "SELECT doc_id, lang, md5(coalesce(text, '')) AS text_md5 FROM documents"


def hash_split_exact_sql(parts=(("train", "0.7e0"), ("validation", "0.91e0")), rest="test") -> str:
    u = _hash_unit_sql("SK_ID_CURR")
    cases = " ".join(f"WHEN share < {upper} THEN '{name}'" for name, upper in parts)
    final = f"""SELECT SK_ID_CURR, TARGET,
  CASE {cases} ELSE '{rest}' END AS split
FROM (
  SELECT SK_ID_CURR, TARGET,
    (row_number() OVER (PARTITION BY TARGET ORDER BY {u}, SK_ID_CURR) - 1)
      / CAST(count(*) OVER (PARTITION BY TARGET) AS DOUBLE) AS share
  FROM application
)"""
    return _ctes(["application"], [], final)


MEDIAN_COLUMNS = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "OWN_CAR_AGE", "CNT_FAM_MEMBERS",
                  "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "DAYS_BIRTH", "CNT_CHILDREN"]


def median_impute_sql() -> str:
    u = _hash_unit_sql("SK_ID_CURR")
    parts = "\n  UNION ALL\n  ".join(
        f"SELECT '{c}' AS feature, quantile_cont(CAST({c} AS DOUBLE), 0.5e0) AS median FROM train WHERE {c} IS NOT NULL"
        for c in MEDIAN_COLUMNS
    )
    return _ctes(["application"], [f"train AS (SELECT * FROM application WHERE {u} < 0.7e0)"], parts)


def _imputed_train_ctes() -> list[str]:
    u = _hash_unit_sql("SK_ID_CURR")
    filled = "\n  UNION ALL\n  ".join(
        f"SELECT '{c}' AS feature, TARGET, coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5e0) FROM train)) AS value FROM train"
        for c in MEDIAN_COLUMNS
    )
    return [f"train AS (SELECT * FROM application WHERE {u} < 0.7e0)", f"filled AS (\n  {filled}\n)"]


def class_weights_sql() -> str:
    u = _hash_unit_sql("SK_ID_CURR")
    return _ctes(["application"], [f"c AS (SELECT TARGET, count(*) AS n FROM application WHERE {u} < 0.7e0 GROUP BY TARGET)"],
                 "SELECT TARGET, n, (SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * CAST(n AS DOUBLE)) AS class_weight FROM c")


def scaler_stats_sql() -> str:
    return _ctes(["application"], _imputed_train_ctes(),
                 "SELECT feature, avg(value) AS mean, stddev_pop(value) AS std FROM filled GROUP BY feature")


def f_statistics_sql() -> str:
    """F = variance of the class means (by class size) over the variance within classes."""
    extra = _imputed_train_ctes() + [
        "means AS (SELECT feature, TARGET, count(*) AS n, avg(value) AS m FROM filled GROUP BY feature, TARGET)",
        "overall AS (SELECT feature, count(*) AS n, avg(value) AS m FROM filled GROUP BY feature)",
        "inside AS (SELECT f.feature, sum((f.value - c.m) * (f.value - c.m)) AS ss FROM filled f "
        "JOIN means c ON f.feature = c.feature AND f.TARGET = c.TARGET GROUP BY f.feature)",
        "across AS (SELECT c.feature, sum(c.n * (c.m - o.m) * (c.m - o.m)) AS ss, count(*) AS k, any_value(o.n) AS n "
        "FROM means c JOIN overall o ON c.feature = o.feature GROUP BY c.feature)",
    ]
    return _ctes(["application"], extra,
                 "SELECT a.feature, (a.ss / (a.k - 1)) / (i.ss / (a.n - a.k)) AS f_score FROM across a JOIN inside i ON a.feature = i.feature")


def tree_split_sql() -> str:
    u = _hash_unit_sql("SK_ID_CURR")
    return _ctes(["application"], [], f"SELECT SK_ID_CURR, TARGET, CASE WHEN {u} < 0.75e0 THEN 'train' ELSE 'validation' END AS split FROM application")


def auc_exact_sql() -> str:
    return """WITH scored AS (
  SELECT CAST(d.n_chars AS DOUBLE) AS score, l.quality AS label FROM labels l JOIN documents d ON l.doc_id = d.doc_id
),
by_score AS (
  SELECT score, count(CASE WHEN label = 1 THEN 1 END) AS pos, count(CASE WHEN label = 0 THEN 1 END) AS neg
  FROM scored WHERE score IS NOT NULL AND label IS NOT NULL GROUP BY score
),
cum AS (
  SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before
  FROM by_score
)
SELECT sum(pos * (neg_before + neg * 0.5e0)) / (sum(pos) * sum(neg)) AS auc,
  CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
FROM cum"""


def threshold_sweep_sql() -> str:
    thresholds = ", ".join(f"({i / 10!r}e0)" for i in range(1, 10))
    final = f"""SELECT t.threshold,
  coalesce(count(CASE WHEN s.score >= t.threshold AND s.label = 1 THEN 1 END) / nullif(CAST(count(CASE WHEN s.label = 1 THEN 1 END) AS DOUBLE), 0), 0e0) AS recall,
  coalesce(count(CASE WHEN s.score >= t.threshold AND s.label = 1 THEN 1 END) / nullif(CAST(count(CASE WHEN s.score >= t.threshold THEN 1 END) AS DOUBLE), 0), 0e0) AS precision,
  count(CASE WHEN s.score >= t.threshold THEN 1 END) AS predicted_positive
FROM (SELECT 1e0 - EXT_SOURCE_2 AS score, TARGET AS label FROM application WHERE EXT_SOURCE_2 IS NOT NULL) s
CROSS JOIN (VALUES {thresholds}) AS t(threshold)
GROUP BY t.threshold"""
    return _ctes(["application"], [], final)


def pick_threshold_sql(min_recall: float = 0.5) -> str:
    inner = threshold_sweep_sql()
    return (f"SELECT * FROM (\n{inner}\n) AS sweep WHERE recall >= {min_recall!r}e0 "
            "ORDER BY precision DESC, threshold DESC LIMIT 1")


# ------------------------------------------------------------------ small profiles
def bureau_column_minimums_sql(non_negative_only: bool = False) -> str:
    cols = specs.bureau_output_columns()
    parts = "\n  UNION ALL\n  ".join(
        f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min_value FROM bureau_agg" for c in cols
    )
    final = f"SELECT * FROM (\n  {parts}\n)"
    if non_negative_only:
        final += " WHERE min_value >= 0"
    return _ctes(["bureau", "bureau_balance"], [_bureau_ctes()], final)


def null_count_sql() -> str:
    return _ctes(["application"], [], "SELECT count(*) - count(nullif(DAYS_EMPLOYED, 365243)) AS null_count FROM application")


def capped_children_sql() -> str:
    return _ctes(["application"], [],
                 "SELECT SK_ID_CURR, CNT_CHILDREN, CASE WHEN CNT_CHILDREN IS NULL THEN NULL "
                 "ELSE least(CNT_CHILDREN, 3) END AS cnt_children_capped FROM application")


__all__ = ["round_doubles", "VIEWS"]

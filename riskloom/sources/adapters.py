"""Credit-shaped views over the TPC-H-like test tables.

The test data holds no credit tables, so each source of the workflow
(application, bureau, bureau_balance, previous_application, POS_CASH_balance,
installments_payments, credit_card_balance) is *derived* from a given table
with integer arithmetic only. The same expression text is rendered for Spark
(``selectExpr``) and for DuckDB (the oracle), so both engines see identical
rows. Every view reads its whole source table: no row is filtered away.
Parent-key misses (applicants without history, histories without applicant)
are produced by re-keying some child rows to a negative applicant id, which
no application has, instead of by dropping rows.

``{DD:col}`` is the signed day count from 2001-12-31 to ``col``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_DD = re.compile(r"\{DD:(\w+)\}")


def _render(expr: str, dialect: str) -> str:
    if dialect == "spark":
        return _DD.sub(r"datediff(CAST(\1 AS DATE), DATE'2001-12-31')", expr)
    return _DD.sub(r"CAST(date_diff('day', DATE '2001-12-31', CAST(\1 AS DATE)) AS INT)", expr)


# (source table, optional row predicate that splits a table between two views, [expr AS name, ...])
VIEWS: dict[str, tuple[str, str | None, list[str]]] = {
    "application": (
        "customer",
        None,
        [
            "c_custkey AS SK_ID_CURR",
            "CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS TARGET",
            "CAST(25000 + (c_custkey * 7919) % 200000 AS DOUBLE) AS AMT_INCOME_TOTAL",
            "CAST(45000 + (c_custkey * 104729) % 900000 AS DOUBLE) AS AMT_CREDIT",
            "CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE CAST(2500 + (c_custkey * 611) % 50000 AS DOUBLE) END AS AMT_ANNUITY",
            "CASE WHEN c_custkey % 89 = 0 THEN NULL ELSE CAST(40000 + (c_custkey * 104729) % 850000 AS DOUBLE) END AS AMT_GOODS_PRICE",
            "CAST(-(7500 + (c_custkey * 37) % 17500) AS INT) AS DAYS_BIRTH",
            "CAST(CASE WHEN c_custkey % 6 = 0 THEN 365243 ELSE -((c_custkey * 53) % 7000) END AS INT) AS DAYS_EMPLOYED",
            "CAST(-((c_custkey * 71) % 9000) AS DOUBLE) AS DAYS_REGISTRATION",
            "CAST(-((c_custkey * 67) % 6000) AS INT) AS DAYS_ID_PUBLISH",
            "CASE WHEN c_custkey % 3 <> 0 THEN NULL ELSE CAST((c_custkey * 13) % 40 AS DOUBLE) END AS OWN_CAR_AGE",
            "CAST(c_custkey % 8 AS INT) AS CNT_CHILDREN",
            "CASE WHEN c_custkey % 701 = 0 THEN NULL ELSE CAST(c_custkey % 8 + 1 + c_custkey % 2 AS DOUBLE) END AS CNT_FAM_MEMBERS",
            "CAST(c_custkey % 24 AS INT) AS HOUR_APPR_PROCESS_START",
            "CAST(1 + c_nationkey % 3 AS INT) AS REGION_RATING_CLIENT_W_CITY",
            "CAST(1 + c_nationkey % 17 AS DOUBLE) / 1000 AS REGION_POPULATION_RELATIVE",
            "CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE CAST((c_custkey * 389) % 1000 AS DOUBLE) / 1000 END AS EXT_SOURCE_1",
            "CASE WHEN c_custkey % 499 = 0 THEN NULL ELSE CAST((c_custkey * 733) % 1000 AS DOUBLE) / 1000 END AS EXT_SOURCE_2",
            "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST((c_custkey * 557) % 1000 AS DOUBLE) / 1000 END AS EXT_SOURCE_3",
            "CASE WHEN c_custkey % 1000 = 7 THEN 'XNA' WHEN c_custkey % 3 = 0 THEN 'M' ELSE 'F' END AS CODE_GENDER",
            "CASE WHEN c_custkey % 37 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'Y' ELSE 'N' END AS FLAG_OWN_CAR",
            "CASE WHEN c_custkey % 10 < 7 THEN 'Y' ELSE 'N' END AS FLAG_OWN_REALTY",
            "CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE c_mktsegment END AS NAME_INCOME_TYPE",
            "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 2 AS DOUBLE) END AS AMT_REQ_CREDIT_BUREAU_HOUR",
            "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 3 AS DOUBLE) END AS AMT_REQ_CREDIT_BUREAU_DAY",
            "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 2 AS DOUBLE) END AS AMT_REQ_CREDIT_BUREAU_WEEK",
            "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 5 AS DOUBLE) END AS AMT_REQ_CREDIT_BUREAU_MON",
            "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 3 AS DOUBLE) END AS AMT_REQ_CREDIT_BUREAU_QRT",
            "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 4 AS DOUBLE) END AS AMT_REQ_CREDIT_BUREAU_YEAR",
        ],
    ),
    "bureau": (
        "orders",
        None,
        [
            # every 11th customer's loans point to no applicant (history without application)
            "CASE WHEN o_custkey % 11 = 0 THEN -o_custkey ELSE o_custkey END AS SK_ID_CURR",
            "o_orderkey AS SK_ID_BUREAU",
            "CASE WHEN o_orderstatus = 'O' THEN 'Active' WHEN o_orderkey % 50 = 0 THEN 'Bad debt' "
            "WHEN o_orderkey % 50 = 1 THEN 'Sold' ELSE 'Closed' END AS CREDIT_ACTIVE",
            "{DD:o_orderdate} AS DAYS_CREDIT",
            "CAST(CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey % 120 ELSE 0 END AS INT) AS CREDIT_DAY_OVERDUE",
            "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST({DD:o_orderdate} + o_orderkey % 2000 AS DOUBLE) END AS DAYS_CREDIT_ENDDATE",
            "CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST({DD:o_orderdate} + o_orderkey % 1500 AS DOUBLE) END AS DAYS_ENDDATE_FACT",
            "CASE WHEN o_orderkey % 2 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN CAST(o_orderkey % 5000 AS DOUBLE) "
            "ELSE CAST(0 AS DOUBLE) END AS AMT_CREDIT_MAX_OVERDUE",
            "CAST(o_orderkey % 4 AS INT) AS CNT_CREDIT_PROLONG",
            "CASE WHEN o_orderkey % 23 = 0 THEN CAST(0 AS DOUBLE) WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_totalprice END AS AMT_CREDIT_SUM",
            "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST((o_orderkey * 31) % 90000 AS DOUBLE) END AS AMT_CREDIT_SUM_DEBT",
            "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST((o_orderkey * 17) % 40000 AS DOUBLE) END AS AMT_CREDIT_SUM_LIMIT",
            "CAST(CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey % 3000 ELSE 0 END AS DOUBLE) AS AMT_CREDIT_SUM_OVERDUE",
            "CASE o_orderpriority WHEN '1-URGENT' THEN 'Microloan' WHEN '2-HIGH' THEN 'Credit card' "
            "WHEN '3-MEDIUM' THEN 'Consumer credit' WHEN '4-NOT SPECIFIED' THEN 'Car loan' ELSE 'Mortgage' END AS CREDIT_TYPE",
            "CAST(-(o_orderkey % 700) AS INT) AS DAYS_CREDIT_UPDATE",
            "CASE WHEN o_orderkey % 4 <> 0 THEN NULL ELSE CAST((o_orderkey * 7) % 20000 AS DOUBLE) END AS AMT_ANNUITY",
        ],
    ),
    "bureau_balance": (
        "lineitem",
        None,
        [
            "l_orderkey AS SK_ID_BUREAU",
            "-l_linenumber AS MONTHS_BALANCE",
            "CASE CAST(l_quantity AS INT) % 9 WHEN 0 THEN '0' WHEN 1 THEN 'C' WHEN 2 THEN '1' WHEN 3 THEN '2' "
            "WHEN 4 THEN '3' WHEN 5 THEN '4' WHEN 6 THEN '5' WHEN 7 THEN 'X' ELSE NULL END AS STATUS",
        ],
    ),
    "previous_application": (
        "orders",
        None,
        [
            "o_orderkey AS SK_ID_PREV",
            # every 7th customer's earlier applications point to no applicant
            "CASE WHEN o_custkey % 7 = 0 THEN -o_custkey ELSE o_custkey END AS SK_ID_CURR",
            "CASE WHEN o_orderkey % 10 < 6 THEN 'Approved' WHEN o_orderkey % 10 < 8 THEN 'Refused' "
            "WHEN o_orderkey % 10 = 8 THEN 'Canceled' ELSE 'Unused offer' END AS NAME_CONTRACT_STATUS",
            "{DD:o_orderdate} AS DAYS_DECISION",
            "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST((o_orderkey * 7) % 30000 AS DOUBLE) END AS AMT_ANNUITY",
            "CAST((o_orderkey * 29) % 200000 AS DOUBLE) AS AMT_APPLICATION",
            "o_totalprice AS AMT_CREDIT",
            "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST((o_orderkey * 3) % 9000 AS DOUBLE) END AS AMT_DOWN_PAYMENT",
            "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) / 100 END AS RATE_DOWN_PAYMENT",
            "CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 < 4 THEN CAST(365243 AS DOUBLE) "
            "ELSE CAST({DD:o_orderdate} + 5 AS DOUBLE) END AS DAYS_FIRST_DRAWING",
            "CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST({DD:o_orderdate} + 30 AS DOUBLE) END AS DAYS_FIRST_DUE",
            "CASE WHEN o_orderkey % 15 = 0 THEN CAST(365243 AS DOUBLE) ELSE CAST({DD:o_orderdate} + 300 AS DOUBLE) END AS DAYS_LAST_DUE_1ST_VERSION",
            "CASE WHEN o_orderkey % 4 = 0 THEN CAST(365243 AS DOUBLE) ELSE CAST({DD:o_orderdate} + 300 + o_orderkey % 60 AS DOUBLE) END AS DAYS_LAST_DUE",
            "CASE WHEN o_orderkey % 4 = 0 THEN CAST(365243 AS DOUBLE) ELSE CAST({DD:o_orderdate} + 310 + o_orderkey % 45 AS DOUBLE) END AS DAYS_TERMINATION",
            "CASE WHEN o_orderkey % 10 IN (6, 7) THEN (CASE o_orderkey % 5 WHEN 0 THEN 'SCO' WHEN 1 THEN 'LIMIT' "
            "WHEN 2 THEN 'HC' WHEN 3 THEN 'CLIENT' ELSE 'SCOFR' END) ELSE 'XAP' END AS CODE_REJECT_REASON",
            "CASE o_orderkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'middle' WHEN 2 THEN 'low_normal' "
            "WHEN 3 THEN 'low_action' ELSE 'XNA' END AS NAME_YIELD_GROUP",
            "CASE WHEN o_orderkey % 3 = 0 THEN 'POS' WHEN o_orderkey % 3 = 1 THEN 'Cash' ELSE 'Cards' END AS NAME_PORTFOLIO",
            "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_orderkey % 2 AS DOUBLE) END AS NFLAG_INSURED_ON_APPROVAL",
            "CASE WHEN o_orderkey % 21 = 0 THEN NULL ELSE CAST(6 * (1 + o_orderkey % 10) AS DOUBLE) END AS CNT_PAYMENT",
        ],
    ),
    "pos_cash": (
        "lineitem",
        None,
        [
            "l_orderkey AS SK_ID_PREV",
            "-l_linenumber AS MONTHS_BALANCE",
            "CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE CAST(6 + l_partkey % 30 AS DOUBLE) END AS CNT_INSTALMENT",
            "CASE WHEN l_returnflag = 'R' THEN 'Completed' ELSE 'Active' END AS NAME_CONTRACT_STATUS",
            "CAST(CASE WHEN l_partkey % 8 = 0 THEN l_partkey % 40 ELSE 0 END AS INT) AS SK_DPD",
            "CAST(CASE WHEN l_partkey % 16 = 0 THEN l_partkey % 20 ELSE 0 END AS INT) AS SK_DPD_DEF",
        ],
    ),
    "installments": (
        "lineitem",
        None,
        [
            "l_orderkey AS SK_ID_PREV",
            "{DD:l_shipdate} AS DAYS_INSTALMENT",
            "l_linenumber AS NUM_INSTALMENT_NUMBER",
            "l_partkey AS NUM_INSTALMENT_VERSION",
            "l_suppkey AS SK_ID_CURR",
            "CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE CAST({DD:l_shipdate} + l_partkey % 21 - 12 AS DOUBLE) END AS DAYS_ENTRY_PAYMENT",
            "CASE WHEN l_partkey % 43 = 0 THEN CAST(0 AS DOUBLE) ELSE l_extendedprice END AS AMT_INSTALMENT",
            "CASE WHEN l_partkey % 29 = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN l_extendedprice / 2 ELSE l_extendedprice END AS AMT_PAYMENT",
        ],
    ),
    "credit_card": (
        "lineitem",
        None,
        [
            "l_orderkey AS SK_ID_PREV",
            "-l_linenumber AS MONTHS_BALANCE",
            "{DD:l_shipdate} AS SK_ID_CURR",
            "l_partkey AS AMT_DRAWINGS_ATM_CURRENT",
            "l_suppkey AS CNT_DRAWINGS_ATM_CURRENT",
            "CASE WHEN l_partkey % 6 = 0 THEN CAST(0 AS DOUBLE) ELSE l_extendedprice END AS AMT_BALANCE",
            "CASE WHEN l_partkey % 10 = 0 THEN 0 ELSE CAST(45000 * (1 + l_partkey % 9) AS INT) END AS AMT_CREDIT_LIMIT_ACTUAL",
            "CAST((l_partkey * 11) % 7000 AS DOUBLE) AS AMT_DRAWINGS_CURRENT",
            "CAST((l_partkey * 13) % 9000 AS DOUBLE) AS AMT_PAYMENT_TOTAL_CURRENT",
            "CASE WHEN l_partkey % 6 = 0 THEN CAST(0 AS DOUBLE) ELSE l_extendedprice * 0.9e0 END AS AMT_RECEIVABLE_PRINCIPAL",
            "l_extendedprice AS AMT_RECIVABLE",
            "l_extendedprice AS AMT_TOTAL_RECEIVABLE",
            "CASE WHEN l_returnflag = 'R' THEN 'Completed' ELSE 'Active' END AS NAME_CONTRACT_STATUS",
            "CAST(l_partkey % 6 AS INT) AS CNT_DRAWINGS_CURRENT",
            "CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(l_partkey % 50 AS DOUBLE) END AS CNT_INSTALMENT_MATURE_CUM",
            "CAST(CASE WHEN l_partkey % 8 = 0 THEN l_partkey % 40 ELSE 0 END AS INT) AS SK_DPD",
            "CAST(CASE WHEN l_partkey % 16 = 0 THEN l_partkey % 20 ELSE 0 END AS INT) AS SK_DPD_DEF",
        ],
    ),
}

def view_sql(name: str, dialect: str = "duckdb") -> str:
    source, where, exprs = VIEWS[name]
    body = ",\n  ".join(_render(e, dialect) for e in exprs)
    sql = f"SELECT {body}\nFROM {source}"
    if where:
        sql += f" WHERE {where}"
    return sql


def with_views(sql: str, names: list[str]) -> str:
    """Prefix a DuckDB query with the adapter views it uses as CTEs."""
    ctes = ",\n".join(f"{n} AS (\n{view_sql(n, 'duckdb')}\n)" for n in names)
    return f"WITH {ctes}\n{sql}"


def read_source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def load_view(spark: SparkSession, sf_dir: str, name: str, source_df: DataFrame | None = None) -> DataFrame:
    """One adapter view as a Spark DataFrame (lazy; pruned and pushed down by Catalyst)."""
    source, where, exprs = VIEWS[name]
    df = source_df if source_df is not None else read_source(spark, sf_dir, source)
    if where:
        df = df.where(where)
    return df.selectExpr(*[_render(e, "spark") for e in exprs])


class Tables:
    """Lazy accessor: ``Tables(spark, sf_dir).bureau`` etc."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = load_view(self.spark, self.sf_dir, name, self.raw(VIEWS[name][0]))
        return self._cache[name]

    def raw(self, table: str) -> DataFrame:
        """A given table, read once per accessor (one file listing and footer read)."""
        key = f"raw:{table}"
        if key not in self._cache:
            self._cache[key] = read_source(self.spark, self.sf_dir, table)
        return self._cache[key]

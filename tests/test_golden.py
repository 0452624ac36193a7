"""Every feature-list row on the smallest tables against stored sums, so that no row of the lists can change unseen.

The oracles render the same lists as the Spark code; the stored sums do not. They were computed once with
DuckDB and are rewritten only on purpose (``python tests/test_golden.py``).
"""
import json
import math
import os

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
PATH = os.path.join(HERE, "golden_features.json")
QUERIES = ["bureau_balance_agg", "bureau_agg", "pos_cash_agg", "installments_agg", "credit_card_agg", "previous_agg"]
KEYS = {"SK_ID_CURR", "SK_ID_PREV", "SK_ID_BUREAU"}


def from_duckdb() -> dict:
    import sys

    import duckdb

    sys.path.insert(0, os.path.dirname(HERE))
    import __spark_entry__ as entry

    con, sql = duckdb.connect(), entry.oracle_sql()
    for t in ("customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    out = {}
    for q in QUERIES:
        names = [c[0] for c in con.execute(f"SELECT * FROM ({sql[q]}) LIMIT 0").description if c[0] not in KEYS]
        values = con.execute("SELECT " + ", ".join(f'count("{n}"), sum(CAST("{n}" AS DOUBLE))' for n in names) + f" FROM ({sql[q]})").fetchone()
        out[q] = {n: [values[2 * i], values[2 * i + 1] and float(f"{values[2 * i + 1]:.9g}")] for i, n in enumerate(names)}
    return out


@pytest.mark.parametrize("query", QUERIES)
def test_feature_sums(spark, query):
    from pyspark.sql import functions as F

    import __spark_entry__ as entry

    with open(PATH) as f:
        expected = json.load(f)[query]
    df = entry.queries()[query](spark, "/root/testdata/sf0.001")
    names = [c for c in df.columns if c not in KEYS]
    assert names == list(expected)
    row = df.agg(*[a for n in names for a in (F.count(n), F.sum(F.col(n).cast("double")))]).first()
    for i, n in enumerate(names):
        count, total = row[2 * i], row[2 * i + 1]
        assert count == expected[n][0], n
        assert total == expected[n][1] or math.isclose(total, expected[n][1], rel_tol=1e-7, abs_tol=1e-7), n


def test_a_changed_kind_is_seen(spark, monkeypatch):
    """Each kind swapped for another in one row of the card list: the sums of that row differ."""
    from dataclasses import replace

    from riskloom.plans import specs

    with open(PATH) as f:
        expected = json.load(f)["credit_card_agg"]
    swap = {"mean": "max", "max": "sum", "sum": "max"}
    changed = [(i, replace(a, kind=swap[a.kind])) for i, a in enumerate(specs.CREDIT_CARD) if a.kind in swap]
    assert changed
    rows = list(specs.CREDIT_CARD)
    for i, a in changed:
        rows[i] = a
    monkeypatch.setattr(specs, "CREDIT_CARD", rows)
    import __spark_entry__ as entry
    from pyspark.sql import functions as F

    df = entry.queries()["credit_card_agg"](spark, "/root/testdata/sf0.001")
    got = df.agg(*[F.sum(F.col(a.name).cast("double")).alias(a.name) for _, a in changed]).first()
    unseen = [a.name for _, a in changed if math.isclose(got[a.name] or 0, expected[a.name][1] or 0, rel_tol=1e-7)]
    # these three ratios are the same in every row of the test table, so their mean is their maximum
    constant = {"cc_interest_mean", "cc_cost_mean", "cc_loan_rate_mean"}
    assert not [n for n in unseen if expected[n][1] and n not in constant], unseen


if __name__ == "__main__":
    with open(PATH, "w") as out:
        json.dump(from_duckdb(), out, indent=0)

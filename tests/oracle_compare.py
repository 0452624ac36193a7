"""Spark result vs DuckDB oracle, compared the way the correctness gate does:
columns sorted by name, row count, column types, order-insensitive values."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(v):
    if v is None:
        return None
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, (int, float)) or hasattr(v, "__float__") and not isinstance(v, str):
        try:
            return float(v)
        except (TypeError, ValueError):
            return str(v)
    return str(v)


def _rows(df: pd.DataFrame, cols: list[str]) -> list[tuple]:
    data = [[_value(v) for v in df[c].tolist()] for c in cols]
    rows = list(zip(*data)) if data else []
    return sorted(rows, key=lambda r: tuple((v is None, isinstance(v, str), v if v is not None else 0) for v in r))


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
          "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def type_problems(spark_df, rel) -> list[str]:
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    out = []
    for name, t in spark_df.dtypes:
        want = _TYPES.get(t, t)
        got = duck_types.get(name)
        if got is not None and got != want:
            out.append(f"{name}: spark {t} vs duckdb {got}")
    return out


def compare(spark_df, sql: str, con) -> list[str]:
    problems = []
    rel = con.sql(sql)
    problems += [f"type {p}" for p in type_problems(spark_df, rel)]
    left = spark_df.toPandas()
    right = rel.df()
    if sorted(left.columns) != sorted(right.columns):
        problems.append(f"columns differ: spark-only {sorted(set(left.columns)-set(right.columns))} "
                        f"oracle-only {sorted(set(right.columns)-set(left.columns))}")
        return problems
    if len(left) != len(right):
        problems.append(f"row count {len(left)} vs {len(right)}")
        return problems
    cols = sorted(left.columns)
    a, b = _rows(left, cols), _rows(right, cols)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        diffcols = [c for c, u, v in zip(cols, x, y) if u != v]
        problems.append(f"{len(bad)} differing rows; first differs in {diffcols[:8]}: "
                        f"{[(u, v) for u, v in zip(x, y) if u != v][:4]}")
    return problems

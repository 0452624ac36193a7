"""Quoted CSV against pandas, cell by cell, with one split and with many."""
import random

import pandas as pd
import pytest

from riskloom.sources import quoted, readers, schemas

CELLS = ["plain", "a,b", 'a "b" c', '"', '""', "line\nbreak", "two\n\nbreaks", "crlf\r\nbreak", 'q "r",\n"s"', "", "NA", " lead", "é\nü", ",", "\n"]


def cell(text):
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n') else text


def write(path, rows, end="\n"):
    with open(path, "w", newline="") as f:
        for row in [("k", "a", 'the "b", quoted', "c"), *rows]:
            f.write(",".join(map(cell, row)) + end)


def rows_of(n, seed):
    rng = random.Random(seed)
    return [(str(i), *(rng.choice(CELLS) for _ in range(3))) for i in range(n)]


def same_as_pandas(df, *paths):
    want = pd.concat([pd.read_csv(p, dtype=str, keep_default_na=False, lineterminator=None) for p in paths])
    got = df.toPandas().fillna("")
    assert list(got.columns) == list(want.columns)
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


@pytest.fixture()
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_split(spark, tmp_path, end):
    write(tmp_path / "a.csv", rows_of(60, 1), end)
    same_as_pandas(quoted.read_raw(spark, str(tmp_path / "a.csv")), tmp_path / "a.csv")


def test_many_splits_of_two_files(spark, tmp_path, small_splits):
    rows = rows_of(400, 2)
    rows[200] = ("200", "x" * 100 + "\n" * 3000 + "y, z", "a", "b")  # a cell over several whole splits
    rows[300] = ("300", '"\n' * 900, '"', "\n")
    write(tmp_path / "a.csv", rows)
    write(tmp_path / "b.csv", rows_of(100, 3))
    lines = quoted._lines(spark, str(tmp_path))
    assert lines.select("file", "start").distinct().count() > 20 and quoted._inside(lines)
    same_as_pandas(quoted.read_raw(spark, str(tmp_path)), tmp_path / "a.csv", tmp_path / "b.csv")


def test_without_line_breaks_the_plain_reader_is_used(spark, tmp_path):
    rows = [r for r in rows_of(200, 4) if "\n" not in "".join(r)]
    write(tmp_path / "a.csv", rows)
    df = quoted.read_raw(spark, str(tmp_path / "a.csv"))
    same_as_pandas(df, tmp_path / "a.csv")
    assert "FileScan csv" in df._jdf.queryExecution().executedPlan().toString()


def test_an_open_quote_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,a\n1,"open\n2,b\n')
    with pytest.raises(ValueError, match="not closed"):
        quoted.read_raw(spark, str(tmp_path / "a.csv"))


def test_empty_lines_short_rows_and_header_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,a,b\n\n1,"x\ny",z\n\n2,w\n')
    got = sorted(tuple(r) for r in quoted.read_raw(spark, str(tmp_path / "a.csv")).collect())
    assert got == [("1", "x\ny", "z"), ("2", "w", None)]
    (tmp_path / "b.csv").write_text('k,"a\nb"\n')
    df = quoted.read_raw(spark, str(tmp_path / "b.csv"))
    assert df.columns == ["k", "a\nb"] and df.collect() == []


def test_sources_are_typed_and_cleaned_as_before(spark, tmp_path):
    (tmp_path / "bureau_balance.csv").write_text('SK_ID_BUREAU,MONTHS_BALANCE,STATUS,NOTE\n1,-1.0,"C","said ""no"",\nthen left"\n"2",NA,"","7"\n')
    df = readers.read_source(spark, str(tmp_path), "bureau_balance")
    assert sorted(tuple(r) for r in df.collect()) == [(1, -1, "C", 'said "no",\nthen left'), (2, None, None, "7")]
    assert schemas.BUREAU_BALANCE["MONTHS_BALANCE"].dataType == df.schema["MONTHS_BALANCE"].dataType

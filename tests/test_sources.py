"""Readers (declared schema, null tokens, missing-input report) and the written feature build."""
import os

import pytest

from riskloom.sources import readers, schemas, sinks
from riskloom.sources.adapters import VIEWS


def test_missing_inputs_are_all_listed(spark, tmp_path):
    paths = {"a": str(tmp_path / "nope1.csv"), "b": str(tmp_path / "nope2.csv")}
    with pytest.raises(FileNotFoundError) as err:
        readers.check_inputs(spark, paths)
    assert "nope1.csv" in str(err.value) and "nope2.csv" in str(err.value)


def test_csv_null_tokens_and_types(spark, tmp_path):
    p = tmp_path / "bureau_balance.csv"
    p.write_text("SK_ID_BUREAU,MONTHS_BALANCE,STATUS\n1,-1,C\n2,NA,XNA\n3,,null\n4,abc,5\n")
    df = readers.read_csv(spark, str(p), schemas.BUREAU_BALANCE)
    assert dict(df.dtypes) == {"SK_ID_BUREAU": "bigint", "MONTHS_BALANCE": "int", "STATUS": "string"}
    got = sorted(tuple(r) for r in df.collect())
    assert got == [(1, -1, "C"), (2, None, "XNA"), (3, None, None), (4, None, "5")]


def test_undeclared_columns_are_typed_by_all_their_values(spark, tmp_path):
    p = tmp_path / "application_train.csv"
    rows = [f"{i},{i % 2},{i * 0.5},{'x' if i == 1400 else i},block {i % 3},NA" for i in range(1500)]
    p.write_text("SK_ID_CURR,TARGET,APARTMENTS_AVG,MIXED,FONDKAPREMONT_MODE,EMPTY\n" + "\n".join(rows) + "\n")
    df = readers.read_csv(spark, str(p), schemas.APPLICATION)
    types = dict(df.dtypes)
    assert types["APARTMENTS_AVG"] == "double" and types["MIXED"] == types["FONDKAPREMONT_MODE"] == types["EMPTY"] == "string"


def test_unreadable_cells_are_reported(spark, tmp_path):
    p = tmp_path / "bureau_balance.csv"
    p.write_text("SK_ID_BUREAU,MONTHS_BALANCE,STATUS\n1,-1.0,C\n2,bad,X\n3,-2.5,\n4, NA,5\n")
    report = []
    df = readers.read_csv(spark, str(p), schemas.BUREAU_BALANCE, report)
    assert sorted(tuple(r) for r in df.collect()) == [(1, -1, "C"), (2, None, "X"), (3, None, None), (4, None, "5")]
    assert report == [("MONTHS_BALANCE", 3)]  # ' NA' is no null token, as in the reference's reader


def test_parquet_sources_are_cleaned_and_keys_checked(spark, tmp_path):
    spark.createDataFrame([(1, 2, float("nan"), 5.0), (2, 3, 1.0, 6.0)], "SK_ID_PREV long, SK_ID_CURR long, AMT_PAYMENT double, NUM_INSTALMENT_NUMBER double") \
        .write.parquet(f"{tmp_path}/installments_payments.parquet")
    df = readers.read_source(spark, str(tmp_path), "installments", "parquet")
    assert dict(df.dtypes)["NUM_INSTALMENT_NUMBER"] == "int"
    assert sorted((r.SK_ID_PREV, r.AMT_PAYMENT, r.NUM_INSTALMENT_NUMBER) for r in df.collect()) == [(1, None, 5), (2, 1.0, 6)]
    bad = readers.assert_keys(spark.createDataFrame([(None, 1)], "SK_ID_PREV long, SK_ID_CURR long"), "installments")
    with pytest.raises(Exception, match="null in key"):
        bad.collect()


def test_scratch_tables_can_be_removed(spark):
    before, sinks._SCRATCH[:] = list(sinks._SCRATCH), []
    try:
        table = sinks.materialize(spark.range(5).toDF("x"))
        path = sinks._SCRATCH[-1]
        assert table.count() == 5 and readers.path_exists(spark, path)
        assert sinks.clear_scratch(spark) == 1 and not readers.path_exists(spark, path)
    finally:
        sinks._SCRATCH[:] = before


def test_build_features_writes_every_output(spark, tables01):
    out = sinks.scratch_path(spark, "build")
    srcs = {name: getattr(tables01, name) for name in VIEWS}
    paths = sinks.build_features(spark, srcs, out)
    assert set(paths) == {"bureau_agg", "installments_agg", "credit_card_agg", "previous_agg", "processed"}
    n_app = tables01.application.count()
    assert spark.read.parquet(paths["processed"]).count() == n_app
    assert spark.read.parquet(paths["previous_agg"]).select("SK_ID_CURR").distinct().count() == \
        spark.read.parquet(paths["previous_agg"]).count()


def test_load_sources_from_csv(spark, tables01):
    raw = sinks.scratch_path(spark, "raw")
    for name, (file_name, _) in schemas.SOURCES.items():
        getattr(tables01, name).write.option("header", True).csv(os.path.join(raw, file_name))
    loaded = readers.load_sources(spark, raw)
    assert loaded["bureau"].count() == tables01.bureau.count()
    assert dict(loaded["credit_card"].dtypes)["AMT_CREDIT_LIMIT_ACTUAL"] == "int"


def test_command_line_jobs(spark, tables01, tmp_path):
    from riskloom.__main__ import main

    raw = sinks.scratch_path(spark, "cli-raw")
    for name, (file_name, _) in schemas.SOURCES.items():
        getattr(tables01, name).write.option("header", True).csv(os.path.join(raw, file_name))
    out = sinks.scratch_path(spark, "cli-out")
    main(["features", "--raw", raw, "--out", out])
    main(["eda", "--raw", raw, "--out", out])
    assert spark.read.parquet(f"{out}/processed").count() == tables01.application.count()
    pq = sinks.scratch_path(spark, "cli-parquet")
    main(["convert", "--raw", raw, "--out", pq])
    out2 = sinks.scratch_path(spark, "cli-out2")
    main(["features", "--raw", pq, "--out", out2, "--format", "parquet"])
    assert spark.read.parquet(f"{out2}/previous_agg").count() == spark.read.parquet(f"{out}/previous_agg").count()
    bins = spark.read.parquet(f"{out}/eda/quantile_bins")
    assert bins.select("feature").distinct().count() == 12


def test_command_line_train(spark, tables01):
    from riskloom.__main__ import main

    raw = sinks.scratch_path(spark, "cli-train-raw")
    for name, (file_name, _) in schemas.SOURCES.items():
        table = getattr(tables01, name)
        if name == "application":  # columns of the real file that no schema declares
            table = table.selectExpr("*", "SK_ID_CURR * 0.5 AS APARTMENTS_AVG", "concat('k', SK_ID_CURR % 4) AS FONDKAPREMONT_MODE")
        table.write.option("header", True).csv(os.path.join(raw, file_name))
    out = sinks.scratch_path(spark, "cli-train-out")
    main(["train", "--raw", raw, "--out", out, "--model", "lr"])
    auc = {r["split"]: r for r in spark.read.parquet(f"{out}/lr/auc").collect()}
    assert set(auc) == {"train", "validation", "test"}
    assert spark.read.parquet(f"{out}/lr/threshold_sweep").count() == 9
    from pyspark.ml import PipelineModel

    assert len(PipelineModel.load(f"{out}/lr/model").stages) == 3
    # the same from the tables that a features job wrote
    written = sinks.scratch_path(spark, "cli-train-features")
    main(["features", "--raw", raw, "--out", written])
    main(["train", "--raw", raw, "--out", f"{out}2", "--model", "lr", "--features", written])
    again = {r["split"]: r for r in spark.read.parquet(f"{out}2/lr/auc").collect()}
    assert {k: (r["n_pos"], r["n_neg"]) for k, r in again.items()} == {k: (r["n_pos"], r["n_neg"]) for k, r in auc.items()}
    assert all(abs(again[k]["auc"] - auc[k]["auc"]) < 1e-6 for k in auc)

"""Batches that are merged into written states: what is read and shuffled."""
from pyspark.sql import functions as F

from riskloom.operators import states
from riskloom.plans import features as fe, increments, specs
from riskloom.sources import sinks


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _loans(spark, n=40):
    return spark.range(n).select(
        F.when(F.col("id") % 9 > 0, F.col("id") % 7).alias("SK_ID_PREV"), (-(F.col("id") % 5)).cast("int").alias("MONTHS_BALANCE"),
        F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("CNT_INSTALMENT"),
        F.when(F.col("id") % 4 > 0, F.lit("Completed")).otherwise("Active").alias("NAME_CONTRACT_STATUS"),
        (F.col("id") % 6).cast("int").alias("SK_DPD"), F.lit(0).alias("SK_DPD_DEF"), F.col("id").alias("unread"),
    )


def test_a_merge_does_not_shuffle_the_old_state(spark):
    rollup_, rows = increments.ROLLUPS["pos_cash"], _loans(spark)
    first = rollup_.advance(None, rows.where("unread < 20"))
    merged = states.merge(first, rollup_.state(rows.where("unread >= 20")), rollup_.key, rollup_.specs)
    side = _plan(merged).split("FileScan")[0].split("Exchange hashpartitioning")
    assert _plan(merged).count("Exchange hashpartitioning") == 1 and len(side) == 1  # the new rows' own, none above the scan
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("riskloom_state")]
    assert merged.count() == 8 - 1


def test_a_batch_reads_its_own_rows_and_columns(spark, monkeypatch):
    seen = []
    advance = increments.Rollup.advance
    monkeypatch.setattr(increments.Rollup, "advance", lambda self, old, rows: seen.append(rows) or advance(self, old, rows))
    rows = _loans(spark)
    got = increments.in_batches("pos_cash", rows)
    assert len(seen) == 3 and sum(r.count() for r in seen) == 40
    for part in seen:
        assert "unread" not in part.columns and "PartitionFilters: [isnotnull(arrives_in" in _plan(part)
    names = [a.name for a in specs.POS_CASH]
    want = {tuple(r) for r in fe.pos_cash_agg(rows).select("SK_ID_PREV", *names).collect()}
    assert {tuple(r) for r in got.select("SK_ID_PREV", *names).collect()} == want


def test_batches_of_an_empty_table(spark):
    assert increments.in_batches("pos_cash", _loans(spark).where("unread < 0")).collect() == []


def test_bucketed_tables_leave_no_name(spark):
    table = sinks.bucketed(spark.range(10), "id")
    assert "Exchange" not in _plan(table.groupBy("id").count()) and table.count() == 10
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("riskloom_table")]

"""Committed builds: interrupted jobs, reuse, joins without an exchange, clean-up."""
import pytest
from pyspark.sql import functions as F

from riskloom.plans import build as plan
from riskloom.sources import schemas, sinks
from riskloom.sources.committed import Build, Table, fingerprint


def _tables(calls, fail=()):
    def made(name, fn):
        def make(t):
            calls.append(name)
            if name in fail:
                raise RuntimeError("lost")
            return fn(t)
        return make
    return [
        Table("sums", "k", ["left"], made("sums", lambda t: t["left"].groupBy("k").agg(F.sum("v").alias("total v")))),
        Table("joined", "k", ["sums", "right"], made("joined", lambda t: t["right"].join(t["sums"], "k", "left"))),
    ]


@pytest.fixture
def sources(spark):
    return {"left": spark.range(100).selectExpr("id % 10 AS k", "id AS v"), "right": spark.range(20).withColumnRenamed("id", "k")}


@pytest.fixture
def folder(spark):
    return sinks.scratch_path(spark, "committed")


def _names(spark):
    return {t.name for t in spark.catalog.listTables() if t.name.startswith("riskloom_")}


def test_unchanged_inputs_are_not_computed_again(spark, sources, folder):
    calls, prints = [], {"left": "l1", "right": "r1"}
    with Build(spark, folder) as b:
        assert b.run(_tables(calls), sources, prints) == ["sums", "joined"]
        first = b.manifest()
        assert b.run(_tables(calls), sources, prints) == [] and b.manifest() == first
        assert b.run(_tables(calls), sources, prints | {"right": "r2"}) == ["joined"]
        assert b.manifest()["tables"]["sums"] == first["tables"]["sums"]
        assert b.run(_tables(calls), sources, prints | {"left": "l2", "right": "r2"}) == ["sums", "joined"]
        assert calls == ["sums", "joined", "joined", "sums", "joined"]
        assert b.numbers() == [1, 2, 3]
        assert b.table("sums", 1).count() == 10


def test_a_changed_definition_is_computed_again(spark, sources, folder):
    prints = {"left": "l", "right": "r"}
    with Build(spark, folder) as b:
        b.run(_tables([]), sources, prints)
        old, last = _tables([])
        changed = [Table(old.name, old.key, old.inputs, old.make, "two"), last]
        assert b.run(changed, sources, prints) == ["sums", "joined"]
        assert b.run(changed, sources, prints, buckets=3) == ["sums", "joined"]
        assert b.manifest()["buckets"] == 3
        assert b.run(changed[:1], sources, prints) == [] and set(b.manifest()["tables"]) == {"sums"}


def test_an_interrupted_job_leaves_the_old_build(spark, sources, folder):
    before = _names(spark)
    with Build(spark, folder) as b:
        b.run(_tables([]), sources, {"left": "l1", "right": "r1"})
        rows, manifest = sorted(map(tuple, b.table("joined").collect())), b.manifest()
    with Build(spark, folder) as b:
        more = sources | {"left": sources["left"].withColumn("v", F.col("v") + 1)}
        with pytest.raises(RuntimeError, match="lost"):
            b.run(_tables([], fail=["joined"]), more, {"left": "l2", "right": "r1"})
    with Build(spark, folder) as b:
        assert b.manifest() == manifest and sorted(map(tuple, b.table("joined").collect())) == rows
        gone = b.vacuum()  # the table that the lost job had written
        assert len(gone) == 1 and gone[0].startswith("sums-")
        assert sorted(map(tuple, b.table("joined").collect())) == rows
    assert _names(spark) == before


def test_a_task_that_fails_leaves_no_name_behind(spark, sources, folder):
    broken = sources | {"left": sources["left"].withColumn("v", F.raise_error(F.lit("boom")).cast("bigint"))}
    with Build(spark, folder) as b:
        with pytest.raises(Exception, match="boom"):
            b.run(_tables([]), broken, {"left": "l", "right": "r"})
        assert b.manifest()["number"] == 0 and not _names(spark)
        with pytest.raises(KeyError, match="no committed table"):
            b.table("sums")


def test_two_jobs_at_once(spark, sources, folder):
    prints = {"left": "l", "right": "r"}
    with Build(spark, folder) as b, Build(spark, folder) as other:
        def late(t):  # the other job commits while this one computes
            other.run(_tables([]), sources, prints)
            return t["left"]
        with pytest.raises(RuntimeError, match="committed build 1 first"):
            b.run([Table("mine", "k", ["left"], late)], sources, prints)
        assert set(b.manifest()["tables"]) == {"sums", "joined"} and b.numbers() == [1]
        assert [f.split("-")[0] for f in b.vacuum()] == ["mine"]


def test_vacuum_keeps_what_is_named(spark, sources, folder):
    with Build(spark, folder) as b:
        for i in range(3):
            b.run(_tables([]), sources, {"left": "l", "right": f"r{i}"})
        gone = b.vacuum(keep=2)
        assert len(gone) == 1 and gone[0].startswith("joined-") and b.numbers() == [2, 3]
        assert b.table("joined", 2).count() == b.table("joined").count() == 20
        with pytest.raises(ValueError):
            b.vacuum(keep=0)


def test_odd_rows_and_names(spark, folder):
    """Empty tables, null and repeated keys, and column names that need quotes."""
    schema = "k long, `a b,c` string, `x.y` double, `tick``ed` array<struct<`p q`:int>>"
    rows = [(None, "n", None, None), (1, "q", 0.5, [(1,)]), (1, "q", 0.5, [(1,)])]
    src = {"rows": spark.createDataFrame(rows, schema), "none": spark.createDataFrame([], schema)}
    tables = [Table("full", "k", ["rows"], lambda t: t["rows"]), Table("empty", "k", ["none"], lambda t: t["none"])]
    with Build(spark, folder) as b:
        b.run(tables, src, {"rows": "a", "none": "b"})
        assert sorted(map(repr, b.table("full").collect())) == sorted(map(repr, src["rows"].collect()))
        assert b.table("empty").count() == 0 and b.table("empty").schema.names == src["none"].schema.names


def test_fingerprint_follows_the_files(spark, folder):
    spark.range(5).write.parquet(f"{folder}/in")
    first = fingerprint(spark, f"{folder}/in")
    assert fingerprint(spark, f"{folder}/in") == first
    spark.range(5, 6).write.mode("append").parquet(f"{folder}/in")
    assert fingerprint(spark, f"{folder}/in") != first


def test_joins_of_the_feature_build_need_no_exchange(spark, tables01, folder):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    srcs = {name: getattr(tables01, name) for name in schemas.SOURCES}
    prints = dict.fromkeys(srcs, "p")
    with Build(spark, folder) as b:
        assert b.run(plan.TABLES, srcs, prints, buckets=4) == [t.name for t in plan.TABLES]
    with Build(spark, folder) as b:  # as a later job sees it
        assert b.run(plan.TABLES, srcs, prints | {"credit_card": "q"}) == ["credit_card_agg", "previous_agg"]
        n = tables01.application.count()
        assert b.table("processed").count() == n
        try:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            for joined in (plan.application_bureau(b), plan.application_previous(b)):
                text = joined._jdf.queryExecution().executedPlan().toString()
                assert "SortMergeJoin" in text and "Exchange" not in text
                assert joined.count() == n
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_command_line_build(spark, tables01, folder, capsys):
    from riskloom.__main__ import main
    from riskloom.plans import modeling

    raw = sinks.scratch_path(spark, "build-raw")
    for name, (file_name, _) in schemas.SOURCES.items():
        getattr(tables01, name).write.parquet(f"{raw}/{file_name.rsplit('.', 1)[0]}.parquet")
    args = ["build", "--raw", raw, "--out", folder, "--format", "parquet"]
    main([*args, "--buckets", "4"])
    assert "(unchanged)" not in capsys.readouterr().out
    main(args)
    assert capsys.readouterr().out.count("(unchanged)") == len(plan.TABLES)
    tables01.pos_cash.limit(10).write.mode("append").parquet(f"{raw}/POS_CASH_balance.parquet")
    main(args)
    assert capsys.readouterr().out.count("(unchanged)") == len(plan.TABLES) - 1

    class Written:
        features_dir = folder
    Written.spark = spark
    assert modeling._written(Written, "processed").count() == tables01.application.count()


def test_sources_are_read_when_asked_for(spark, tables01, monkeypatch):
    from riskloom.sources import readers

    raw, read = sinks.scratch_path(spark, "lazy-raw"), []
    for name, (file_name, _) in schemas.SOURCES.items():
        getattr(tables01, name).limit(3).write.option("header", True).csv(f"{raw}/{file_name}")
    one = readers.read_source
    monkeypatch.setattr(readers, "read_source", lambda s, d, name, *a: (read.append(name), one(s, d, name, *a))[1])
    sources = readers.Sources(spark, raw)
    assert not read and set(sources) == set(schemas.SOURCES)
    assert sources["bureau"].count() == 3 and sources["bureau"] is sources["bureau"] and read == ["bureau"]
    with pytest.raises(KeyError):
        sources["nothing"]
    with pytest.raises(FileNotFoundError):
        readers.Sources(spark, f"{raw}-none")

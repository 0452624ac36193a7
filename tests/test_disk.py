"""What the history chains leave on disk, and rows that are shuffled once where nothing combines them first."""
import random
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskloom.operators.aggspec import Agg, eq, gt
from riskloom.operators.rollup import plain_rows_are_less, rollup
from riskloom.plans import build, features as fe, modeling, processed
from riskloom.sources import schemas, sinks
from riskloom.sources.adapters import Tables
from riskloom.sources.committed import Build


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Tables of the test schema: loans without children, children without loans, rows that come twice."""
    out = str(tmp_path_factory.mktemp("made"))
    day = "timestampadd(DAY, CAST(id * 37 % 900 AS INT), TIMESTAMP_NTZ'1995-01-01')"
    spark.range(60).selectExpr("id AS c_custkey", "CAST(id % 25 AS INT) AS c_nationkey", "CAST(id * 7 % 11 - 4 AS DOUBLE) AS c_acctbal",
                               "CASE id % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' END AS c_mktsegment") \
        .write.parquet(f"{out}/customer.parquet")
    spark.range(300).selectExpr("id AS o_orderkey", "id * 13 % 70 AS o_custkey", "substr('OFP', CAST(id % 3 AS INT) + 1, 1) AS o_orderstatus",
                                "CAST(id * 211 % 5000 AS DOUBLE) AS o_totalprice", f"{day} AS o_orderdate",
                                "CASE id % 4 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' ELSE '5-LOW' END AS o_orderpriority") \
        .write.parquet(f"{out}/orders.parquet")
    lines = spark.range(1400).selectExpr(
        "id * 17 % 290 AS l_orderkey", "id * 31 % 199 AS l_partkey", "id % 10 AS l_suppkey", "CAST(id % 7 + 1 AS INT) AS l_linenumber",
        "CAST(id % 50 AS DOUBLE) AS l_quantity", "CAST(id * 97 % 9000 + 1 AS DOUBLE) AS l_extendedprice",
        "substr('RAN', CAST(id % 3 AS INT) + 1, 1) AS l_returnflag", f"{day} AS l_shipdate")
    lines.union(lines.where("l_linenumber = 3")).repartition(6).write.parquet(f"{out}/lineitem.parquet")
    return out


@pytest.fixture
def tables(spark, made):
    return Tables(spark, made)


def _shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def _left(spark, before: set[str]) -> set[str]:
    """Shuffle files that are new; their deletion is not waited for by the query."""
    for _ in range(40):
        if not (new := _shuffle_files(spark) - before):
            break
        time.sleep(0.25)
    return new


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def fitted(tables, monkeypatch):
    """The vocabulary, fitted before: it is read a partition at a time, and its own small shuffles stay until then."""
    vocabulary = processed.encode(tables.application)[1]
    encode = processed.encode
    monkeypatch.setattr(processed, "encode", lambda df, vocab=None: encode(df, vocab or vocabulary))


def _rows(df) -> list[str]:
    return sorted(map(str, df.select(*[F.round(c, 6).alias(c) if of == "double" else c for c, of in df.dtypes]).collect()))


def _prev(t):
    return t.previous_application, t.pos_cash, t.installments, t.credit_card


# ------------------------------------------------------------------ rows that travel once
SPECS = [Agg("n", "x", "count"), Agg("all", "x", "rows"), Agg("m", "x", "mean"), Agg("s", "x", "sum"), Agg("hi", "i", "max"), Agg("sd", "x", "std"),
         Agg("last_hi", "x", "last_max"), Agg("last_m", "i", "last_mean"), Agg("last_sh", "t", "last_share", eq("a")),
         Agg("last_s", "i", "last_sum", int_sum=True), Agg("last_y", "y", "last_min"), Agg("y_share", "y", "share", gt(0))]


def _scattered(spark, keys=60, per_key=4):
    rng = random.Random(5)

    def maybe(v):
        return None if rng.random() < 0.2 else v

    rows = [(maybe(k), maybe(rng.randint(0, 3)), turn, maybe(rng.randint(-9, 9) / 4), maybe(rng.randint(-5, 5)), maybe(rng.choice("ab")))
            for turn in range(per_key) for k in range(keys)]
    rows += rng.sample(rows, 30)  # whole rows that come twice
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k long, day int, turn int, x double, i int, t string").repartition(16)


@pytest.mark.parametrize("descending", [True, False])
def test_rows_that_travel_once_give_the_same(spark, monkeypatch, descending):
    from riskloom.operators import rollup as module

    rows = _scattered(spark)
    rows.cache().count()
    order = {"order_by": ["day"], "tie_break": ["turn", "x", "i", "t"], "descending": descending,
             "derive": lambda d: d.withColumn("y", F.col("x") * F.col("i"))}
    want = rollup(rows, "k", SPECS, **order)
    monkeypatch.setattr(module, "plain_rows_are_less", lambda *_: True)
    got = rollup(rows, "k", SPECS, measure=True, **order)
    assert _plan(got).count("Exchange hashpartitioning(k") == 1 and "WindowGroupLimit" not in _plan(got)
    assert got.dtypes == want.dtypes and _rows(got) == _rows(want)
    monkeypatch.setattr(module, "plain_rows_are_less", lambda *_: False)
    assert "WindowGroupLimit" in _plan(rollup(rows, "k", SPECS, measure=True, **order))
    rows.unpersist()


def test_what_decides_how_rows_travel(spark):
    apart = spark.range(0, 40000, 1, 8).selectExpr("id % 8000 AS k", "id AS v", "id AS w")
    together = spark.range(0, 40000, 1, 8).selectExpr("id DIV 20 AS k", "id AS v", "id AS w")
    hot = apart.withColumn("k", F.when(F.col("v") % 3 == 0, F.lit(1)).otherwise(F.col("k")))
    assert plain_rows_are_less(apart, "k", 6, 3)
    assert not plain_rows_are_less(together, "k", 6, 3)  # partial aggregates leave a twentieth
    assert not plain_rows_are_less(hot, "k", 6, 3)  # a third of the rows in one task
    assert not plain_rows_are_less(apart.where("k < 0"), "k", 6, 3)


# ------------------------------------------------------------------ previous chain
@pytest.mark.parametrize("name", ["previous_agg", "previous_agg_as_written", "application_previous_join"])
def test_the_last_step_shuffles_the_previous_applications_only(spark, made, name):
    """The children are aggregated before, and their shuffles are gone; the last K do not read them."""
    before = _shuffle_files(spark)
    plan = _plan(entry.queries()[name](spark, made))
    assert not _left(spark, before)
    assert "l_orderkey" not in plan and plan.count("riskloom_child") == 3
    assert plan.count("Exchange hashpartitioning(SK_ID_PREV") <= 1


def test_previous_rollup_on_rows_before_the_joins(tables):
    previous = tables.previous_application
    enriched = fe.previous_with(previous, *[make(c) for make, c in zip(
        (fe.pos_cash_agg, fe.installments_agg, fe.credit_card_agg), _prev(tables)[1:], strict=True)])
    want = _rows(fe.previous_rollup(enriched))
    assert len(want) > 50 and _rows(fe.previous_rollup(enriched, previous=previous)) == want
    assert _rows(fe.previous_agg(*_prev(tables))) == want


def test_the_setting_is_put_back(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    with pytest.raises(RuntimeError), sinks.shuffles_freed(spark):
        assert spark.conf.get(key) == "true"
        raise RuntimeError
    assert spark.conf.get(key, None) == old


def test_freed_shuffles_are_made_again_where_needed(spark):
    counted = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    before = _shuffle_files(spark)
    with sinks.shuffles_freed(spark):
        first = _rows(counted)
    assert not _left(spark, before) and _rows(counted) == first


# ------------------------------------------------------------------ model table, models, build, states
def _scratch_made(since: int) -> list[str]:
    return [name.rsplit("/", 1)[1].split("-")[1] for name in sinks._SCRATCH[since:]]


def test_model_table_deletes_the_previous_chain(spark, made, fitted):
    """what is left of it is one table by applicant."""
    before, since = _shuffle_files(spark), len(sinks._SCRATCH)
    table = entry.queries()["model_table_full"](spark, made)
    kept = sinks._SCRATCH[since:]
    assert _scratch_made(since) == ["previous"] and not _left(spark, before)
    assert table.count() == 60 and "o_custkey" not in _plan(spark.read.parquet(*kept)) and "l_partkey" not in _plan(table)


@pytest.mark.parametrize("inputs", [modeling.model_inputs, modeling.tree_inputs])
def test_model_inputs_leave_one_table(spark, tables, fitted, inputs):
    """the fits begin with the model table alone on disk."""
    before, since = _shuffle_files(spark), len(sinks._SCRATCH)
    table, features = inputs(tables)
    assert _scratch_made(since) == ["table"] and not _left(spark, before)
    assert table.count() == 60 and features


def test_ablation_frees_its_shuffles(spark, tables, fitted, monkeypatch):
    """five fits and evaluations do not add up."""
    monkeypatch.setattr(modeling, "ABLATION_GROUPS", {"ext_sources": modeling.ABLATION_GROUPS["ext_sources"]})
    before = _shuffle_files(spark)
    report = modeling.ablation_report(tables, max_iter=2)
    assert [r[0] for r in report.collect()] == ["none", "ext_sources"] and not _left(spark, before)


def test_a_build_frees_the_shuffles_of_each_table(spark, tables):
    """F3; and the last K of the previous applications read no committed table."""
    before = _shuffle_files(spark)
    sources = {name: getattr(tables, name) for name in schemas.SOURCES}
    left = []

    def watched(t):
        def make(inputs):
            left.append(_left(spark, before))
            return t.make(inputs)
        return build.Table(t.name, t.key, t.inputs, make, t.definition)

    with Build(spark, sinks.scratch_path(spark, "freed")) as done:
        assert len(done.run([watched(t) for t in build.TABLES], sources, dict.fromkeys(sources, "p"))) == len(build.TABLES)
        assert left == [set()] * len(build.TABLES)
        again = build._previous({**sources, **{name: done.table(name) for name in ("installments_agg", "credit_card_agg")}})
        assert _plan(again).count("riskloom_built") == 2


def test_merged_batches_leave_the_last_state(spark, made):
    """F7."""
    before, since = _shuffle_files(spark), len(sinks._SCRATCH)
    merged = entry.queries()["previous_agg_merged"](spark, made)
    assert _scratch_made(since) == ["state"] and not _left(spark, before)
    assert _rows(merged) == _rows(entry.queries()["previous_agg"](spark, made))

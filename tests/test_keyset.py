"""Key reduction: no child of a known parent is lost, few others stay, the joins' results are the same."""
import pytest
from pyspark.sql import functions as F

from riskloom.operators import keyset
from riskloom.plans import features as fe


def _ids(df):
    return {r[0] for r in df.collect()}


def test_parents_keep_their_children_and_most_others_go(spark):
    parents = spark.range(0, 1_000_000, 100).withColumnRenamed("id", "k")
    children = spark.range(1_000_000).withColumnRenamed("id", "k")
    kept = _ids(keyset.reduce_to(children, "k", parents))
    assert kept >= set(range(0, 1_000_000, 100))
    assert len(kept) - 10_000 < 0.01 * 990_000


def test_more_keys_than_the_blocks_hold(spark, monkeypatch):
    """A full filter lets everything pass; nothing is lost."""
    monkeypatch.setattr(keyset, "MAX_BLOCKS", 1)
    parents = spark.range(100_000).withColumnRenamed("id", "k")
    kept = _ids(keyset.reduce_to(spark.range(-5, 100_000).withColumnRenamed("id", "k"), "k", parents))
    assert kept >= set(range(100_000))


def test_odd_keys(spark):
    rows = [(1, "a"), (1, "a"), (None, "b"), (2, "c"), (-7, "d")]
    children = spark.createDataFrame(rows, "k long, _block string").withColumn("_bits", F.lit(0)).withColumn("a.b", F.lit(1))
    parents = spark.createDataFrame([(1,), (1,), (None,), (-7,)], "k long")
    out = keyset.reduce_to(children, "k", parents)
    assert out.columns == children.columns
    assert sorted((r["k"], r["_block"]) for r in out.collect()) == [(-7, "d"), (1, "a"), (1, "a")]
    assert keyset.reduce_to(children, "k", parents.limit(0)).count() == 0
    assert keyset.reduce_to(children.limit(0), "k", parents).count() == 0
    with pytest.raises(ValueError, match="hash differently"):
        keyset.reduce_to(children, "k", parents.withColumn("k", F.col("k").cast("int")))


def test_text_keys(spark):
    parents = spark.createDataFrame([("é",), ("",)], "k string")
    children = spark.createDataFrame([("é",), ("",), ("x",)], "k string")
    assert _ids(keyset.reduce_to(children, "k", parents)) == {"é", ""}


def test_a_small_part_of_the_applicants(spark, tables01):
    """The histories shrink to about that part before any shuffle; the joined rows are those of the whole rollup."""
    part = tables01.application.where(F.pmod(F.xxhash64("SK_ID_CURR"), F.lit(50)) == 0)
    share = part.count() / tables01.application.count()
    bureau, balance = fe.bureau_of(part, tables01.bureau, tables01.bureau_balance)
    for reduced, whole in ((bureau, tables01.bureau), (balance, tables01.bureau_balance)):
        assert 0 < reduced.count() < (share + 0.03) * whole.count()
        plan = reduced._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Python" not in plan
    whole = fe.application_bureau(part, tables01.bureau, tables01.bureau_balance)
    reduced = fe.application_bureau(part, tables01.bureau, tables01.bureau_balance, reduce=True)
    rounded = [F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in whole.schema]
    a, b = (sorted(map(repr, df.select(*rounded).collect())) for df in (whole, reduced))
    assert a == b

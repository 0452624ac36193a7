"""Sparse one-hot: dense ids, wide vocabularies, new values, vectors that train."""
import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskloom.operators import encode, sparse


def test_ids_are_dense_and_in_order(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["é", "a", "B", "", None, "z z"]), None if rng.random() < 0.3 else f"v{rng.randint(0, 300)}", None) for i in range(2000)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "id int, few string, `many.values` string, none string")
    columns = ["few", "many.values", "none"]
    values = sorted({(c, r[j].encode()) for r in rows for j, c in enumerate(columns, 1) if r[j] is not None})
    ids = {(c, v.decode()): k for k, (c, v) in enumerate(values)}
    table = sparse.dictionary(df)
    assert {(r["column"], r["value"]): r["id"] for r in table.collect()} == ids
    assert table.agg(F.sum("n")).first()[0] == sum(v is not None for r in rows for v in r[1:])
    out = sparse.encode(df, table, columns)
    assert out.columns == ["id", "one_hot"] and out.count() == len(rows)
    expected = {r[0]: [ids[c, r[j]] for j, c in enumerate(columns, 1) if r[j] is not None] for r in rows}
    assert all(r.one_hot == expected[r.id] for r in out.collect())


def test_new_values_nulls_clashes_and_no_rows(spark):
    fitted = sparse.dictionary(spark.createDataFrame([("a",), ("b",)], "c string"))
    new = spark.createDataFrame([(1, "b", "x"), (2, "new", "x"), (3, None, "x")], "k int, c string, value string")
    assert {r.k: r.one_hot for r in sparse.encode(new, fitted, ["c"]).collect()} == {1: [1], 2: [], 3: []}
    with pytest.raises(ValueError):
        sparse.encode(new, fitted, ["c"], name="value")
    none = new.where("false")
    assert sparse.dictionary(none).collect() == [] and sparse.encode(none, sparse.dictionary(none), ["c"]).collect() == []
    assert sparse.dictionary(none.select("k")).collect() == []


def test_a_hundred_thousand_values_train(spark):
    """A third of the rows hold one value; the label follows from the value."""
    df = spark.range(240_000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 120_000)).alias("c"), (F.col("id") % 7).cast("double").alias("x")
    ).withColumn("label", F.when(F.col("c") == "hot", 1.0).otherwise(0.0))
    table = sparse.dictionary(df, ["c"])
    size = table.count()
    assert size == 80_001 and table.agg(F.max("id")).first()[0] == size - 1
    encoded = sparse.as_vectors(sparse.encode(df, table, ["c"]), size)
    first = encoded.where("id = 4").first().one_hot
    assert first.size == size and first.numNonzeros() == 1
    both = VectorAssembler(inputCols=["x", "one_hot"], outputCol="features").transform(encoded)
    model = LogisticRegression(maxIter=5).fit(both)
    scored = model.transform(both.where("id < 600"))
    assert scored.where("prediction = label").count() >= 590


def test_dense_names_do_not_clash_with_kept_columns(spark):
    df = spark.createDataFrame([("a", 5), ("b", 6), ("c", 7)], "c string, c_a int")
    out = encode.one_hot(df, encode.fit_vocabulary(df))
    assert out.columns == ["c_a", "c_a_2", "c_b", "c_c"]
    assert [tuple(r) for r in out.orderBy("c_a").collect()] == [(5, 1, 0, 0), (6, 0, 1, 0), (7, 0, 0, 1)]

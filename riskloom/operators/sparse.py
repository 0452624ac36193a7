"""One-hot encoding as sparse vectors with a vocabulary table.

``dictionary`` is a table ``column, value, id, n``: ids are dense, in column then
value order, and are given in parallel (a sorted write, then the number of rows
before each partition). ``encode`` joins each column with its part of the table and
gives each row the ids it holds; no value is a column, a literal or a driver
row. AQE broadcasts the small parts by their measured size; the others are
shuffled by value, and a hot value's rows are split by the skew-join handling.

Nulls and values that the dictionary lacks have no id, so a table to score may
hold new values. Repeated rows stay. An empty table gives an empty dictionary.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..sources.sinks import materialize, scratch_path, write_table
from .summary import string_columns


def dictionary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, value, id, n``: the non-null values of the columns (all string ones by default) and how many rows hold each."""
    columns = list(columns or string_columns(df))
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], "column string, value string, id bigint, n bigint")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    counted = df.select(F.inline(cells)).where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    ordered = counted.repartitionByRange("column", "value").sortWithinPartitions("column", "value")
    written = materialize(ordered.withColumn("at", F.monotonically_increasing_id()))  # partition and place in it
    part = F.shiftright("at", 33)
    starts, before = [], 0
    for r in written.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # one row a partition
        starts.append((r["part"], before))
        before += r["n"]
    starts = F.broadcast(spark.createDataFrame(starts, "part bigint, before bigint"))
    place = F.col("at") - F.shiftleft(part, 33)
    return written.withColumn("part", part).join(starts, "part").select("column", "value", (F.col("before") + place).alias("id"), "n")


def encode(df: DataFrame, table: DataFrame, columns: Sequence[str], name: str = "one_hot") -> DataFrame:
    """``df`` with the ascending ids of each row's values as ``name`` (array<int>) in place of the encoded columns."""
    keep = [c for c in df.columns if c not in columns]
    if name in keep:
        raise ValueError(f"{name!r} is a column already")
    own, ids = uuid.uuid4().hex, []  # no column of df
    for i, c in enumerate(columns):
        ids.append(f"id_{i}_{own}")
        value = f"value_{i}_{own}"
        part = table.where(F.col("column") == c).select(F.col("value").alias(value), F.col("id").cast("int").alias(ids[-1]))
        df = df.join(part, df[f"`{c}`"].cast("string") == F.col(value), "left")
    return df.select(*[f"`{c}`" for c in keep], F.sort_array(F.array_compact(F.array(*ids))).alias(name))


def as_vectors(df: DataFrame, size: int, name: str = "one_hot") -> DataFrame:
    """The ids of ``name`` as a sparse 0/1 vector of ``size``, for the estimators of Spark ML; written once, as models read it often."""
    path = scratch_path(df.sparkSession, "vectors")
    ids = F.col(f"`{name}`")
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), ids.alias("indices"),
        F.transform(ids, lambda _: F.lit(1.0)).alias("values"),
    )
    write_table(df.withColumn(name, vector), path)
    fields = [StructField(f.name, VectorUDT()) if f.name == name else f for f in df.schema.fields]
    return df.sparkSession.read.schema(StructType(fields)).parquet(path)

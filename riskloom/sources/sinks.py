"""Sinks and the end-to-end feature build (SNK-01..SNK-05, SRC-08..SRC-10).

Intermediate aggregates are written as Parquet (the reference writes CSV and
reads it back "to save time due to long aggregation"). Writing a table in
the shared folder is also how a long lineage is cut: a lost executor then
recomputes from the written table, not from the raw files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> str:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` to Parquet and read it back (the write-then-read pairs of the feature build).

    Without a path the table goes under the session's shared checkpoint folder.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "table")
    write_table(df, path)
    return spark.read.parquet(path)


def bucketed(df: DataFrame, key: str, stem: str = "table", **options: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder, bucketed by ``key``, and read it back.

    There are as many buckets as shuffle partitions: a join or rollup by ``key`` reads the table without an exchange.
    The catalog's name goes at once; the DataFrame knows the buckets and the files stay.
    """
    spark = df.sparkSession
    path = scratch_path(spark, stem)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    try:
        df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).options(path=path, **options).saveAsTable(name)
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that start and end in here delete their shuffle files at their end; else these stay until the driver
    collects its garbage, which on a job of many steps means that the disk holds the shuffles of all.

    Not for ``toLocalIterator``: it reads its shuffles after the end of what Spark takes for the query.
    """
    old = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, old)


@contextmanager
def intermediate(spark: SparkSession) -> Iterator[None]:
    """The last scratch table named in here is the result; at the end those that led to it are deleted."""
    first = len(_SCRATCH)
    try:
        yield
    finally:
        _delete(spark, slice(first, -1))


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, stem: str) -> str:
    """A fresh folder below the context's checkpoint folder (shared storage on a cluster)."""
    _SCRATCH.append(f"{checkpoint_dir(spark).rstrip('/')}/riskloom-{stem}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def clear_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables that this process made; call it when no result that reads them is needed any more."""
    return _delete(spark, slice(None))


def _delete(spark: SparkSession, which: slice) -> int:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone, deleted = _SCRATCH[which], 0
    del _SCRATCH[which]
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        deleted += path.getFileSystem(conf).delete(path, True)
    return deleted


def convert_sources(sources: dict[str, DataFrame], out_dir: str) -> dict[str, str]:
    """SRC-01..07 "Parquet after the first load": write every raw source once as Parquet under
    the file stem the Parquet reader expects (``readers.read_source(..., fmt="parquet")``)."""
    from .schemas import SOURCES

    out = {}
    for name, df in sources.items():
        stem = SOURCES[name][0].rsplit(".", 1)[0]
        out[name] = write_table(df, f"{out_dir.rstrip('/')}/{stem}.parquet")
    return out


def build_features(spark: SparkSession, sources: dict[str, DataFrame], out_dir: str) -> dict[str, str]:
    """The whole feature build of 02, with its outputs written (D3, D14 included).

    Returns the written paths: bureau aggregate, instalment aggregate, card
    aggregate, previous-application aggregate and the processed table.
    """
    from ..plans import features as fe
    from ..plans import processed as pr

    out = out_dir.rstrip("/")
    paths = {}
    bureau_agg = materialize(fe.bureau_agg(sources["bureau"], sources["bureau_balance"]), f"{out}/bureau_agg")  # SNK-01
    paths["bureau_agg"] = f"{out}/bureau_agg"
    paths["installments_agg"], paths["credit_card_agg"] = f"{out}/installments_agg", f"{out}/credit_card_agg"
    # each child history is aggregated once; the previous chain reads what was written (SRC-09)
    inst = materialize(fe.installments_agg(sources["installments"], measure=True), paths["installments_agg"])  # SNK-02
    card = materialize(fe.credit_card_agg(sources["credit_card"], measure=True), paths["credit_card_agg"])  # SNK-04
    pos = fe.child_written(fe.pos_cash_agg(sources["pos_cash"]))
    enriched = fe.previous_with(sources["previous_application"], pos, inst, card)
    rolled = fe.previous_rollup(enriched, previous=sources["previous_application"])
    paths["previous_agg"] = write_table(rolled, f"{out}/previous_agg")  # SNK-05
    processed, _ = pr.encode(pr.recode(sources["application"].join(bureau_agg, "SK_ID_CURR", "left")))
    paths["processed"] = write_table(processed, f"{out}/processed")  # SNK-03
    return paths

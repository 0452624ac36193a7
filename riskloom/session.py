"""Spark session helpers.

The library never creates its own cluster settings on top of an existing
session: it reads what the session already has and only fills gaps (for
local runs and tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the library relies on for correct results; applied only when the
# session does not define them already.
_DEFAULTS = {
    # dates in the fixtures are TIMESTAMP_NTZ, but keep casts reproducible
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the rollups aggregate up to 94 outputs (~200 buffer fields) in one operator;
    # keep such operators inside whole-stage codegen (default cut-off is 100 fields)
    "spark.sql.codegen.maxFields": "1000",
    # the last-K limit sorts each scan task's rows before their shuffle; with splits of the default
    # 128 MB that sort spills on an executor of 2 GB a core
    "spark.sql.files.maxPartitionBytes": "32m",
    # batches of whole texts for the Python workers: 10,000 rows of some KB are held several times over
    # by the executor and each of its workers, and neither gives the memory back
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


# Suggested settings for a large cluster run (hundreds of TB, ~1000 executors). Not applied
# automatically: the deployment owns them. The CLI applies the ones a session leaves unset
# when called with --cluster-defaults.
CLUSTER_SETTINGS = {
    # many shuffle partitions up front; AQE coalesces them to the advisory size at run time
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # fewer, larger scan splits (row groups stay atomic)
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.codegen.maxFields": "1000",
}


def apply_cluster_settings(spark: SparkSession) -> SparkSession:
    for key, value in CLUSTER_SETTINGS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "riskloom") -> SparkSession:
    """Session for tests and the local bench (``local[cores]``)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # static settings, so only where we build the session:
        # no Python call-site capture per Column, and room in the generated-code cache for
        # the many wide stages of the rollups (the default 100 entries thrash between queries)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_defaults(spark)
    return spark


def ensure_defaults(spark: SparkSession) -> SparkSession:
    for key, value in _DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    The folder the context already uses (``setCheckpointDir`` or the
    ``spark.checkpoint.dir`` setting, which Spark reads when it starts). Only
    a local session without one gets a scratch folder of its own; a cluster
    session must name shared storage.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(
                "no checkpoint folder: start the session with spark.checkpoint.dir (or call "
                "sparkContext.setCheckpointDir) naming storage that the driver and all executors share"
            )
        named = tempfile.mkdtemp(prefix="riskloom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    return checkpoint_dir(spark)

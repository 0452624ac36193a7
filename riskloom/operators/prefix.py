"""Distributed ordered prefix sums.

A running sum over a whole ordered table is the core of exact quantiles
(rank of each value) and of the exact ROC-AUC (negatives below each score).
A window ``ORDER BY`` without ``PARTITION BY`` would put every row in one
task. Instead:

1. range-partition the rows by (group, order) into P partitions and
   checkpoint them (fixes which partition a row is in, and cuts lineage);
2. total each partition (<= groups x P rows) and turn the totals into
   per-partition offsets with a window over that small table;
3. join the offsets on (group, partition), null groups included, and add them
   to a running sum computed inside each range partition only. No broadcast is
   asked for: with many groups the offsets are as many as the groups.

Every task sees one range partition; the only global step is over P rows
per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def prefix_sums(df: DataFrame, group: str, order: str, sums: Sequence[str],
                partitions: int | None = None) -> DataFrame:
    """Adds ``<c>_before`` (sum of ``c`` over rows of the same group strictly before this
    one in ``order``) and ``<c>_total`` (group total) for every ``c`` in ``sums``.

    ``(group, order)`` must be unique (aggregate first).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, group, order).withColumn("_part", F.spark_partition_id())
    ranged = ranged.checkpoint(eager=True)

    totals = ranged.groupBy(group, "_part").agg(*[F.sum(c).alias(f"_p_{c}") for c in sums])
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    offsets = totals.select(
        group, "_part",
        *[F.coalesce(F.sum(f"_p_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums],
        *[F.sum(f"_p_{c}").over(whole).alias(f"{c}_total") for c in sums],
    )
    inside = Window.partitionBy(group, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.withColumns({f"_r_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    offsets = offsets.withColumnsRenamed({group: "_group", "_part": "_opart"})
    out = running.join(offsets, running[group].eqNullSafe(offsets["_group"]) & (running["_part"] == offsets["_opart"]))
    out = out.withColumns({f"{c}_before": F.col(f"_o_{c}") + F.col(f"_r_{c}") for c in sums})
    return out.drop("_part", "_group", "_opart", *[f"_{x}_{c}" for c in sums for x in ("o", "r")])

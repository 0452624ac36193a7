"""The six history rollups kept as states: a first load, then batches of new rows merged one by one."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import states
from ..operators.aggspec import Agg, input_columns
from ..sources import sinks
from . import features as fe, specs


@dataclass(frozen=True)
class Rollup:
    key: str
    specs: Sequence[Agg]
    order: dict = field(default_factory=dict)  # order_by, tie_break of the last K

    def state(self, rows: DataFrame) -> DataFrame:
        return states.state(rows, self.key, self.specs, k=specs.LAST_K, **self.order)

    def advance(self, old: DataFrame | None, rows: DataFrame) -> DataFrame:
        """The written state of ``old`` and ``rows``; only ``rows`` and the old state are read.

        States are bucketed by the key, so a merge shuffles the new state and never the old one.
        """
        new = self.state(rows)
        return sinks.bucketed(new if old is None else states.merge(old, new, self.key, self.specs, specs.LAST_K), self.key, "state")

    def columns(self) -> list[str]:
        """What a state reads of its rows."""
        order = [*self.order.get("order_by", ()), *self.order.get("tie_break", ())]
        return list(dict.fromkeys([self.key, *order, *input_columns(list(self.specs))]))

    def finish(self, state: DataFrame) -> DataFrame:
        return states.finish(state, self.key, self.specs)


ROLLUPS = {
    "bureau_balance": Rollup("SK_ID_BUREAU", specs.BUREAU_BALANCE),
    "bureau": Rollup("SK_ID_CURR", specs.BUREAU),
    "pos_cash": Rollup("SK_ID_PREV", specs.POS_CASH),
    "installments": Rollup("SK_ID_PREV", specs.INSTALLMENTS, {"order_by": ["DAYS_INSTALMENT"], "tie_break": fe.INSTALLMENT_TIES}),
    "credit_card": Rollup("SK_ID_PREV", specs.CREDIT_CARD, {"order_by": ["MONTHS_BALANCE"], "tie_break": fe.CARD_TIES}),
    "previous": Rollup("SK_ID_CURR", specs.PREVIOUS, {"order_by": ["DAYS_DECISION"], "tie_break": fe.PREVIOUS_TIES}),
}


def in_batches(name: str, rows: DataFrame, batches: int = 3) -> DataFrame:
    """The rollup of all ``rows``, which arrive in ``batches`` by a hash of the row.

    They are written once, each batch by itself and only what the states read, so a batch reads no rows of another.
    """
    rollup, state, spark = ROLLUPS[name], None, rows.sparkSession
    batch = F.pmod(F.xxhash64(*rows.columns), F.lit(batches)).cast("int").alias("arrives_in")
    rows = rows.select(*rollup.columns(), batch)
    with sinks.shuffles_freed(spark):
        path = sinks.write_table(rows, sinks.scratch_path(spark, "batches"), partition_by=["arrives_in"])
        written = spark.read.schema(rows.schema).parquet(path)
        for i in range(batches):
            state = rollup.advance(state, written.where(F.col("arrives_in") == i).drop("arrives_in"))
    return rollup.finish(state)

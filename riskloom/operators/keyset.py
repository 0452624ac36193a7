"""Key reduction (J1-J6): rows of a child table whose key no parent row holds go before the child is aggregated.

The parent's keys become a blocked Bloom filter: a key picks a block of 32,768 bits by one hash and
``HASHES`` bits in it by another. Blocks are built by ``bitmap_construct_agg`` (combined in the map tasks),
broadcast, and tested by the child's own scan, so a row that goes is never shuffled. A key of the parent is
never lost; some other rows stay (0.3 % at ``BITS_PER_KEY`` bits for each key), and the outer join that
follows drops them. The broadcast is bounded by ``MAX_BLOCKS`` blocks of 4 KB: with more keys than that
holds the filter grows denser and lets more rows pass, up to all of them; results stay the same.

Null keys match no parent and go. Parents without rows leave no child. Repeated parent keys count as one;
they only make the filter larger.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32768  # fixed by bitmap_construct_agg
BITS_PER_KEY = 16
HASHES = 4
MAX_BLOCKS = 16384  # 64 MB


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(blocks))


def _positions(key: str) -> list[Column]:
    h = F.xxhash64(F.col(key), F.lit(1))
    return [F.shiftrightunsigned(h, 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(HASHES)]


def key_filter(parent: DataFrame, key: str) -> tuple[DataFrame, int]:
    """``(blocks, their number)``: one row ``(_block, _bits)`` for each block that holds a key. Counts the parent's rows first."""
    keys = parent.select(key).where(F.col(key).isNotNull())
    blocks = min(MAX_BLOCKS, max(1, math.ceil(keys.count() * BITS_PER_KEY / BLOCK_BITS)))
    bits = keys.select(_block(key, blocks).alias("_block"), F.explode(F.array(*_positions(key))).alias("_at"))
    return bits.groupBy("_block").agg(F.bitmap_construct_agg("_at").alias("_bits")), blocks


def reduce_to(child: DataFrame, key: str, parent: DataFrame) -> DataFrame:
    """Rows of ``child`` whose ``key`` may occur in ``parent``; the key must have one type in both."""
    if child.schema[key].dataType != parent.schema[key].dataType:
        raise ValueError(f"{key}: {child.schema[key].dataType.simpleString()} and {parent.schema[key].dataType.simpleString()} hash differently")
    found, blocks = key_filter(parent, key)
    number, bits = _free(child, "_block"), _free(child, "_bits")
    found = found.select(F.col("_block").alias(number), F.col("_bits").alias(bits))
    rows = child.where(F.col(key).isNotNull()).withColumn(number, _block(key, blocks))
    hit = F.lit(True)
    for at in _positions(key):
        byte = F.substring(F.col(bits), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))
        hit &= F.getbit(F.conv(F.hex(byte), 16, 10).cast("bigint"), at.bitwiseAND(F.lit(7)).cast("int")) == 1
    return rows.join(F.broadcast(found), number).where(hit).select(*[F.col(f"`{c}`") for c in child.columns])


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name

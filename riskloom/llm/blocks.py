"""Documents as blocks: one row holds the texts of a few megabytes of documents.

Several operators send something small away from a block of documents and get
an answer back for the same block. For that a block must be the same each
time it is read, and the answer must meet the text again without moving the
text. So the documents are written once to the shared folder as block rows,
bucketed by block: a later join of the answers on ``block`` shuffles the
answers only.

Columns of the table: ``block`` (long, unique), ``n`` (documents in it),
``doc_ids`` (array, may hold nulls), ``sizes`` (bytes of each text), ``data``
(zstd of the concatenated UTF-8 texts; a null text is empty).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ensure_defaults
from ..sources.sinks import bucketed

BLOCK_BYTES = 4 << 20
BLOCK_DOCS = 1 << 15
SPREAD = 2
_TRIED = 1 << 16
NO_ID = np.iinfo(np.int64).max  # a null doc_id sorts behind every id

SCHEMA = "block bigint, n int, doc_ids array<bigint>, sizes array<int>, data binary"


def _pack(block_bytes: int):
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=1)
        block = TaskContext.get().partitionId() << 24
        ids, texts, size = [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()),
                    pa.array([len(ids)], pa.int32()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([[len(t) for t in texts]], pa.list_(pa.int32())),
                    pa.array([zip_.compress(b"".join(texts))], pa.binary()),
                ],
                names=["block", "n", "doc_ids", "sizes", "data"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py() or b""
                if ids and (size + len(raw) > block_bytes or len(ids) == BLOCK_DOCS):
                    yield flush()
                    block, ids, texts, size = block + 1, [], [], 0
                ids.append(doc_id)
                texts.append(raw)
                size += len(raw)
        if ids:
            yield flush()

    return pack


def write_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write ``doc_id`` and ``text`` of ``docs`` as block rows bucketed by block; read them back."""
    spark = ensure_defaults(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text")).mapInArrow(
        _pack(block_bytes), SCHEMA
    )
    return save(rows, "blocks")


def save(rows: DataFrame, stem: str) -> DataFrame:
    """Write rows with a ``block`` column bucketed by it; read them back."""
    return bucketed(rows, "block", stem, compression="none")


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_ids(task: int, buckets: int) -> Iterator[int]:
    """Numbers for a task's blocks, chosen so that ``SPREAD`` buckets hold them all: a task then writes so many files at most."""
    for start in count(0, _TRIED):
        ids = (task << 24) + start + np.arange(_TRIED, dtype=np.int64)
        bucket = _spark_hash(ids) % buckets
        yield from ids[np.isin(bucket, (task * SPREAD + np.arange(SPREAD)) % buckets)].tolist()


def _spark_hash(ids: np.ndarray) -> np.ndarray:
    """Spark's ``hash`` of a bigint, which deals rows to buckets (Murmur3, 32 bits, seed 42)."""
    turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    bits = ids.view(np.uint64)
    h = np.full(len(ids), 42, np.uint32)
    for half in (bits & np.uint64(0xFFFFFFFF), bits >> np.uint64(32)):
        h ^= turn(half.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    return h.view(np.int32)


def texts_of(sizes: list[int], data: bytes) -> list[bytes]:
    raw = memoryview(unpacked(data))
    ends = np.cumsum([0, *sizes]).tolist()
    return [bytes(raw[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def unpacked(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def ids_of(doc_ids: list[int | None]) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in doc_ids], dtype=np.int64)


def answered(blocks: DataFrame, answers: DataFrame, *columns: str) -> DataFrame:
    """Each block row with ``answers``: the structs of ``columns`` sent back to it (null if none).

    A block has at most one answer from each owner and no more owners than entries, so the list is bounded by the block.
    """
    lists = answers.groupBy("block").agg(F.collect_list(F.struct(*columns)).alias("answers"))
    return blocks.join(lists, "block", "left")


def rows_of(docs: DataFrame, digest: Column, kept: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``doc_id, digest`` of ``kept``, a written table that has the number of its ``rows``.

    ``digest`` is computed from the text, so rows are told apart by id and text. Names are safe from clashes.
    """

    def of(keys: DataFrame) -> DataFrame:
        kept_id, kept_text = (f"kept_{x}_{uuid.uuid4().hex}" for x in ("id", "text"))
        keys = keys.select(F.col("doc_id").alias(kept_id), F.col("digest").alias(kept_text))
        return docs.join(keys, docs["doc_id"].eqNullSafe(F.col(kept_id)) & (digest == F.col(kept_text)), "left_semi")

    once = of(kept.where("rows = 1"))
    again = kept.where("rows > 1")
    if again.isEmpty():
        return once
    number = f"text_{uuid.uuid4().hex}"
    return once.unionByName(of(again).withColumn(number, digest).dropDuplicates(["doc_id", number]).drop(number))

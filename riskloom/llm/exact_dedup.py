"""Exact dedup by a Golomb-coded exchange of fingerprints.

1. Documents become blocks (``blocks.write_blocks``). Each block fingerprints
   its normalised texts, and sends each owner of a fingerprint range one
   message: the block's distinct fingerprints in that range, sorted, their gaps
   Golomb-Rice coded (a few bits to spare over the entropy; no ids, no text).
2. An owner merges its messages and answers each with a bitmap: bit i is set
   if the i-th fingerprint also came from another block.
3. The bitmaps meet their blocks again (the blocks do not move). Documents whose
   bit is set, or that repeat within the block, are suspects; only their texts
   are shuffled, and grouped by the whole normalised text, so a fingerprint
   collision can never join two texts.

A text held by a third of all rows sends one fingerprint per block, and its text
is pre-aggregated to one partial row per task.

Null and empty texts are equal (both empty). A null ``doc_id`` counts as larger
than every id. Of repeated rows (same id, same text) exactly one is kept. Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.sinks import materialize
from . import blocks as bl
from .held import let_go

FP_BITS = 48  # a collision only makes a suspect more
OWNER_ENTRIES = 1 << 20
ROW_BITS = 16

_SPACES = re.compile(rb"[\t-\r][\x20\t-\r]*|\x20[\x20\t-\r]+")


def normalise(raw: bytes) -> bytes:
    """Each run of ASCII white space becomes one space."""
    return _SPACES.sub(b" ", raw)


def rice_encode(values: np.ndarray, k: int) -> tuple[bytes, bytes]:
    """Sorted distinct values as gaps: quotients in unary (a one ends each), then k low bits each."""
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    unary = np.zeros(int((gaps >> k).sum()) + len(gaps), np.uint8)
    unary[np.cumsum((gaps >> k) + 1) - 1] = 1
    low = ((gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1).astype(np.uint8)
    return np.packbits(unary).tobytes(), np.packbits(low).tobytes()


def rice_decode(n: int, k: int, unary: bytes, low: bytes) -> np.ndarray:
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    bits = np.unpackbits(np.frombuffer(low, np.uint8))[: n * k].reshape(n, k).astype(np.int64)
    gaps = ((np.diff(ones, prepend=-1) - 1) << k) + (bits << np.arange(k - 1, -1, -1)).sum(axis=1)
    return np.cumsum(gaps + 1) - 1


def _fingerprints(texts: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(t) >> (64 - FP_BITS) for t in texts), np.int64, len(texts))


def _routed(fps: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints, each one's owner, and where each owner's begin."""
    distinct = np.unique(fps)
    width = -(-(1 << FP_BITS) // owners)
    owner = distinct // width
    return distinct, owner, np.flatnonzero(np.diff(owner, prepend=-1))


def _send(owners: int):
    width = -(-(1 << FP_BITS) // owners)

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for row in batch.to_pylist():
                texts = [normalise(t) for t in bl.texts_of(row["sizes"], row["data"])]
                distinct, owner, starts = _routed(_fingerprints(texts), owners)
                out = []
                for a, b in zip(starts, [*starts[1:], len(distinct)], strict=True):
                    k = max(0, (width // int(b - a)).bit_length() - 1)
                    out.append((int(owner[a]), row["block"], int(b - a), k, *rice_encode(distinct[a:b] - owner[a] * width, k)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), _MESSAGE_TYPES, strict=True)], names=_MESSAGE_NAMES
                )

    return send


_MESSAGES = "owner bigint, block bigint, n int, k int, unary binary, low binary"
_MESSAGE_NAMES = ["owner", "block", "n", "k", "unary", "low"]
_MESSAGE_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def _answer(messages: pa.Table) -> pa.Table:
    rows = messages.to_pylist()
    values = [rice_decode(r["n"], r["k"], r["unary"], r["low"]) for r in rows]
    merged = np.concatenate(values)
    order = np.argsort(merged, kind="stable")
    same = np.diff(merged[order]) == 0
    shared = np.zeros(len(merged), np.uint8)
    shared[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    parts = np.split(shared, np.cumsum([r["n"] for r in rows])[:-1])
    return pa.table(
        {
            "block": pa.array([r["block"] for r in rows], pa.int64()),
            "owner": pa.array([r["owner"] for r in rows], pa.int64()),
            "bitmap": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary()),
        }
    )


def _suspects(owners: int):
    def suspects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for row in batch.to_pylist():
                texts = [normalise(t) for t in bl.texts_of(row["sizes"], row["data"])]
                fps = _fingerprints(texts)
                distinct, owner, starts = _routed(fps, owners)
                bitmap = {a["owner"]: a["bitmap"] for a in row["answers"]}
                shared = np.concatenate(
                    [
                        np.unpackbits(np.frombuffer(bitmap[int(owner[a])], np.uint8))[: b - a]
                        for a, b in zip(starts, [*starts[1:], len(distinct)], strict=True)
                    ]
                )
                at = np.searchsorted(distinct, fps)
                suspect = (shared.astype(bool) | (np.bincount(at, minlength=len(distinct)) > 1))[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(row["block"] << ROW_BITS) + i for i in range(len(texts))], pa.int64()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                        pa.array([t if s else None for t, s in zip(texts, suspect.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["row", "doc_id", "sha", "suspect_text"],
                )

    return suspects


def exact_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row for each row of ``docs``."""
    table = bl.write_blocks(docs)
    spark = table.sparkSession
    total = table.agg(F.sum("n")).first()[0] or 0
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // OWNER_ENTRIES))
    messages = table.select("block", "sizes", "data").mapInArrow(_send(owners), _MESSAGES)
    bitmaps = messages.groupBy("owner").applyInArrow(_answer, "block bigint, owner bigint, bitmap binary")
    rows = materialize(
        bl.answered(table, bitmaps, "owner", "bitmap").mapInArrow(
            _suspects(owners), "row bigint, doc_id bigint, sha binary, suspect_text binary"
        )
    )
    # the whole text is a grouping key: equal bytes, not equal digests, make a group
    groups = (
        rows.where("suspect_text IS NOT NULL")
        .groupBy("sha", "suspect_text")
        .agg(
            F.min("doc_id").alias("keep_id"),
            F.min_by("row", F.coalesce("doc_id", F.lit(bl.NO_ID))).alias("keep_row"),
            F.count("*").alias("group_size"),
        )
        .where("group_size > 1")
        .drop("suspect_text")
    )
    alone = F.col("keep_row").isNull()
    return rows.drop("suspect_text").join(groups, "sha", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each text: one of the smallest id. Rows are told apart by id and text, so repeated and null ids are safe."""
    by_row = materialize(
        exact_dedup(docs).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("rows")).where("kept")
    )
    normal = F.regexp_replace(F.coalesce(docs["text"].cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")
    kept = by_row.select("doc_id", F.col("text_sha256").alias("digest"), "rows")
    return bl.rows_of(docs, F.sha2(normal, 256), kept)

"""Substring dedup by content-defined chunking.

A gear hash (shift left by one, add the byte's number) rolls over each text;
16 bits of it, so it sees the last 16 bytes. A chunk ends where the hash is the
largest within ``REACH`` bytes to either side, so edges depend on the text around
them only: an insertion moves the chunks it touches and no others. Chunks have
``REACH`` + 1 bytes at least (but for texts shorter than that) and ``MAX_CHUNK`` at
most, about 49 on average.

A chunk is a duplicate if a document with a smaller id has a chunk with the same
128-bit digest. Neighbouring duplicates form spans; spans of ``MIN_SPAN`` bytes or
more are removed.

Documents stay in their blocks (see ``blocks``). A block sends each owner of a
digest range its distinct digests with the smallest id of each, and gets back the
smallest id of all, so a passage that very many documents share is one entry for
each block.

A null text is empty. Texts shorter than a chunk, and empty ones, lose nothing. A
null ``doc_id`` counts as larger than every id; rows with the same id do not
remove from each other. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import blocks as bl

REACH = 24
WINDOW = 16
MAX_CHUNK = 1024
MIN_SPAN = 64
OWNER_BYTES = 1 << 24  # of text for each owner

_GEAR = np.random.Generator(np.random.PCG64(16)).integers(0, 1 << 16, 256, dtype=np.uint16)  # any numbers will do
_GAP = REACH + WINDOW  # between texts, so that none sees its neighbour


def gear(buf: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte (as if zero bytes came before the first)."""
    h, n = _GEAR[buf], 1
    while n < WINDOW:
        h[n:] = h[n:] + (h[:-n] << np.uint16(n))
        n *= 2
    return h


def _largest(h: np.ndarray, reach: int) -> np.ndarray:
    """The largest of the ``reach`` values from each position on."""
    n = 1
    while 2 * n <= reach:
        h, n = np.maximum(h[:-n], h[n:]), 2 * n
    return np.maximum(h[: len(h) - (reach - n)], h[reach - n :]) if n < reach else h


def chunk_edges(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of each chunk, in order; starts and ends count from the document's start."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + _GAP) - sizes
    buf = np.zeros(int(sizes.sum()) + _GAP * (len(texts) + 1), np.uint8)
    inside = np.zeros(len(buf), bool)
    for a, t in zip(starts.tolist(), texts, strict=True):
        buf[a : a + len(t)] = np.frombuffer(t, np.uint8)
        inside[a : a + len(t)] = True
    h = np.where(inside, gear(buf), np.uint16(0))
    ahead = _largest(h, REACH)
    edge = np.zeros(len(buf), bool)
    here = slice(REACH, len(ahead) - 1)
    edge[here] = (h[here] > ahead[: len(ahead) - 1 - REACH]) & (h[here] >= ahead[REACH + 1 :])
    cuts = np.flatnonzero(edge) + 1
    doc = np.searchsorted(starts, cuts, side="right") - 1
    ok = (doc >= 0) & (cuts - starts[doc] > REACH) & (starts[doc] + sizes[doc] - cuts > REACH)
    used = np.flatnonzero(sizes)
    at = np.concatenate([starts[used], cuts[ok]])
    of = np.concatenate([used, doc[ok]])
    order = np.argsort(at, kind="stable")
    at, of = at[order], of[order]
    ends = starts[of] + sizes[of]
    ends[:-1] = np.where(of[1:] == of[:-1], at[1:], ends[:-1])
    parts = -(-(ends - at) // MAX_CHUNK)  # long chunks in pieces, counted from their start
    first = np.repeat(np.cumsum(parts) - parts, parts)
    a = np.repeat(at, parts) + MAX_CHUNK * (np.arange(len(first)) - first)
    of, ends = np.repeat(of, parts), np.minimum(a + MAX_CHUNK, np.repeat(ends, parts))
    return of, a - starts[of], ends - starts[of]


class Chunks:
    """A block's chunks that count (those longer than ``REACH``), and its distinct digests in order."""

    def __init__(self, texts: list[bytes]):
        import xxhash

        digest = xxhash.xxh3_128_digest
        self.doc, self.start, self.end = chunk_edges(texts)
        self.counts = np.bincount(self.doc, minlength=len(texts))
        keep = self.end - self.start > REACH
        self.doc, self.start, self.end = self.doc[keep], self.start[keep], self.end[keep]
        raw = b"".join([digest(texts[d][a:b]) for d, a, b in zip(self.doc.tolist(), self.start.tolist(), self.end.tolist(), strict=True)])
        words = np.frombuffer(raw, ">u8").reshape(-1, 2).astype(np.uint64)
        order = np.lexsort((words[:, 1], words[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (words[order][1:] != words[order][:-1]).any(axis=1)
        self.entry = np.empty(len(order), np.int64)  # of each chunk
        self.entry[order] = np.cumsum(new) - 1
        self.digests = words[order][new]

    def least(self, ids: np.ndarray) -> np.ndarray:
        out = np.full(len(self.digests), bl.NO_ID)
        np.minimum.at(out, self.entry, ids[self.doc])
        return out

    def by_owner(self, owners: int) -> Iterator[tuple[int, int, int]]:
        width = np.uint64(-(-(1 << 64) // owners))
        owner = (self.digests[:, 0] // width).astype(np.int64)
        heads = np.flatnonzero(np.diff(owner, prepend=-1)).tolist()
        yield from zip(owner[heads].tolist(), heads, [*heads[1:], len(owner)][: len(heads)], strict=True)


def _zipped(array: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(array.tobytes())


def _send(owners: int):
    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunks = Chunks(bl.texts_of(row["sizes"], row["data"]))
                least = chunks.least(bl.ids_of(row["doc_ids"]))
                out = [
                    {"owner": o, "block": row["block"], "digests": chunks.digests[a:b].tobytes(), "least": _zipped(least[a:b])}
                    for o, a, b in chunks.by_owner(owners)
                ]
                yield pa.RecordBatch.from_pylist(out, _SENT)

    return send


_SENT = pa.schema([("owner", pa.int64()), ("block", pa.int64()), ("digests", pa.binary()), ("least", pa.binary())])


def _answer(sent: pa.Table) -> pa.Table:
    rows = sent.to_pylist()
    digests = [np.frombuffer(r["digests"], np.uint64).reshape(-1, 2) for r in rows]
    words = np.concatenate(digests)
    ids = np.concatenate([np.frombuffer(bl.unpacked(r["least"]), np.int64) for r in rows])
    order = np.lexsort((words[:, 1], words[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (words[order][1:] != words[order][:-1]).any(axis=1)
    heads = np.flatnonzero(new)
    least = np.empty(len(ids), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(ids[order], heads), np.diff(np.append(heads, len(ids))))
    cuts = np.cumsum([0, *map(len, digests)]).tolist()
    out = [
        {"block": r["block"], "owner": r["owner"], "lower": _zipped(ids[a:b] - least[a:b])}  # mostly zeros
        for r, a, b in zip(rows, cuts, cuts[1:], strict=False)
    ]
    return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("owner", pa.int64()), ("lower", pa.binary())]))


_SPANS = "spans array<struct<start:bigint,end:bigint>>"
_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_chunks", pa.int64()),
        ("n_dup_chunks", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("first_doc_ids", pa.list_(pa.int64())),
        ("kept", pa.binary()),
    ]
)


def _finish(owners: int, with_text: bool):
    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                texts = bl.texts_of(row["sizes"], row["data"])
                ids = bl.ids_of(row["doc_ids"])
                chunks = Chunks(texts)
                least = chunks.least(ids)
                lower = {a["owner"]: a["lower"] for a in row["answers"] or []}
                for owner, a, b in chunks.by_owner(owners):
                    least[a:b] -= np.frombuffer(bl.unpacked(lower[owner]), np.int64)
                dup = least[chunks.entry] < ids[chunks.doc]
                spans, firsts, n_dup = _spans(chunks, dup, least, len(texts))
                out = []
                for i, (doc_id, text) in enumerate(zip(row["doc_ids"], texts, strict=True)):
                    own = spans.get(i, [])
                    kept = b"".join(text[a:b] for a, b in zip([0, *[e for _, e in own]], [*[s for s, _ in own], len(text)], strict=True))
                    out.append(
                        {
                            "doc_id": doc_id,
                            "n_bytes": len(text),
                            "n_chunks": int(chunks.counts[i]),
                            "n_dup_chunks": n_dup.get(i, 0),
                            "spans": [{"start": a, "end": b} for a, b in own],
                            "first_doc_ids": sorted(firsts.get(i, ())),
                            "kept": kept if with_text else None,
                        }
                    )
                yield pa.RecordBatch.from_pylist(out, _RESULT)

    return finish


def _spans(chunks: Chunks, dup: np.ndarray, least: np.ndarray, n: int):
    """By document: spans of neighbouring duplicates that are long enough, the ids they came from, duplicate chunks."""
    spans: dict[int, list[tuple[int, int]]] = {}
    firsts: dict[int, set[int]] = {}
    at = np.flatnonzero(dup)
    if not len(at):
        return spans, firsts, {}
    doc, start, end, source = chunks.doc[at], chunks.start[at], chunks.end[at], least[chunks.entry[at]]
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != end[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(at)) - 1
    for a, b in zip(heads.tolist(), tails.tolist(), strict=True):
        if end[b] - start[a] >= MIN_SPAN:
            spans.setdefault(int(doc[a]), []).append((int(start[a]), int(end[b])))
            firsts.setdefault(int(doc[a]), set()).update(source[a : b + 1].tolist())
    counts = np.bincount(doc, minlength=n)
    return spans, firsts, {i: int(counts[i]) for i in np.flatnonzero(counts).tolist()}


def chunk_dedup(docs: DataFrame, with_text: bool = True, block_bytes: int = bl.BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_bytes, n_chunks, n_dup_chunks``, the ``spans`` removed (bytes), the
    ids of the first documents with their chunks, and ``kept``, the bytes left (null unless ``with_text``)."""
    table = bl.write_blocks(docs, block_bytes)
    spark = table.sparkSession
    total = table.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // OWNER_BYTES))
    sent = table.select("block", "doc_ids", "sizes", "data").mapInArrow(
        _send(owners), "owner bigint, block bigint, digests binary, least binary"
    )
    answers = sent.groupBy("owner").applyInArrow(_answer, "block bigint, owner bigint, lower binary")
    return bl.answered(table, answers, "owner", "lower").mapInArrow(
        _finish(owners, with_text),
        f"doc_id bigint, n_bytes bigint, n_chunks bigint, n_dup_chunks bigint, {_SPANS}, first_doc_ids array<bigint>, kept binary",
    )

"""Dedup of repeated byte strings by a depth-limited radix sort of suffixes.

A byte is removed if a string of ``DEPTH`` bytes over it also starts in a document
with a smaller id. Suffixes need ordering only through their first ``DEPTH``
bytes; groups that are equal that deep are the repeated windows. Shipping every
suffix would multiply the corpus, so the first digit is taken at an anchor.

1. Anchors. Of the 16-byte grams in a window the one with the least hash is its
   anchor; equal windows have equal anchors. Neighbouring windows mostly share
   one, so a document becomes runs of windows, one anchor in about 18 bytes.
2. First pass, most significant digit = the anchor's gram. Each block sends each
   owner of a hash range its distinct anchors (sorted, Golomb-Rice coded) and
   gets back which ones another block has too. Anchors of one document only
   are out: none of their windows is repeated.
3. Runs left over (anchor in two documents at least) go to the owner of their
   anchor: the run's bytes, once per block however often it occurs, with the
   smallest id there. The owner joins equal runs, then sorts the windows of the
   distinct runs eight bytes a pass, most significant first; groups of one leave
   the sort after each pass. Groups left at full depth are equal byte for
   byte; their smallest id goes back to the blocks.
4. Each block compares that id with its documents' and cuts.

An anchor with very many runs (a common phrase) is not sent to one owner: its
runs are sent as single windows, each to an owner of its own bytes, and a window
is sent once per block. So no owner's part grows with one passage or phrase.
Texts stay in their blocks throughout (see ``blocks``).

A null text is empty; texts shorter than ``DEPTH`` bytes lose nothing. A null
``doc_id`` counts as larger than every id; rows with the same id do not
remove from each other. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import blocks as bl
from .exact_dedup import FP_BITS, rice_decode, rice_encode

DEPTH = 50
GRAM = 16
OWNER_BYTES = 1 << 24  # of text for each owner
HOT_RUNS = 1 << 16
_AT_ONCE = 1 << 18  # windows looked at together
_DIGIT = 8

# any odd multipliers and any table will do; they are made from a fixed seed
_RANDOM = np.random.Generator(np.random.PCG64(50))
_BYTE_HASH = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64)
_STEPS = _RANDOM.integers(0, 1 << 62, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each position."""
    h, n = _BYTE_HASH[buf], 1
    for step in _STEPS:
        h = h[:-n] * step + h[n:]
        n *= 2
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ h >> np.uint64(29)


def anchors(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window the position of its anchor (the first of equals), and all gram hashes."""
    h = gram_hashes(buf)
    key = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    width, n = DEPTH - GRAM + 1, 1
    while 2 * n <= width:
        key, n = np.minimum(key[:-n], key[n:]), 2 * n
    if n < width:
        key = np.minimum(key[: len(key) - (width - n)], key[width - n :])
    return (key & np.uint64((1 << 24) - 1)).astype(np.int64), h


class Runs:
    """The runs of a block: first window, number of windows, document and anchor hash of each."""

    def __init__(self, buf: np.ndarray, sizes: list[int]):
        ends = np.cumsum(sizes, dtype=np.int64)
        starts = ends - np.asarray(sizes, np.int64)
        whole = np.ones(len(buf) + 1, bool)
        whole[len(buf)] = False
        for a, b in zip(np.maximum(starts, ends - DEPTH + 1).tolist(), ends.tolist(), strict=True):
            whole[a:b] = False
        first, count, hashes = [], [], []
        for a in range(0, len(buf) - DEPTH + 1, _AT_ONCE):
            b = min(a + _AT_ONCE, len(buf) - DEPTH + 1)
            at, h = anchors(buf[a : b + DEPTH - 1])
            ok = whole[a:b]
            new = np.diff(at, prepend=-1) != 0
            new[1:] |= ~ok[:-1]
            new = np.flatnonzero(new & ok)
            # a run ends before the next one or before a window that leaves its document
            stop = np.append(np.flatnonzero(~ok), b - a)
            until = np.minimum(np.append(new[1:], b - a), stop[np.searchsorted(stop, new)])
            first.append(new + a)
            count.append(until - new)
            hashes.append(h[at[new]])
        self.first = np.concatenate(first) if first else np.zeros(0, np.int64)
        self.count = np.concatenate(count) if count else np.zeros(0, np.int64)
        fps = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.fp = (fps >> np.uint64(64 - FP_BITS)).astype(np.int64)
        self.doc = np.searchsorted(starts, self.first, side="right") - 1
        self.order = np.argsort(self.fp, kind="stable")
        self.heads = np.flatnonzero(np.diff(self.fp[self.order], prepend=-1))  # the first of each anchor, in that order
        self.distinct = self.fp[self.order][self.heads]

    def per_anchor(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each distinct anchor is in documents of different ids, and its number of runs."""
        if not len(self.heads):
            return np.zeros(0, bool), np.zeros(0, np.int64)
        own = ids[self.doc[self.order]]
        several = np.minimum.reduceat(own, self.heads) != np.maximum.reduceat(own, self.heads)
        return several, np.diff(np.append(self.heads, len(own)))


def _cut(sorted_values: np.ndarray, owners: int) -> Iterator[tuple[int, int, int]]:
    width = -(-(1 << FP_BITS) // owners)
    owner = sorted_values // width
    heads = np.flatnonzero(np.diff(owner, prepend=-1))
    if len(owner):
        yield from zip(owner[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(owner)], strict=True)


def _zip(*arrays: np.ndarray | bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(a if isinstance(a, bytes) else a.tobytes() for a in arrays))


def _unzip(data: bytes, *parts: tuple[int, str]) -> list[np.ndarray]:
    raw, at, out = bl.unpacked(data), 0, []
    for n, kind in parts:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


# --- first pass: which anchors are in several blocks
_ASK = "owner bigint, block bigint, n int, k int, unary binary, low binary, counts binary"
_ASK_NAMES = ["owner", "block", "n", "k", "unary", "low", "counts"]
_ASK_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _ask(owners: int):
    width = -(-(1 << FP_BITS) // owners)

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                runs = Runs(np.frombuffer(bl.unpacked(row["data"]), np.uint8), row["sizes"])
                _, counts = runs.per_anchor(bl.ids_of(row["doc_ids"]))
                out = []
                for owner, a, b in _cut(runs.distinct, owners):
                    k = max(0, (width // (b - a)).bit_length() - 1)
                    unary, low = rice_encode(runs.distinct[a:b] - owner * width, k)
                    out.append((owner, row["block"], b - a, k, unary, low, _zip(counts[a:b].astype(np.uint32))))
                yield _batch(out, _ASK_NAMES, _ASK_TYPES)

    return ask


def _tell(asked: pa.Table) -> pa.Table:
    rows = asked.to_pylist()
    merged = np.concatenate([rice_decode(r["n"], r["k"], r["unary"], r["low"]) for r in rows])
    counts = np.concatenate([_unzip(r["counts"], (r["n"], "u4"))[0] for r in rows]).astype(np.int64)
    order = np.argsort(merged, kind="stable")
    heads = np.flatnonzero(np.diff(merged[order], prepend=-1))
    size = np.diff(np.append(heads, len(order)))
    shared, hot = np.zeros(len(order), np.uint8), np.zeros(len(order), np.uint8)
    shared[order] = np.repeat(size > 1, size)
    hot[order] = np.repeat(np.add.reduceat(counts[order], heads) > HOT_RUNS, size)
    at = np.cumsum([0, *[r["n"] for r in rows]])
    packed = lambda bits, i: np.packbits(bits[at[i] : at[i + 1]]).tobytes()
    out = [(r["block"], r["owner"], packed(shared, i), packed(hot, i)) for i, r in enumerate(rows)]
    return pa.Table.from_batches(
        [_batch(out, ["block", "owner", "shared", "hot"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])]
    )


# --- second pass: the windows of the runs that are left
_SEND = "owner bigint, block bigint, n int, size int, data binary"
_SEND_NAMES = ["owner", "block", "n", "size", "data"]
_SEND_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def gather(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the pieces one after the other, and the offsets of their ends (from 0)."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lengths)
    return buf[at], ends


def binary_array(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]
    )


def distinct_runs(data: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of each run among the distinct ones, the first run of each code, and the smallest id of each."""
    code = binary_array(data, ends).dictionary_encode().indices.to_numpy()
    order = np.lexsort((ids, code))
    heads = np.flatnonzero(np.diff(code[order], prepend=-1))
    return code, np.sort(np.unique(code, return_index=True)[1]), ids[order][heads]


def _send(owners: int):
    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for row in batch.to_pylist():
                buf = np.frombuffer(bl.unpacked(row["data"]), np.uint8)
                ids = bl.ids_of(row["doc_ids"])
                runs = Runs(buf, row["sizes"])
                several, counts = runs.per_anchor(ids)
                told = {a["owner"]: a for a in row["answers"] or []}
                parts = list(_cut(runs.distinct, owners))
                bits = lambda name: np.concatenate(
                    [np.zeros(0, np.uint8), *[np.unpackbits(np.frombuffer(told[o][name], np.uint8))[: b - a] for o, a, b in parts]]
                ).astype(bool)
                live, hot = (several | bits("shared"))[:], bits("hot")
                of_run = np.empty(len(runs.fp), np.int64)
                of_run[runs.order] = np.repeat(np.arange(len(counts)), counts)
                cold = np.flatnonzero(live[of_run] & ~hot[of_run])
                warm = np.flatnonzero(live[of_run] & hot[of_run])
                n = runs.count[warm]  # single windows of the anchors with very many runs
                single = np.arange(n.sum()) + np.repeat(runs.first[warm] - np.concatenate([[0], np.cumsum(n)[:-1]])[: len(n)], n)
                first = np.concatenate([runs.first[cold], single])
                count = np.concatenate([runs.count[cold], np.ones(len(single), np.int64)])
                doc = np.concatenate([runs.doc[cold], np.repeat(runs.doc[warm], n)])
                if not len(first):
                    continue
                data, ends = gather(buf, first, count + DEPTH - 1)
                code, head, least = distinct_runs(data, ends, ids[doc])
                owner = np.concatenate([runs.fp[cold], np.zeros(len(single), np.int64)])[head] % owners
                for i in np.flatnonzero(head >= len(cold)).tolist():
                    owner[i] = xxhash.xxh3_64_intdigest(data[ends[head[i]] : ends[head[i] + 1]]) % owners
                order = np.argsort(owner, kind="stable")  # the entries as sent: by owner, then by code
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                cuts = np.flatnonzero(np.diff(owner[order], prepend=-1))
                out = []
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
                    mine = order[a:b]
                    runs_of = head[mine]
                    text, _ = gather(data, ends[runs_of], ends[runs_of + 1] - ends[runs_of])
                    sent = _zip(least[mine], count[runs_of].astype(np.uint8), text)
                    out.append((int(owner[order[a]]), row["block"], b - a, len(text), sent))
                # what the block must know when the answers come: its own message to itself, past all owners
                state = _zip(first.astype(np.int64), doc.astype(np.int32), place[code].astype(np.int32))
                out.append((-1 - row["block"], row["block"], len(first), 0, state))
                yield _batch(out, _SEND_NAMES, _SEND_TYPES)

    return send


def least_ids(data: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For windows at ``starts`` of ``data``: the smallest id of the windows equal to each (radix passes over ``DEPTH`` bytes)."""
    padded = np.concatenate([data, np.zeros(2 * _DIGIT, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, _DIGIT)
    out, active = ids.copy(), np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    for depth in range(0, DEPTH, _DIGIT):
        digit = words[starts[active] + depth].copy().view(">u8").ravel().astype(np.uint64)
        if depth + _DIGIT > DEPTH:
            digit >>= np.uint64(8 * (depth + _DIGIT - DEPTH))
        order = np.lexsort((digit, group))
        active, group, digit = active[order], group[order], digit[order]
        new = np.ones(len(active), bool)
        new[1:] = (np.diff(group) != 0) | (digit[1:] != digit[:-1])
        group = np.cumsum(new) - 1
        kept = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
        active, group = active[kept], group[kept]
    if len(active):
        heads = np.flatnonzero(np.diff(group, prepend=-1))
        sizes = np.diff(np.append(heads, len(active)))
        out[active] = np.repeat(np.minimum.reduceat(ids[active], heads), sizes)
    return out


_ANSWER = "block bigint, owner bigint, n int, n_parts int, data binary"


def _answer(sent: pa.Table) -> pa.Table:
    names, types = ["block", "owner", "n", "n_parts", "data"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    rows = sent.to_pylist()
    if rows[0]["owner"] < 0:
        return pa.Table.from_batches([_batch([(r["block"], -1, r["n"], 0, r["data"]) for r in rows], names, types)])
    least, count, text = (
        np.concatenate(c)
        for c in zip(*[_unzip(r["data"], (r["n"], "i8"), (r["n"], "u1"), (r["size"], "u1")) for r in rows], strict=True)
    )
    count = count.astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(count + DEPTH - 1)])
    code, head, ids = distinct_runs(text, ends, least)
    n = count[head]
    before = np.concatenate([[0], np.cumsum(n)])
    run = np.repeat(np.arange(len(head)), n)
    starts = ends[head][run] + np.arange(before[-1]) - before[run]
    found = least_ids(text, starts, ids[run])
    # each distinct run as parts of neighbouring windows with the same id
    new = np.flatnonzero((np.diff(found, prepend=-1) != 0) | (np.diff(run, prepend=-1) != 0))
    part_n, part_id = np.diff(np.append(new, len(found))), found[new]
    parts = np.bincount(run[new], minlength=len(head))
    first_part = np.concatenate([[0], np.cumsum(parts)[:-1]])
    out, at = [], 0
    for r in rows:
        own = code[at : at + r["n"]]
        at += r["n"]
        (of, _) = gather(np.arange(len(new)), first_part[own], parts[own])
        data = _zip(parts[own].astype(np.uint8), part_n[of].astype(np.uint8), part_id[of])
        out.append((r["block"], r["owner"], r["n"], len(of), data))
    return pa.Table.from_batches([_batch(out, names, types)])


def _removed(size: int, ids: np.ndarray, answers: list[dict]) -> np.ndarray:
    """Which bytes of a block go."""
    state = next((a for a in answers if a["owner"] < 0), None)
    if state is None:
        return np.zeros(size, bool)
    first, doc, entry = _unzip(state["data"], (state["n"], "i8"), (state["n"], "i4"), (state["n"], "i4"))
    told = sorted((a for a in answers if a["owner"] >= 0), key=lambda a: a["owner"])
    parts, part_n, part_id = (
        np.concatenate(c)
        for c in zip(*[_unzip(a["data"], (a["n"], "u1"), (a["n_parts"], "u1"), (a["n_parts"], "i8")) for a in told], strict=True)
    )
    parts, part_n = parts.astype(np.int64), part_n.astype(np.int64)
    first_part = np.concatenate([[0], np.cumsum(parts)[:-1]])
    of, ends = gather(np.arange(len(part_n)), first_part[entry], parts[entry])
    run = np.repeat(np.arange(len(entry)), parts[entry])
    begun = np.concatenate([[0], np.cumsum(part_n[of])])[:-1]
    start = first[run] + begun - begun[ends[:-1]][run]  # the part's first window
    go = part_id[of] < ids[doc[run]]
    start, stop = start[go], start[go] + part_n[of][go] + DEPTH - 1
    change = np.bincount(start, minlength=size + 1) - np.bincount(stop, minlength=size + 1)
    return np.cumsum(change[:size]) > 0


_RESULT = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
_RESULT_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]


def _finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            raw = bl.unpacked(row["data"])
            buf = np.frombuffer(raw, np.uint8)
            gone = _removed(len(buf), bl.ids_of(row["doc_ids"]), row["answers"] or [])
            out, at = [], 0
            for doc_id, n in zip(row["doc_ids"], row["sizes"], strict=True):
                mine = gone[at : at + n]
                if mine.any():
                    edges = np.flatnonzero(np.diff(mine, prepend=False, append=False)).tolist()
                    spans = [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                    out.append((doc_id, n, spans, buf[at : at + n][~mine].tobytes()))
                else:
                    out.append((doc_id, n, [], raw[at : at + n]))
                at += n
            yield _batch(out, ["doc_id", "n_bytes", "spans", "kept"], _RESULT_TYPES)


def suffix_dedup(docs: DataFrame, block_bytes: int = bl.BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_bytes, spans`` (bytes removed, as maximal spans) and ``kept`` (the bytes left) of each row of ``docs``."""
    table = bl.write_blocks(docs, block_bytes)
    spark = table.sparkSession
    total = table.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // OWNER_BYTES))
    asked = table.select("block", "doc_ids", "sizes", "data").mapInArrow(_ask(owners), _ASK)
    told = asked.groupBy("owner").applyInArrow(_tell, "block bigint, owner bigint, shared binary, hot binary")
    sent = bl.answered(table, told, "owner", "shared", "hot").mapInArrow(_send(owners), _SEND)
    answers = sent.groupBy("owner").applyInArrow(_answer, _ANSWER)
    return bl.answered(table, answers, "owner", "n", "n_parts", "data").mapInArrow(_finish, _RESULT)

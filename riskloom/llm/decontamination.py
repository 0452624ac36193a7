"""Benchmark decontamination: one Aho-Corasick automaton over the items' word windows.

An item's words are cut into windows of ``WINDOW`` consecutive words (an item of fewer words is one
window). All windows go into one automaton whose letters are word numbers, so it has ten nodes for each word of the
benchmark however long the words are. A document's words are looked up and run through the automaton once; the
matches, found as word places, are mapped back to code points of the original text by its byte offsets,
which normalising keeps.

Words: A-Z lower-cased, ASCII letters and digits and everything beyond ASCII; the rest separates.

The benchmark is sent to the workers behind a check of its size: up to ``AUTOMATON_BYTES`` of text make one
automaton. A larger one is dealt by hash into several of that size on average; the documents are then written once as
blocks, each automaton scans them, and only the matches are grouped by block to meet the texts again.

Null and empty texts have no words: such documents hit nothing, such items have no window. Repeated rows of documents
give repeated rows. Rows of ``benchmark`` with one ``item_id`` are one item; a null ``item_id`` is an item whose id is
written as an empty string. Either table may be empty. Other columns are ignored. A very long text is run through in
parts that overlap by the longest window less one word, so no match is lost and memory holds one part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ensure_defaults
from . import blocks as bl

WINDOW = 10
AUTOMATON_BYTES = 4 << 20  # about 7 million nodes
PART_BYTES = 1 << 20

#: bytes of words as they are (A-Z lower-cased), all others to a space; bytes beyond ASCII always belong to words
_NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)

SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = "block bigint, place int, runs array<struct<start:bigint,end:bigint>>, items array<string>"


def _parts(text: bytes, size: int) -> Iterator[bytes]:
    start = 0
    while len(text) - start > size and (cut := text.find(b" ", start + size)) >= 0:
        yield text[start:cut]
        start = cut
    yield text[start:]


class Windows:
    """The automaton of some items: ``(item_id, text)`` pairs with UTF-8 texts."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int = WINDOW):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        self.items_of: list[set[str]] = []
        self.lengths: list[int] = []
        known: dict[tuple[int, ...], int] = {}
        for item_id, text in items:
            words = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in text.translate(_NORMAL).split())
            for start in range(max(1, len(words) - window + 1) if words else 0):
                key = words[start : start + window]
                at = known.setdefault(key, len(known))
                if at == len(self.items_of):
                    self.items_of.append(set())
                    self.lengths.append(len(key))
                self.items_of[at].add(item_id)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for key, at in known.items():
            self.automaton.add_word(key, at)
        if known:
            self.automaton.make_automaton()
        self.longest = max(self.lengths, default=0)
        self.widths = np.array(self.lengths, np.int64)

    def matches(self, text: bytes, part_bytes: int = PART_BYTES) -> tuple[int, list[int], list[int]]:
        """Number of words, and of each match the number of its last word and of its window."""
        n, tail, ends, windows = 0, (), [], []
        number, none = self.numbers.get, repeat(0)
        for part in _parts(text.translate(_NORMAL), part_bytes):
            words = part.split()
            if self.longest:
                seen = len(tail)
                line = tail + tuple(map(number, words, none))
                for end, window in self.automaton.iter(line):
                    if end >= seen:
                        ends.append(n - seen + end)
                        windows.append(window)
                tail = line[len(line) - min(len(line), self.longest - 1) :]
            n += len(words)
        return n, ends, windows

    def runs(self, ends: list[int], windows: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """The hit words as maximal runs, and the items whose windows occur."""
        last = np.array(ends, np.int64)
        first = last + 1 - self.widths[windows]
        items = set().union(*(self.items_of[w] for w in set(windows)))
        return merged(zip(first.tolist(), (last + 1).tolist(), strict=True)), items


def merged(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def code_points(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as places in the original text, from the first word's start to the last one's end."""
    inside = np.frombuffer(text.translate(_NORMAL), np.uint8) != 0x20
    edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    begun = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80  # a byte that begins a code point
    place = np.concatenate([[0], np.cumsum(begun)])
    return [(int(place[starts[a]]), int(place[ends[b - 1]])) for a, b in runs]


_BUILT: dict[str, Windows] = {}  # of this Python worker


def _windows(sent) -> Windows:
    key, items = sent
    if key not in _BUILT:
        _BUILT.clear()  # one automaton at a time
        _BUILT[key] = Windows(items.value)
    return _BUILT[key]


def _documents(rows: Iterable[tuple[int | None, bytes, int, list[tuple[int, int]], set[str]]]) -> pa.RecordBatch:
    ids, n_words, n_hit, items, spans = [], [], [], [], []
    for doc_id, text, n, runs, found in rows:
        ids.append(doc_id)
        n_words.append(n)
        n_hit.append(sum(b - a for a, b in runs))
        items.append(sorted(found))
        spans.append([{"start": a, "end": b} for a, b in code_points(text, runs)] if runs else [])
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
         pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPANS)],
        names=["doc_id", "n_words", "n_hit", "items", "spans"],
    )


def _scan(sent):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(sent)
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py() or b""
                n, ends, hits = windows.matches(text)
                rows.append((doc_id, text, n, *(windows.runs(ends, hits) if hits else ([], set()))))
            yield _documents(rows)

    return scan


def _scan_blocks(sent):
    """Only the documents that are hit, as runs of words."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(sent)
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                for place, text in enumerate(bl.texts_of(row["sizes"], row["data"])):
                    _, ends, hits = windows.matches(text)
                    if hits:
                        runs, items = windows.runs(ends, hits)
                        out.append((row["block"], place, [{"start": a, "end": b} for a, b in runs], sorted(items)))
                columns = list(zip(*out, strict=True)) or [[]] * 4
                kinds = [pa.int64(), pa.int32(), _SPANS, pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["block", "place", "runs", "items"]
                )

    return scan


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with what all automata found in them."""
    for batch in batches:
        for row in batch.to_pylist():
            runs: dict[int, list] = {}
            items: dict[int, set[str]] = {}
            for a in row["answers"] or []:
                runs.setdefault(a["place"], []).extend((r["start"], r["end"]) for r in a["runs"])
                items.setdefault(a["place"], set()).update(a["items"])
            yield _documents(
                (doc_id, text, sum(len(p.split()) for p in _parts(text.translate(_NORMAL), PART_BYTES)),
                 merged(runs.get(i, [])), items.get(i, set()))
                for i, (doc_id, text) in enumerate(zip(row["doc_ids"], bl.texts_of(row["sizes"], row["data"]), strict=True))
            )


def decontaminate(docs: DataFrame, benchmark: DataFrame, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, items, spans`` of each row of ``docs``: the words inside windows of ``benchmark``,
    the ids of the items whose windows occur, sorted, and the runs of hit words in code points of the text."""
    spark = ensure_defaults(docs.sparkSession)
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    automata = max(1, -(-total // automaton_bytes))
    dealt = items.withColumn("dealt", F.pmod(F.xxhash64("item_id", "text"), F.lit(automata)))

    def sent(number: int):
        # one automaton's share of the benchmark: bounded by the count of automata
        share = [(r.item_id, bytes(r.text)) for r in dealt.where(F.col("dealt") == number).collect()]
        return uuid.uuid4().hex, spark.sparkContext.broadcast(share)

    if automata == 1:
        texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"))
        return texts.mapInArrow(_scan(sent(0)), SCHEMA)
    table = bl.write_blocks(docs)
    found = None
    for number in range(automata):
        part = table.select("block", "sizes", "data").mapInArrow(_scan_blocks(sent(number)), _FOUND)
        found = part if found is None else found.unionByName(part)
    return bl.answered(table, found, "place", "runs", "items").mapInArrow(_joined, SCHEMA)

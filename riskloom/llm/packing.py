"""Packing by the online sum-of-squares rule.

A document's ids (its text's, then one end id) are cut into full windows and a
rest. Each rest goes, as it comes, to the fill level that makes the sum over all
levels of the squared number of partially filled windows at that level smallest;
the counts are one array over the levels 1 .. size-1, and level 0 stands for a
new window. Equal sums go to the fullest window.

Every task packs the documents of its partition, so nothing is shuffled and a
task holds its open windows only. At the end of a partition, or when more
than ``max_open`` windows are open, the windows left open are poured together:
the emptiest are cut to fill the gaps of the fullest, which leaves at most one
that is not full. The last one of a partition is cut at powers of two, which need
no padding.

Null and empty texts are one end id. Repeated rows are packed once each; an
empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .byte_bpe import to_characters
from .chunk_ids import ChunkIds, portions
from .held import held

SIZE = 1024
CACHED = 600_000  # a new word costs a call of the tokenizer; about 200 MB in a worker
MAX_OPEN = 4096
END_ID = 0

SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"

Piece = tuple[int | None, int, bytes, int]  # document, start there, ids, the document's ids in all


class SumOfSquares:
    """Windows of ``size`` ids; ``closed`` gets each finished window's pieces."""

    def __init__(self, size: int = SIZE, max_open: int = MAX_OPEN):
        self.size, self.max_open = size, max_open
        self.count = np.zeros(size + 1, np.int64)  # open windows at each level
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = 0
        self.closed: list[list[Piece]] = []

    def level_for(self, n: int) -> int:
        """The level whose window takes ``n`` more ids at the smallest sum of squares."""
        c = self.count
        after = 2 * c[n:] + 1  # one more window at level + n
        after[-1] = 0  # or a full one, which no longer counts
        change = after[: self.size - n + 1].copy()
        change[1:] -= 2 * c[1 : len(change)] - 1  # one less at the level itself
        change[1:][c[1 : len(change)] == 0] = np.iinfo(np.int64).max
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def add(self, piece: Piece) -> None:
        n = len(piece[2]) // 4
        if n == self.size:
            self.closed.append([piece])
            return
        level = self.level_for(n)
        window = []
        if level:
            window = self.open[level].pop()
            self.count[level] -= 1
            self.n_open -= 1
        window.append(piece)
        if level + n == self.size:
            self.closed.append(window)
        else:
            self.open.setdefault(level + n, []).append(window)
            self.count[level + n] += 1
            self.n_open += 1
            if self.n_open > self.max_open:
                self.pour()

    def pour(self) -> None:
        """Fill the fullest open windows from the emptiest, cutting pieces; at most one stays open."""
        windows = [(level, w) for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open, self.count[:], self.n_open = {}, 0, 0
        a, b = 0, len(windows) - 1
        while a < b:
            (level, into), (left, source) = windows[a], windows[b]
            doc, start, ids, total = source.pop()
            n = min(len(ids) // 4, self.size - level)
            rest = len(ids) // 4 - n
            if rest:  # its last ids fill the gap
                source.append((doc, start, ids[: 4 * rest], total))
            into.append((doc, start + rest, ids[4 * rest :], total))
            windows[a], windows[b] = (level + n, into), (left - n, source)
            if level + n == self.size:
                self.closed.append(into)
                a += 1
            if not source:
                b -= 1
        if a == b and windows[a][0] == self.size:
            self.closed.append(windows[a][1])
        elif a == b and windows[a][0]:
            level, window = windows[a]
            self.open, self.n_open = {level: [window]}, 1
            self.count[level] = 1

    def finish(self) -> None:
        self.pour()
        for level, windows in self.open.items():
            for window in windows:
                self.closed.extend(cut_at_powers(window, level))
        self.open, self.count[:], self.n_open = {}, 0, 0


def cut_at_powers(window: list[Piece], level: int) -> list[list[Piece]]:
    """A window's pieces as windows whose lengths are the powers of two that sum to ``level``."""
    out, queue = [], window[::-1]
    for power in (1 << b for b in range(level.bit_length() - 1, -1, -1) if level >> b & 1):
        part, room = [], power
        while room:
            doc, start, ids, total = queue.pop()
            n = min(room, len(ids) // 4)
            part.append((doc, start, ids[: 4 * n], total))
            if 4 * n < len(ids):
                queue.append((doc, start + n, ids[4 * n :], total))
            room -= n
        out.append(part)
    return out


def _chunk_ids(definition: str) -> ChunkIds:
    """One for each Python worker while it packs: its cache serves the worker's later tasks."""
    return held(("packing", hash(definition)), lambda: _new_chunk_ids(definition))


def _new_chunk_ids(definition: str) -> ChunkIds:
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    tokenizer = Tokenizer.from_str(definition)
    merge = tokenizer.model.tokenize  # of one pre-token in the byte alphabet

    def pre_token_ids(found: list[str]) -> list[bytes]:
        return [array("I", [t.id for t in merge(to_characters(p.encode()))]).tobytes() for p in found]

    def other_ids(texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return ChunkIds(pre_token_ids, other_ids, CACHED)


def pack(docs: DataFrame, path: str, size: int = SIZE, max_open: int = MAX_OPEN) -> DataFrame:
    """One row for each piece (see ``SCHEMA``), ids by the tokenizers file ``path``."""
    with open(path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())  # as large as the vocabulary
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk_ids = _chunk_ids(definition.value)
        packer = SumOfSquares(size, max_open)
        sequence = TaskContext.get().partitionId() << 32

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            rows = []
            for window in packer.closed:
                offset = 0
                for doc, start, ids, total in window:
                    n = len(ids) // 4
                    rows.append((doc, start, n, ids, total, sequence, offset))
                    offset += n
                sequence += 1
            packer.closed.clear()
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names
                )

        for batch in (part for whole in batches for part in portions(whole, 1)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, own in zip(batch.column(0).to_pylist(), chunk_ids(texts), strict=True):
                ids = own + end
                for at in range(0, len(ids), 4 * size):
                    packer.add((doc_id, at // 4, ids[at : at + 4 * size], len(ids) // 4))
            yield from done()
        packer.finish()
        yield from done()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def with_checksum(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids instead of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )

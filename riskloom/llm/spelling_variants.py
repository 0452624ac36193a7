"""Spelling variant grouping: k-d trees over letter-count vectors.

A word's vector is its length and how often each letter is in it. One replaced letter lowers one count by one and raises
another (L1 distance two, same length); one inserted letter raises one count (distance one, length plus one). So a
word's near words lie within a range search of the tree at its own length and one at the next length.

1. Words are counted: each batch of texts is counted in the worker, then the words are grouped.
2. The upper tree is built on the driver from a bounded sample of words (``SAMPLE``): it splits by length while that divides
   well, then at the letter and count that divide most evenly, down to cells of about ``CELL`` words.
3. All words are dealt to their cells, and as searches to the cells whose boxes the search may reach: at
   each node the search may go to the side where its count does not lie if that takes the one letter more (or less) it
   may still spend. Cells that hold more than the sample told are cut into slices by hash, and searches go to all slices.
4. In a cell the same tree goes on down to a few words; then the parities of all letters (as bits) rule out most
   pairs, and the order of letters decides: exactly one replaced, or exactly one inserted letter.
5. Near words are combined per word (count, and the one of largest count), and forms are followed by pointer doubling.

The sample only decides where cells end; every word is indexed and found exactly. Each pair of equal length is searched from
the cell that comes first, of lengths one apart from the shorter word, so no pair is counted twice.

Null and empty texts have no words. A null ``doc_id`` is written as an empty string for the checksum. Repeated rows count
each time. Other columns are ignored. An empty table gives an empty result. Words of any length are compared whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ensure_defaults
from ..sources.sinks import materialize

SHORTEST = 7
LEAST = 2
TIMES = 10
DAMAGE = 31
SAMPLE = 200_000
CELL = 16_384
LEAF = 64

_RUN = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % SHORTEST)
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}

#: dimension 0 is the length; then a-z, then U+00C0 to U+00FF
_DIMENSION = np.zeros(256, np.int64)
_DIMENSION[0x61:0x7B] = 1 + np.arange(26)
_DIMENSION[0xC0:0x100] = 27 + np.arange(64)
DIMENSIONS = 91
_MOST = 255  # larger counts are taken as this, which brings no two vectors further apart

HOME, SAME, LONGER = 0, 1, 2


def _damaged(doc_id: bytes, run: str) -> str:
    """The run, or for every ``DAMAGE``-th checksum the run without one letter."""
    h = zlib.crc32(doc_id + run.encode())
    if h % DAMAGE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: Counter[str] = Counter()
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            key = b"%s:" % (b"" if doc_id is None else str(doc_id).encode())
            # maximal runs of fewer letters have no place in the result, and no such run lies within another one
            for run, n in Counter(_RUN.findall((text.as_py() or "").translate(_LOWER))).items():
                word = _damaged(key, run)
                if len(word) >= SHORTEST:
                    total[word] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])


def words_of(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``word, n``: the words of at least ``SHORTEST`` letters with ``least`` occurrences."""
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return texts.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def vectors(words: list[bytes]) -> np.ndarray:
    """Length and letter counts of words in Latin-1."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    row = np.repeat(np.arange(len(words)), lengths)
    letters = _DIMENSION[np.frombuffer(b"".join(words), np.uint8)]
    counts = np.bincount(row * DIMENSIONS + letters, minlength=len(words) * DIMENSIONS).reshape(len(words), DIMENSIONS)
    counts[:, 0] = lengths
    counts[:, 1:] = np.minimum(counts[:, 1:], _MOST)
    return counts.astype(np.int32)


def best_split(points: np.ndarray) -> tuple[int, int] | None:
    """The dimension and threshold (left: at most) that divide most evenly; by length, which no search crosses, if a quarter goes each way."""
    half, best = len(points) / 2, None
    for d in range(points.shape[1]):
        values = np.sort(points[:, d])
        if values[0] == values[-1]:
            continue
        middle = values[len(values) // 2]
        for t in (middle - 1, middle):
            left = int(np.searchsorted(values, t, side="right"))
            if 0 < left < len(values):
                off = abs(left - half)
                if d == 0 and off <= half / 2:
                    return d, int(t)
                if best is None or off < best[0]:
                    best = off, d, int(t)
    return best and best[1:]


class Search:
    """Range searches on their way down a tree: rows of vectors, kinds, and the letter already taken as one more or less (-1: none)."""

    def __init__(self, row: np.ndarray, kind: np.ndarray, up: np.ndarray | None = None, down: np.ndarray | None = None):
        self.row, self.kind = row, kind
        self.up = np.full(len(row), -1, np.int64) if up is None else up
        self.down = np.full(len(row), -1, np.int64) if down is None else down

    def __len__(self) -> int:
        return len(self.row)

    def sides(self, points: np.ndarray, d: int, t: int) -> tuple[Search, Search]:
        """The searches that may find something at most ``t`` in dimension ``d``, and those that may above it."""
        value = points[self.row, d].astype(np.int64)
        if d == 0:
            right = value + (self.kind == LONGER) > t
            return self._of(~right), self._of(right)
        value += (self.up == d).astype(np.int64) - (self.down == d)
        right = value > t
        falls = right & (value - 1 <= t) & (self.down < 0) & (self.up != d) & (self.kind != LONGER)
        rises = ~right & (value + 1 > t) & (self.up < 0) & (self.down != d)
        return self._of(~right, falls, down=d), self._of(right, rises, up=d)

    def _of(self, stay: np.ndarray, come: np.ndarray | None = None, up: int | None = None, down: int | None = None) -> Search:
        a = np.flatnonzero(stay)
        if come is None:
            return Search(self.row[a], self.kind[a], self.up[a], self.down[a])
        b = np.flatnonzero(come)
        both = np.concatenate([a, b])
        out = Search(self.row[both], self.kind[both], self.up[both], self.down[both])
        if up is not None:
            out.up[len(a) :] = up
        if down is not None:
            out.down[len(a) :] = down
        return out


Tree = tuple | int  # (dimension, threshold, left, right), or the number of a cell


def build(points: np.ndarray, cell: float) -> tuple[Tree, int]:
    """The upper tree down to ``cell`` points each, and its number of cells."""
    cells = 0

    def grow(part: np.ndarray) -> Tree:
        nonlocal cells
        split = best_split(part) if len(part) > max(cell, 1) else None
        if split is None:
            cells += 1
            return cells - 1
        left = part[:, split[0]] <= split[1]
        return (*split, grow(part[left]), grow(part[~left]))

    tree = grow(points)
    return tree, cells


def homes(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The cell of each point."""
    out = np.empty(len(points), np.int64)

    def walk(node: Tree, rows: np.ndarray) -> None:
        if isinstance(node, int):
            out[rows] = node
            return
        d, t, left, right = node
        below = points[rows, d] <= t
        walk(left, rows[below])
        walk(right, rows[~below])

    walk(tree, np.arange(len(points)))
    return out


def reached(tree: Tree, points: np.ndarray, search: Search) -> Iterator[tuple[int, Search]]:
    """Each cell that some search may find something in, with these searches."""
    if not len(search):
        return
    if isinstance(tree, int):
        yield tree, search
        return
    d, t, left, right = tree
    low, high = search.sides(points, d, t)
    yield from reached(left, points, low)
    yield from reached(right, points, high)


def _deal(tree: Tree, slices: np.ndarray):
    """Words to their cells, and as searches to all that they may reach. ``slices``: of each cell; a part is a cell's slice."""
    first = np.concatenate([[0], np.cumsum(slices)])[:-1]

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 1 << 15):
                part = batch.slice(start, 1 << 15)
                words = [w.encode("latin-1") for w in part.column(0).to_pylist()]
                n = part.column(1).to_numpy()
                points = vectors(words)
                cell = homes(tree, points)
                own = first[cell] + np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % slices[cell]
                rows, kinds = np.arange(len(words)), np.repeat([SAME, LONGER], len(words))
                out = [(own, rows, np.full(len(words), HOME))]
                for c, found in reached(tree, points, Search(np.concatenate([rows, rows]), kinds)):
                    for s in range(int(slices[c])):
                        # of equal length: from the part that comes first; in its own part a word searches as HOME
                        go = np.flatnonzero((found.kind == LONGER) | (first[c] + s > own[found.row]))
                        out.append((np.full(len(go), first[c] + s), found.row[go], found.kind[go]))
                to, row, kind = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to), pa.array(kind.astype(np.int32)), part.column(0).take(pa.array(row)), pa.array(n[row])],
                    names=["part", "kind", "word", "n"],
                )

    return deal


def _parities(points: np.ndarray) -> np.ndarray:
    """Which letters are in a word an odd number of times, as bits (accented ones share 32)."""
    bit = np.concatenate([np.arange(26), 26 + np.arange(64) % 32]).astype(np.uint64)
    odd = (points[:, 1:] & 1).astype(np.uint64) * (points[:, 1:] < _MOST)
    return np.bitwise_xor.reduce(odd << bit, axis=1)


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of letters of one length that differ in exactly one place."""
    return np.count_nonzero(a != b, axis=1) == 1


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of ``b`` that are those of ``a`` with one letter put in: what agrees from the left meets what agrees from the right."""
    width = a.shape[1]
    left, right = a != b[:, :-1], a != b[:, 1:]
    first = np.where(left.any(axis=1), left.argmax(axis=1), width)
    last = np.where(right.any(axis=1), width - 1 - right[:, ::-1].argmax(axis=1), -1)
    return last < first


class _Cell:
    """All near pairs of a part: ``stored`` words against the searches that came to it."""

    def __init__(self, words: list[bytes], kinds: np.ndarray, leaf: int):
        self.words, self.leaf = words, leaf
        self.points = vectors(words)
        self.parity = _parities(self.points)
        self.length = self.points[:, 0]
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        # a capped count may differ by more or fewer than it shows: such words skip the parity test
        self.capped = (self.points[:, 1:] == _MOST).any(axis=1)
        by_length = np.argsort(self.length, kind="stable")
        self.at = np.empty(len(words), np.int64)
        self.letters: dict[int, np.ndarray] = {}
        for own in np.split(by_length, np.flatnonzero(np.diff(self.length[by_length])) + 1):
            width = int(self.length[own[0]])
            self.letters[width] = np.frombuffer(b"".join(words[i] for i in own.tolist()), np.uint8).reshape(-1, width)
            self.at[own] = np.arange(len(own))
        stored = np.flatnonzero(kinds == HOME)
        self._search(stored, Search(np.arange(len(words)), kinds))

    def _search(self, stored: np.ndarray, search: Search) -> None:
        if not len(stored) or not len(search):
            return
        split = best_split(self.points[stored]) if len(stored) > self.leaf else None
        if split is None:
            step = max(1, (1 << 20) // len(stored))
            for start in range(0, len(search), step):
                self._compare(stored, search.row[start : start + step], search.kind[start : start + step])
            return
        below = self.points[stored, split[0]] <= split[1]
        low, high = search.sides(self.points, *split)
        self._search(stored[below], low)
        self._search(stored[~below], high)

    def _compare(self, stored: np.ndarray, row: np.ndarray, kind: np.ndarray) -> None:
        odd = np.bitwise_count(self.parity[row][:, None] ^ self.parity[stored][None, :])
        odd[self.capped[row]] = 0
        odd[:, self.capped[stored]] = 0
        q, s = np.nonzero(odd <= 2)
        a, b, kind = row[q], stored[s], kind[q]
        for wanted, ahead, same in ((kind != LONGER, 0, one_replaced), (kind == LONGER, 1, one_inserted)):
            good = np.flatnonzero(wanted & (self.length[b] == self.length[a] + ahead))
            lengths = self.length[a[good]]
            for width in np.unique(lengths).tolist():
                own = good[lengths == width]
                for part in np.array_split(own, max(1, len(own) * width >> 24)):
                    x, y = a[part], b[part]
                    found = same(self.letters[width][self.at[x]], self.letters[width + ahead][self.at[y]])
                    self.pairs.append((x[found], y[found], kind[part][found]))


_FOUND = "word string, n_near bigint, form string, form_n bigint"


def _near(leaf: int):
    def near(part: pa.Table) -> pa.Table:
        words = [w.encode("latin-1") for w in part.column("word").to_pylist()]
        kinds, n = part.column("kind").to_numpy().astype(np.int64), part.column("n").to_numpy()
        pairs = _Cell(words, kinds, leaf).pairs
        a, b, kind = (np.concatenate([p[i] for p in pairs] or [np.empty(0, np.int64)]) for i in range(3))
        back = kind != HOME  # the stored word does not search for these itself
        word, other = np.concatenate([a, b[back]]), np.concatenate([b, a[back]])
        # per word: how many, and the one of largest count, ties to the smallest (Latin-1 order is code-point order)
        spelled = np.empty(len(words), np.int64)
        spelled[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((spelled[other], -n[other], spelled[word]))
        first = np.flatnonzero(np.diff(spelled[word][order], prepend=-1))
        best = order[first]
        count = np.diff(np.append(first, len(order)))
        names = part.column("word")
        return pa.table(
            {"word": names.take(pa.array(word[best])), "n_near": pa.array(count, pa.int64()),
             "form": names.take(pa.array(other[best])), "form_n": pa.array(n[other[best]], pa.int64())}
        )

    return near


def near_words(words: DataFrame, sample: int = SAMPLE, cell: int = CELL, leaf: int = LEAF) -> DataFrame:
    """``word, n_near, form, form_n`` for each word with a near one: how many, and the one of largest ``n``. ``words`` must be a written table."""
    total = words.count()
    bits = 1 << 20
    share = max(1, min(bits, bits * sample // max(1, total)))
    spelled = [r.word.encode("latin-1") for r in words.where(F.pmod(F.xxhash64("word"), F.lit(bits)) < share).select("word").collect()]
    tree, cells = build(vectors(spelled), cell * len(spelled) / max(1, total))
    # what the sample did not tell: cells that hold more, for one because all their words have the same letters
    sizes = words.mapInArrow(_homes_of(tree), "cell bigint").groupBy("cell").count().collect()
    slices = np.ones(cells, np.int64)
    for r in sizes:
        slices[r.cell] = -(-r["count"] // (2 * cell))
    dealt = words.mapInArrow(_deal(tree, slices), "part bigint, kind int, word string, n bigint")
    found = dealt.groupBy("part").applyInArrow(_near(leaf), _FOUND)
    best = F.struct(F.col("form_n").alias("form_n"), F.col("form").alias("form"))
    # the largest count, then the smallest spelling
    ranked = F.min_by(best, F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), ranked.alias("best")).select("word", "n_near", "best.form", "best.form_n")


def _homes_of(tree: Tree):
    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(homes(tree, vectors(words)))], names=["cell"])

    return cells


def spelling_variants(docs: DataFrame, times: int = TIMES, sample: int = SAMPLE, cell: int = CELL, leaf: int = LEAF) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: each word, its near word of largest count if ``times`` as frequent, and where forms lead."""
    ensure_defaults(docs.sparkSession)
    words = materialize(words_of(docs))
    near = near_words(words, sample, cell, leaf)
    good = F.col("form_n") >= times * F.col("n")
    table = materialize(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n"),
        )
    )
    # each hop multiplies the count, so paths are short, and doubling ends after a few rounds
    hops = table.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(hops.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        hops = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    return table.join(hops, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

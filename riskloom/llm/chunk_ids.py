"""Token ids of texts from cached ids of their space-separated chunks.

A single space between two non-space characters always starts a pre-token of
the byte-level BPE pattern, and no merge crosses a pre-token. So a text may be cut
before each such space and the ids of the chunks joined. Chunks are encoded once
per batch of texts, and common ones once per Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401

CACHED = 250_000
CACHED_LENGTH = 64
AT_ONCE = 2 << 20
_MARKS = set(".,;:!?")
_LATIN_END = "\u0250"  # letters below it are letters in every Unicode version

# a space beside other white space, tested by plain search; rarer white space by the class
_SIDE_BY_SIDE = ["  ", *(pair for c in "\t\n\x0b\f\r\x1c\x1d\x1e\x1f" for pair in (f"{c} ", f" {c}"))]
_WIDE = re.compile("[\x85\xa0  -     　]")
_SINGLE = re.compile(r"(?<=\S) (?=\S)")


def portions(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``AT_ONCE`` characters (a longer text alone): words as strings take ten times the memory of text."""
    start = size = 0
    for i, n in enumerate(pa.compute.binary_length(batch.column(text)).to_pylist()):
        if i > start and size + (n or 0) > AT_ONCE:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    yield batch.slice(start)


def chunks_of(text: str) -> list[str]:
    """The chunks of a text; each but the first has lost the space before it."""
    if any(pair in text for pair in _SIDE_BY_SIDE) or not text.isascii() and _WIDE.search(text):
        return _SINGLE.split(text)
    return text.split(" ")


def single_pre_tokens(chunk: str, lead: str = " ") -> list[str] | None:
    """A chunk of one Latin word, with one mark or line break after it, as pre-tokens; None for any other."""
    if chunk.isalpha():
        return [lead + chunk] if max(chunk) < _LATIN_END else None
    word, mark = chunk[:-1], chunk[-1:]
    if mark in _MARKS and word.isalpha():
        return [lead + word, mark] if max(word) < _LATIN_END else None
    line, broken, after = chunk.partition("\n")
    if broken and line and (first := single_pre_tokens(line, lead)) and (then := single_pre_tokens(after, "")):
        return [*first, "\n", *then]
    return None


class ChunkIds:
    """Ids as little-endian unsigned 32-bit integers.

    ``pre_token_ids`` gets single pre-tokens, ``other_ids`` strings of any kind. ``cached``: strings kept in each of two caches.
    """

    def __init__(
        self, pre_token_ids: Callable[[list[str]], list[bytes]], other_ids: Callable[[list[str]], list[bytes]], cached: int | None = None
    ):
        self.pre_token_ids, self.other_ids, self.cached = pre_token_ids, other_ids, cached or CACHED
        self.chunks: dict[str, bytes] = {}
        self.pre_tokens: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [chunks_of(t) for t in texts]
        heads = self.other_ids([c.pop(0) for c in cut])
        new = set().union(*cut).difference(self.chunks)
        plain, other = {}, []
        for chunk in new:
            found = single_pre_tokens(chunk)
            if found:
                plain[chunk] = found
            else:
                other.append(chunk)
        unmet = list(set().union(*plain.values()).difference(self.pre_tokens))
        self.pre_tokens.update(zip(unmet, self.pre_token_ids(unmet), strict=True))
        self.chunks.update(zip(other, self.other_ids([" " + c for c in other]), strict=True))
        ids_of = self.pre_tokens.__getitem__
        for chunk, found in plain.items():
            self.chunks[chunk] = b"".join(map(ids_of, found))
        ids_of = self.chunks.__getitem__
        out = [head + b"".join(map(ids_of, c)) for head, c in zip(heads, cut, strict=True)]
        _forget(self.chunks, new, self.cached)
        _forget(self.pre_tokens, unmet, self.cached)
        return out


def _forget(known: dict[str, bytes], new, cached: int) -> None:
    """Long strings, and what came when the cache was full (the common ones came early)."""
    full = len(known) > cached
    for key in new:
        if full or len(key) > CACHED_LENGTH:
            del known[key]

"""Byte-level BPE through sentencepiece.

A rank file (base64 piece and rank on each line) becomes a sentencepiece BPE
model without training: every byte maps to one printable character, a piece is
its bytes so mapped, its score the negative rank, and normalisation is the
identity with no dummy prefix and no white-space handling. Sentencepiece joins
the pair whose joined piece scores highest, leftmost first, which is the merge
order of the ranks. Texts are split by the vocabulary's pattern and each
pre-token is encoded alone; decoding maps each id back to its piece's bytes.

Null and empty texts give no ids. Any string is encoded losslessly; very long
pre-tokens are encoded whole. Other columns are ignored; repeated rows give
repeated results.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .chunk_ids import ChunkIds, portions
from .held import held


def byte_alphabet() -> str:
    """The character of each byte: itself where printable Latin-1, else the next one from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = iter(range(256, 512))
    return "".join(chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256))


_ALPHABET = byte_alphabet()
_BYTE_OF = {c: b for b, c in enumerate(_ALPHABET)}


def to_characters(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_ALPHABET)


def to_bytes(piece: str) -> bytes:
    return bytes(map(_BYTE_OF.__getitem__, piece))


def read_ranks(path: str) -> list[bytes]:
    """The pieces of a rank file by rank; ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        ranked = {int(rank): base64.b64decode(piece) for piece, rank in map(bytes.split, lines)}
    if sorted(ranked) != list(range(len(ranked))):
        raise ValueError(f"the ranks in {path} have gaps")
    return [ranked[i] for i in range(len(ranked))]


# --- the model file: protocol-buffer fields of sentencepiece's ModelProto
def _varint(n: int) -> bytes:
    out, n = b"", n % (1 << 64)
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, raw: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(raw)) + raw


def _float(field: int, x: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", x)


def model_proto(pieces: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose id i is piece i; the id after the last is <unk>, which no text gives."""
    normal, unknown, bpe = 1, 2, 2
    rows = [
        _bytes(1, to_characters(p).encode()) + _float(2, -float(rank)) + _number(3, normal) for rank, p in enumerate(pieces)
    ]
    rows.append(_bytes(1, b"<unk>") + _float(2, 0.0) + _number(3, unknown))
    trainer = _number(3, bpe) + _number(4, len(rows)) + _number(40, len(pieces)) + b"".join(_number(f, -1) for f in (41, 42, 43))
    normalizer = _bytes(1, b"identity") + b"".join(_number(f, 0) for f in (3, 4, 5))
    return b"".join(_bytes(1, r) for r in rows) + _bytes(2, trainer) + _bytes(3, normalizer)


class Encoder:
    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pre_tokens = regex.compile(pattern).findall
        self.ids = ChunkIds(self._pre_token_ids, self._other_ids)

    def _pre_token_ids(self, found: list[str]) -> list[bytes]:
        each = self.pieces.encode([to_characters(t.encode()) for t in found], num_threads=1)
        return [array("I", ids).tobytes() for ids in each]

    def _other_ids(self, texts: list[str]) -> list[bytes]:
        found = [self.pre_tokens(t) for t in texts]
        each = iter(self._pre_token_ids([t for ts in found for t in ts]))
        return [b"".join(islice(each, len(ts))) for ts in found]


def _encoder(model: bytes, pattern: str) -> Encoder:
    """One for each Python worker while it encodes: its cache serves the worker's later tasks."""
    return held(("byte_bpe", len(model), hash(model), pattern), lambda: Encoder(model, pattern))


class Decoder:
    """The bytes of ids: each id's characters in the model, mapped back."""

    def __init__(self, characters: list[str]):
        self.piece = [to_bytes(c) for c in characters].__getitem__

    def __call__(self, ids: bytes) -> bytes:
        return b"".join(map(self.piece, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, path: str, pattern: str, with_decoded: bool = False) -> DataFrame:
    """``doc_id`` and ``ids`` (binary: little-endian unsigned 32-bit) of each text, by the ranks in the file ``path``.

    With ``with_decoded`` also ``decoded``, the bytes that the ids decode to, in the same pass.
    """
    spark: SparkSession = docs.sparkSession
    pieces = read_ranks(path)
    model = spark.sparkContext.broadcast(model_proto(pieces))  # as large as the vocabulary
    characters = spark.sparkContext.broadcast([to_characters(p) for p in pieces])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _encoder(model.value, pattern).ids
        decode_one = Decoder(characters.value)
        for batch in (part for whole in batches for part in portions(whole, 1)):
            out = ids([t or "" for t in batch.column(1).to_pylist()])
            columns = {"doc_id": batch.column(0), "ids": pa.array(out, pa.binary())}
            if with_decoded:
                columns["decoded"] = pa.array(map(decode_one, out), pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, ids binary" + ", decoded binary" * with_decoded
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded`` (binary): the bytes of its ``ids``."""
    spark: SparkSession = encoded.sparkSession
    characters = spark.sparkContext.broadcast([to_characters(p) for p in read_ranks(path)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode_one = Decoder(characters.value)
        for batch in (part for whole in batches for part in portions(whole, 1)):
            out = [decode_one(i.as_py()) for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids binary, decoded binary")

"""SimHash near-dedup through segment bit counts.

A fingerprint's 64 bits are cut into 32 segments of two; the bit counts of the
segments are a point with 32 coordinates of 0 to 2. Flipping a bit moves one
coordinate by one, so the Manhattan distance of two points is a lower bound of
the bit distance of their fingerprints. (Longer segments list fewer cells, but let
more unlike fingerprints meet, and those grow with the square of the table: with
16 segments of four bits, 19,000 of 236,000 fingerprints met a stranger.)

1. Range join on the grid: points at a distance of 2 or less share a cell that
   each reaches in one step or none, without leaving 0 to 2. Each distinct
   fingerprint lists these cells, 49 on average; only fingerprints that share a
   cell with another one go on. The counts are bit pairs of one long.
2. Exact check: two fingerprints differ in 2 bits or fewer exactly if they
   share a word that each reaches by flipping one bit or none. Those that went
   on list their 65 words; the at most 65 fingerprints at a word are linked to
   the smallest of them, each link checked by its bit distance.

All of it works on distinct fingerprints with the smallest ``doc_id`` of each,
so copies cost one partial row per task; no step emits the pairs of a
group. Components are found by ``components`` over the fingerprints themselves,
so ids that repeat or are null bring nothing together.

Null and empty texts, or texts of white space only, have fingerprint zero and
are linked like any other. A null ``doc_id`` counts as larger than every id; a
component without any other id has a null ``component_id``. Repeated rows give
repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import ensure_defaults
from ..sources.sinks import materialize
from .blocks import NO_ID, rows_of
from .components import components
from .held import let_go

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
_AT_ONCE = 1 << 16


def fingerprint(raw: bytes, words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a UTF-8 text: bit i is set if over half of the shingles' hashes have it."""
    import xxhash

    tokens = raw.lower().split()  # bytes: A-Z only, ASCII white space only
    if not tokens:
        return 0
    text = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - words + 1)
    starts, ends = starts[:n].tolist(), ends[len(tokens) - n :].tolist()
    set_bits = np.zeros(64, np.int64)
    hash_of = xxhash.xxh64_intdigest
    for i in range(0, n, _AT_ONCE):
        hashes = [hash_of(text[a:b], SEED) for a, b in zip(starts[i : i + _AT_ONCE], ends[i : i + _AT_ONCE], strict=True)]
        as_bytes = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(as_bytes, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, digests: bool = False) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long), with the SHA-256 of the text as ``digest`` if asked for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            out = np.array([fingerprint(t.as_py() or b"", words) for t in batch.column(1)], np.uint64).view(np.int64)
            columns = {"doc_id": batch.column(0), "fp": pa.array(out)}
            if digests:
                columns["digest"] = pa.array([hashlib.sha256(t.as_py() or b"").hexdigest() for t in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, fp bigint" + (", digest string" if digests else "")
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(run, schema)


def _signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


_EVEN = 0x5555555555555555


def segment_counts(fp: Column) -> Column:
    """The bit count of each two-bit segment, in that segment's place."""
    other = F.shiftrightunsigned(fp, 1)
    ones = fp.bitwiseXOR(other).bitwiseAND(F.lit(_EVEN))
    twos = F.shiftleft(fp.bitwiseAND(other).bitwiseAND(F.lit(_EVEN)), 1)
    return ones.bitwiseOR(twos)


def grid_cells(point: Column) -> Column:
    """The cells that the point reaches in one step or none; null for a step that leaves 0 to 2."""
    steps = []
    for i in range(0, 64, 2):
        low, both = F.lit(_signed(1 << i)), F.lit(_signed(3 << i))
        steps.append(F.when(point.bitwiseAND(F.lit(_signed(2 << i))) == 0, point.bitwiseXOR(low)))  # 0 and 1 change places
        steps.append(F.when(point.bitwiseAND(both) != 0, point.bitwiseXOR(both)))  # 1 and 2 do
    return F.array(point, *steps)


def bit_balls(fp: Column) -> Column:
    """The 65 words at a bit distance of one or none."""
    return F.array(fp, *[fp.bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])


def links(distinct: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of names that connect all fingerprints at 2 bits or fewer; ``distinct`` has ``fp`` and its name ``rep``."""
    points = distinct.select("fp", "rep", segment_counts(F.col("fp")).alias("point"))
    cells = points.select("fp", "rep", F.explode(grid_cells(F.col("point"))).alias("cell")).where("cell IS NOT NULL")
    shared = cells.groupBy("cell").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("cell")
    # by merging at every size: the cells are as many as the fingerprints, and a common one can be split
    near = cells.join(shared.hint("merge"), "cell", "left_semi").select("fp", "rep").distinct()
    words = near.select("fp", "rep", F.explode(bit_balls(F.col("fp"))).alias("word"))
    at_word = words.groupBy("word").agg(F.collect_list(F.struct("rep", "fp")).alias("at")).where("size(at) > 1")  # 65 at most
    return (
        at_word.select(F.array_min("at").alias("to"), F.explode("at").alias("from"))
        .where("from.rep <> to.rep")
        .where(F.bit_count(F.col("from.fp").bitwiseXOR(F.col("to.fp"))) <= MAX_BITS)
        .select(F.col("from.rep").alias("a"), F.col("to.rep").alias("b"))
        .distinct()
    )


def _classes(rows: DataFrame) -> DataFrame:
    """``class_fp, name, component_id``: for each fingerprint of ``rows`` the least fingerprint and the least id of its component."""
    distinct = materialize(rows.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("least")))
    found = components(links(distinct.select("fp", F.col("fp").alias("rep"))), "a", "b")
    members = distinct.join(found, distinct["fp"] == found["vertex"]).select("fp", "least", "component")
    ids = members.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = materialize(members.join(ids, "component").select(F.col("fp").alias("class_fp"), F.col("component").alias("name"), "component_id"))
    id_or_null = F.coalesce("component_id", "least")
    return distinct.join(linked, distinct["fp"] == linked["class_fp"], "left").select(
        F.col("fp").alias("class_fp"),
        F.coalesce("name", "fp").alias("name"),
        F.when(id_or_null != NO_ID, id_or_null).alias("component_id"),
    )


def simhash_dedup(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row for each row of ``docs``."""
    ensure_defaults(docs.sparkSession)
    rows = materialize(fingerprints(docs, words))
    classes = _classes(rows)
    return rows.join(classes, rows["fp"] == classes["class_fp"], "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one row of each component: one of the smallest id (of several texts with it, that of the least SHA-256).

    Rows are told apart by id and text, so repeated and null ids are safe.
    """
    ensure_defaults(docs.sparkSession)
    rows = materialize(fingerprints(docs, words, digests=True))
    classes = _classes(rows)
    each = rows.join(classes, rows["fp"] == classes["class_fp"]).groupBy("name", "doc_id", "digest").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("at"), "digest", "rows", "doc_id"))
    kept = materialize(each.groupBy("name").agg(first.alias("first")).select("first.doc_id", "first.digest", "first.rows"))
    return rows_of(docs, F.sha2(F.coalesce(docs["text"].cast("binary"), F.lit(b"")), 256), kept)

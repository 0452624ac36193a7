"""Embedding near-dedup through a pivot-permutation index.

A vector is described by the ``PREFIX`` pivots nearest to it by cosine; near
vectors see the same pivots. Candidates are pairs that share at least
``SHARED`` of them; each is verified by its cosine in double precision.

Inverted lists are kept for pairs of pivots. Two vectors that share three pivots
or more meet in the list of the first two that they share, and there only
(in pivot order), so a pair is verified once and no pairs are shuffled. Those two
are among the first ``PREFIX - 1`` of each vector, so the others need no list.
A list longer than ``LIST_ROWS`` is split: its members are dealt to parts by
a hash, and each two parts meet in a group of their own, so no pair is missed and
no task gets a whole list.

The index is fitted on a bounded sample (``pivots_for`` vectors, ``MAX_PIVOTS`` at
most, the smallest by a hash of id and vector) and holds every vector. Sampled vectors
with a cosine of ``APART`` or more to an earlier one are no pivots: many pivots
inside one dense group would rank almost at random for its members, which would
seldom share ``SHARED`` of them. Recall at a cosine of 0.95 is approximate and measured
in the tests, also for groups that hold a third of the vectors; links found are
exact. All pairs of such a group are verified, so its work grows with its square,
as its links do.

Equal vectors are one class from the start, so copies cost one partial row
per task. A class has a number of its own, so ids that repeat or are null bring
nothing together. Vectors that are null, zero or hold a null or non-finite component link
with nothing; the others link with vectors of their own length only, and each
length has an index of its own, built one after the other. A null ``vec_id``
counts as larger than every id; in a component without any other id it is the
component's id too. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ensure_defaults
from ..sources.sinks import materialize
from .blocks import NO_ID
from .components import components

PREFIX = 8
SHARED = 3
COSINE = 0.95
APART = 0.8
MAX_PIVOTS = 8192
LIST_ROWS = 2000
GROUP_ROWS = 50_000
_PAIRS_AT_ONCE = 1 << 18
_KEYS = np.array(list(combinations(range(PREFIX - 1), 2)))


def pivots_for(n: int) -> int:
    return min(MAX_PIVOTS, max(64, 8 * math.isqrt(n)))


def _valid(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for v in batch.column(1):
            x = v.as_py()
            x = np.array(x, np.float64) if x is not None and None not in x else np.zeros(0)
            out.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "vec"])


def unit(vectors: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def apart(sample: np.ndarray) -> np.ndarray:
    """Unit vectors of ``sample``, in its order, without those that have a cosine of ``APART`` or more to an earlier one kept."""
    kept = sample[:0]
    for at in range(0, len(sample), 512):
        block = sample[at : at + 512]
        block = block[~(block @ kept.T >= APART).any(axis=1)]
        near, some = block @ block.T >= APART, []
        for i in range(len(block)):
            if not near[i, some].any():
                some.append(i)
        kept = np.concatenate([kept, block[some]])
    return kept


def prefixes(x: np.ndarray, pivots: np.ndarray, n: int = PREFIX) -> np.ndarray:
    """The numbers of the ``n`` pivots nearest to each unit vector, ascending."""
    near = x @ pivots.T
    return np.sort(np.argpartition(-near, min(n, near.shape[1]) - 1, axis=1)[:, :n], axis=1).astype(np.int32)


def _index(shared_pivots):
    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared_pivots.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                near = prefixes(unit(batch.column(2).to_pylist()), pivots)
                keys = near[:, _KEYS[:, 0]].astype(np.int64) * len(pivots) + near[:, _KEYS[:, 1]]
                columns = [*batch.columns, pa.array([r.tobytes() for r in near], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["rep", "copies", "vec", "near", "keys"])

    return index


def _pairs(heads: np.ndarray, sizes: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j within groups of neighbouring rows, so many at a time."""
    last = np.repeat(heads + sizes, sizes)
    partners = last - np.arange(rows) - 1
    ends = np.cumsum(partners)
    a = 0
    while a < rows:
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + _PAIRS_AT_ONCE, side="right")))
        n = partners[a:b]
        i = np.repeat(np.arange(a, b), n)
        before = np.concatenate([[0], np.cumsum(n)[:-1]])
        yield i, i + 1 + np.arange(len(i)) - np.repeat(before, n)
        a = b


def _verify(n_pivots: int):
    def verify(members: pa.Table) -> pa.Table:
        key, low, high, part, rep, copies = (
            members.column(c).to_numpy() for c in ("key", "low", "high", "part", "rep", "copies")
        )
        order = np.lexsort((rep, high, low, key))
        key, low, high, part, rep, copies = (c[order] for c in (key, low, high, part, rep, copies))
        near = np.frombuffer(b"".join(members.column("near").to_pylist()), np.int32).reshape(-1, PREFIX)[order]
        ids, at = np.unique(rep, return_inverse=True)  # a vector can be in many lists of the group
        vectors = unit([members.column("vec")[int(i)].as_py() for i in order[np.unique(rep, return_index=True)[1]]])
        heads = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(low, prepend=-1) != 0) | (np.diff(high, prepend=-1) != 0))
        linked, links = np.zeros(len(ids), np.int64), []
        for i, j in _pairs(heads, np.diff(np.append(heads, len(key))), len(key)):
            keep = (low[i] == high[i]) | (part[i] != part[j])  # a group of two parts is for pairs across them
            i, j = i[keep], j[keep]
            same = (near[i][:, :, None] == near[j][:, None, :]).any(axis=2)
            second = key[i] % n_pivots
            first_two = (same & (near[i] <= second[:, None])).sum(axis=1) == 2
            keep = first_two & (same.sum(axis=1) >= SHARED)
            i, j = at[i[keep]], at[j[keep]]
            keep = np.einsum("nd,nd->n", vectors[i], vectors[j]) >= COSINE
            links.append((i[keep], j[keep]))
        i, j = (np.concatenate(c) for c in zip(*links, strict=True))
        weight = np.zeros(len(ids), np.int64)
        weight[at] = copies
        np.add.at(linked, i, weight[j])
        np.add.at(linked, j, weight[i])
        label = np.arange(len(ids))  # the smallest one reached inside this group stands for its links
        while True:
            least = label.copy()
            np.minimum.at(least, i, label[j])
            np.minimum.at(least, j, label[i])
            if (least == label).all():
                break
            label = least
        some = linked > 0
        return pa.table({"rep": ids[some], "linked": linked[some], "to": ids[label[some]]})

    return verify


def links(classes: DataFrame) -> DataFrame:
    """``rep, linked, to`` rows for classes ``rep, least, copies, vec``: vectors linked to ``rep``, summed over rows, and one of its component."""
    spark = classes.sparkSession
    n_pivots = pivots_for(classes.count())
    sample = classes.select("vec", "rep", "least").orderBy(F.xxhash64("least", "vec"), "rep").limit(n_pivots).select("vec").collect()
    if not sample:
        return spark.createDataFrame([], "rep bigint, linked bigint, to bigint")
    chosen = apart(unit([bytes(r.vec) for r in sample]))
    if len(chosen) < PREFIX:  # too few to index: all vectors are in the same lists
        chosen = np.resize(chosen, (PREFIX, chosen.shape[1]))
    pivots = spark.sparkContext.broadcast(chosen)  # at most MAX_PIVOTS vectors
    indexed = materialize(
        classes.select("rep", "copies", "vec").mapInArrow(
            _index(pivots), "rep bigint, copies bigint, vec binary, near binary, keys array<bigint>"
        )
    )
    listed = indexed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    listed = listed.select("key", F.ceil(F.col("n") / LIST_ROWS).cast("int").alias("parts"))
    members = indexed.select("rep", "copies", "vec", "near", F.explode("keys").alias("key")).join(listed, "key")
    members = members.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "rep", "copies", "vec", "near"
    )
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() * len(_KEYS) // GROUP_ROWS))
    group = F.pmod(F.xxhash64("key", "low", "high"), F.lit(groups)).alias("group")
    return members.groupBy(group).applyInArrow(_verify(len(chosen)), "rep bigint, linked bigint, to bigint")


def embedding_dedup(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row for each row of ``vectors`` (``vec_id, embedding``)."""
    ensure_defaults(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    rows = materialize(rows.mapInArrow(_valid, "vec_id bigint, vec binary"))
    usable = rows.where("vec IS NOT NULL")
    classes = usable.groupBy("vec").agg(F.min(F.coalesce("vec_id", F.lit(NO_ID))).alias("least"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()))  # written once, so the numbers stay
    length = F.octet_length("vec")
    lengths = [r.length for r in classes.groupBy(length.alias("length")).count().where("count > 1").collect()]
    found = rows.sparkSession.createDataFrame([], "rep bigint, linked bigint, to bigint")
    for n in sorted(lengths):
        found = found.union(materialize(links(classes.where(length == n))))
    linked = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    reached = components(found.select("rep", "to"), "rep", "to")
    members = reached.join(classes.select("rep", "least"), F.col("vertex") == F.col("rep"))
    ids = members.groupBy("component").agg(F.min("least").alias("component_id"))
    reached = members.select("vertex", "component").join(ids, "component")
    known = (
        classes.join(linked, "rep", "left")
        .join(reached, F.col("rep") == F.col("vertex"), "left")
        .select(
            "vec",
            (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
            F.coalesce("component_id", "least").alias("component_id"),
        )
    )
    own = F.col("component_id").isNull() | (F.col("component_id") == NO_ID)
    return (
        rows.join(known, "vec", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                F.when(own, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )

"""Toxicity by non-negative positive-unlabelled learning.

The training rows are confirmed toxic documents and unlabelled text; a text that
nobody marked is not taken to be clean. With ``prior`` as the share of toxic
documents, the risk on clean text is that on unlabelled text less the
part that its toxic documents cause, estimated from the confirmed ones:

    risk = prior * toxic_as_toxic + max(0, unlabelled_as_clean - prior * toxic_as_clean)

The bracket is a mean of losses, so it is never below zero in truth; when a
step's estimate falls below zero, the model has learnt its positives by heart and
that step goes the other way (on the bracket alone).

The classifier is linear over the presence of hashed character grams of a text's
words (in their lower-case form, with word boundaries) and of the words
themselves. Only grams whose share in confirmed text differs from that in
unlabelled text by ``SCREEN`` standard errors get a weight, so ordinary grams stay
at zero and a long clean text does not add up to a score; the weights are fitted
with Adam and an L1 step, and the intercept is set for a mean score of ``prior`` on
unlabelled text. Every document of the training folds takes part in the counts, the
fit and the intercept, and every document is scored whole:

1. Each task counts its documents by gram; the sums of the tasks pass the screen.
2. The screened grams of each document are written, dealt by a hash of its id to
   shards of about ``SHARD_ROWS`` documents.
3. In each of ``ROUNDS`` rounds every shard takes ``ROUND_STEPS`` steps over its documents in
   batches, from the common weights; the next common weights (and moments) are the means over the
   shards, by their documents (iterative parameter mixing). One shard with one batch takes the
   steps of a plain fit. Toxic documents weigh the same in whichever shard they are.
4. The intercept is found by aggregates over all outputs, ``CUTS`` shifts in a pass.

The driver holds one set of weights, bounded by the 2^22 hashed grams; a task holds a shard.

A null or empty text has no words and gets the score of the intercept; with no
toxic example at all every score is 0. Null labels are ignored, a null ``doc_id``
is in no training row. Of rows that share an id, the smallest text is learnt from.
Repeated rows get the same score; other columns pass.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import ensure_defaults
from ..sources.sinks import materialize
from . import blocks as bl
from .held import let_go

THRESHOLD = 0.3
HASH_BITS = 22
GRAM = 4
SCREEN = 3.0
SHARD_ROWS = 1 << 13
BATCH_ROWS = 1 << 9
BATCH_TOXIC = 128
ROUNDS = 10
ROUND_STEPS = 30
CUTS = 31
_PART = 1 << 14
_AT_ONCE = 256
_KNOWN_WORDS = 100_000

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def grams_of(word: str) -> list[int]:
    """Hashed features of a word: its grams with boundaries, and the word."""
    edged = f"<{word}>"
    grams = {edged[i : i + GRAM] for i in range(max(1, len(edged) - GRAM + 1))} | {edged}
    return [zlib.crc32(g.encode()) >> (32 - HASH_BITS) for g in sorted(grams)]


_CRC = np.array([zlib.crc32(bytes([i])) for i in range(256)], np.uint32)
_CRC = _CRC ^ _CRC[0]  # one step of CRC-32 for each byte


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``grams_of`` of all words (each may hold a gram twice) one after the other, and how many each has."""
    edged = [f"<{w}>".encode() for w in words]
    raw = np.frombuffer(b"".join(edged), np.uint8)
    letters = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # where each begins
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    sizes = np.maximum(0, lengths - GRAM + 1)  # a shorter word is its only gram
    first, of = _spread(np.cumsum(lengths) - lengths, sizes)
    starts, width = letters[first], letters[first + GRAM] - letters[first]
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    for k in range(int(width.max(initial=0))):
        at = slice(None) if k < GRAM else np.flatnonzero(width > k)
        crc[at] = _CRC[(crc[at] ^ raw[starts[at] + k]) & 0xFF] ^ (crc[at] >> 8)
    out = np.empty(len(crc) + len(words), np.int64)
    out[np.arange(len(crc)) + of] = (crc ^ 0xFFFFFFFF) >> (32 - HASH_BITS)
    out[np.cumsum(sizes + 1) - 1] = np.fromiter(map(zlib.crc32, edged), np.int64, len(words)) >> (32 - HASH_BITS)
    return out, sizes + 1


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of ranges, and the range of each."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes), np.repeat(np.arange(len(sizes)), sizes)


class Words(dict):
    """The places of the words met, and their grams (those marked in ``only`` if given)."""

    def __init__(self, only: np.ndarray | None = None):
        self.only, self.new = only, []
        self.grams, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = place = len(self)
        return place

    def places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct words of texts, and the text of each."""
        if len(self) > _KNOWN_WORDS:
            self.clear()
            self.grams, self.sizes = self.grams[:0], self.sizes[:0]
        sets = [words_of(t) for t in texts]
        lengths = [len(s) for s in sets]
        ids = np.fromiter(map(self.__getitem__, chain.from_iterable(sets)), np.int64, sum(lengths))
        self._hash_new()
        return ids, np.repeat(np.arange(len(texts)), lengths)

    def _hash_new(self) -> None:
        grams, sizes = hashed(self.new)
        if self.only is not None:
            kept = self.only[grams]
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes))
            grams = grams[kept]
        self.grams, self.sizes = np.append(self.grams, grams.astype(np.int32)), np.append(self.sizes, sizes)
        self.new = []


def grams_in(texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The grams of texts and the text of each, in order of the texts; with repeats."""
    ids, text = words.places(texts)
    sizes = words.sizes[ids]
    at, of = _spread((np.cumsum(words.sizes) - words.sizes)[ids], sizes)
    return words.grams[at], text[of]


def distinct_grams(texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """``grams_in``, each gram of a text once, ascending."""
    grams, text = grams_in(texts, words)
    pairs = np.unique((text << HASH_BITS) | grams)
    return pairs & ((1 << HASH_BITS) - 1), pairs >> HASH_BITS


def _mask(grams: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << HASH_BITS, bool)
    out[grams] = True
    return out


@dataclass
class Model:
    """Grams that have a weight, ascending, and their weights; score = 1 / (1 + exp(-(bias + the weights of a text's grams)))."""

    bias: float = -np.inf
    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))


def risk_gradient(z: np.ndarray, toxic: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk at the outputs ``z`` under the logistic loss, and the step's gradient by ``z``."""
    as_toxic, as_clean = np.logaddexp(0, -z), np.logaddexp(0, z)  # loss if called toxic, if called clean
    p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    n_toxic, n_free = max(1, toxic.sum()), max(1, (~toxic).sum())
    clean_risk = as_clean[~toxic].sum() / n_free - prior * as_clean[toxic].sum() / n_toxic
    by_clean = np.where(toxic, -prior * p / n_toxic, p / n_free)
    if clean_risk < 0:
        return prior * as_toxic[toxic].sum() / n_toxic, -by_clean
    return prior * as_toxic[toxic].sum() / n_toxic + clean_risk, by_clean + np.where(toxic, prior * (p - 1) / n_toxic, 0)


@dataclass
class Examples:
    """The training rows: ``is_toxic, doc_id, text``, one for each id; a confirmed one counts as toxic and as unlabelled."""

    rows: DataFrame
    counts: DataFrame  # gram (-1: all documents), toxic, free
    n_toxic: int
    n_free: int

    def __len__(self) -> int:
        return self.n_toxic + self.n_free


def fit(examples: Examples, prior: float, steps: int = ROUNDS * ROUND_STEPS, rate: float = 0.05, l1: float = 1e-4) -> Model:
    n_toxic, n_free = examples.n_toxic, examples.n_free
    if not n_toxic:
        return Model()
    grams = _screened(examples)
    shards = _shards(examples, grams)
    spark = shards.sparkSession
    w, m, v = (np.zeros(len(grams) + 1) for _ in range(3))  # the last is the bias
    w[-1] = np.log(prior / (1 - prior))
    for first in range(0, steps, ROUND_STEPS):
        common = spark.sparkContext.broadcast((w, m, v))
        last = min(steps, first + ROUND_STEPS)
        moved = shards.groupBy("block").applyInArrow(_steps(common, first, last, prior, n_toxic, n_free, rate, l1), _STATE)
        mean = moved.groupBy("part").applyInArrow(_mean, "part int, state binary").toArrow().to_pylist()
        common.destroy()
        w, m, v = np.concatenate([np.frombuffer(r["state"]).reshape(3, -1) for r in sorted(mean, key=lambda r: r["part"])], axis=1)
    common = spark.sparkContext.broadcast(w)
    outputs = materialize(shards.select("grams").mapInArrow(_outputs(common), "z double"))
    w = w + np.append(np.zeros(len(grams)), shift_to_prior(outputs, prior))
    used = np.flatnonzero(w[:-1])
    return Model(float(w[-1]), grams[used], w[used])


def _screened(examples: Examples) -> np.ndarray:
    """The grams whose shares differ by ``SCREEN`` standard errors; no more than there are hashed grams."""
    n_toxic, n_free = examples.n_toxic, max(1, examples.n_free)
    in_toxic, in_free = F.col("toxic") / n_toxic, F.col("free") / n_free
    error = F.sqrt((in_free * (1 - in_free) + 1 / n_free) * (1 / n_toxic + 1 / n_free))
    # with Yates' continuity correction: one document more or less must not decide, which matters for few examples only
    differs = F.abs(in_toxic - in_free) - 0.5 * (1 / n_toxic + 1 / n_free) > SCREEN * error
    found = examples.counts.where("gram >= 0").where(differs).select("gram").toArrow()
    return np.sort(found.column("gram").to_numpy().astype(np.int32))


def _shards(examples: Examples, grams: np.ndarray) -> DataFrame:
    """``block, at, is_toxic, grams``: the places of each row's screened grams, bucketed by shard."""
    spark = examples.rows.sparkSession
    shared = spark.sparkContext.broadcast(grams)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        words, place = Words(_mask(shared.value)), np.zeros(1 << HASH_BITS, np.int32)
        place[shared.value] = np.arange(len(shared.value))
        for batch in _slices(batches):
            found, row = distinct_grams(batch.column("text").to_pylist(), words)
            data, ends = _gaps(place[found], row, batch.num_rows)
            kept = [batch.column(c) for c in ("block", "at", "is_toxic")]
            out = pa.array([data[a:b] for a, b in zip([0, *ends], ends, strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([*kept, out], names=["block", "at", "is_toxic", "grams"])

    at, shards = F.xxhash64("doc_id"), max(1, -(-examples.n_free // SHARD_ROWS))
    dealt = examples.rows.select(F.pmod(at, F.lit(shards)).cast("bigint").alias("block"), at.alias("at"), "is_toxic", "text")
    encoded = dealt.mapInArrow(run, "block bigint, at bigint, is_toxic boolean, grams binary")
    # a shard is one file, so a task that writes does not leave one for each of them
    return bl.save(encoded.repartition(bl.buckets(spark), "block"), "shards")


_STATE = "part int, block bigint, n bigint, state binary"


def _gaps(places: np.ndarray, row: np.ndarray, rows: int) -> tuple[bytes, list[int]]:
    """The ascending places of each row as gaps, seven bits a byte and the eighth on a gap's last, and where each row ends."""
    first = np.diff(row, prepend=-1) != 0
    gaps = np.where(first, places, np.diff(places, prepend=0))
    width = 1 + (gaps >= 1 << 7) + (gaps >= 1 << 14) + (gaps >= 1 << 21)
    ends = np.cumsum(width)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(4):
        at = np.flatnonzero(width > k)
        out[ends[at] - width[at] + k] = ((gaps[at] >> 7 * k) & 0x7F) | np.where(width[at] == k + 1, 0x80, 0)
    return out.tobytes(), np.append(0, ends)[np.searchsorted(row, np.arange(rows), "right")].tolist()


def _sparse(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All places, and the row of each; from ``_gaps``."""
    raw = column.to_pylist()
    data = np.frombuffer(b"".join(raw), np.uint8)
    last = np.flatnonzero(data & 0x80)
    starts = np.append(0, last + 1)[: len(last)]
    gaps = np.zeros(len(last), np.int32)
    for k in range(4):
        at = np.flatnonzero(last - starts >= k)
        gaps[at] |= (data[starts[at] + k].astype(np.int32) & 0x7F) << 7 * k
    row = np.repeat(np.arange(len(raw)), np.diff(np.searchsorted(last, np.append(0, np.cumsum([len(r) for r in raw])))))
    total = np.cumsum(gaps, dtype=np.int64)
    begins = np.flatnonzero(np.diff(row, prepend=-1))
    sizes = np.diff(np.append(begins, len(row)))
    return (total - np.repeat(total[begins] - gaps[begins], sizes)).astype(np.int32), row


def _steps(common, first: int, last: int, prior: float, n_toxic: int, n_free: int, rate: float, l1: float):
    """Steps ``first`` to ``last`` of Adam on one shard, from the common weights; its state in parts of the grams."""

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("at")
        read = [_sparse(shard.column("grams").slice(i, BATCH_ROWS)) for i in range(0, len(shard), BATCH_ROWS)]
        flat = np.concatenate([places for places, _ in read])
        sizes = np.concatenate([np.bincount(row, minlength=BATCH_ROWS) for _, row in read])[: len(shard)]
        starts = np.append(0, np.cumsum(sizes))
        del read
        marked = np.flatnonzero(shard.column("is_toxic").to_numpy(zero_copy_only=False))
        # by this the toxic rows of all shards weigh the same
        share = prior * len(marked) / n_toxic * n_free / len(shard)
        # few shards take larger batches: a step of all of them sees no fewer rows than one shard has
        free_batches = max(1, len(shard) // max(BATCH_ROWS, SHARD_ROWS // -(-n_free // SHARD_ROWS)))
        toxic_batches = max(1, min(free_batches, len(marked) // BATCH_TOXIC))
        w, m, v = (x.copy() for x in common.value)
        for step in range(first + 1, last + 1):
            confirmed = marked[step % toxic_batches :: toxic_batches]
            rows = np.concatenate([confirmed, np.arange(step % free_batches, len(shard), free_batches)])
            toxic = np.arange(len(rows)) < len(confirmed)
            at, of = _spread(starts[rows], starts[rows + 1] - starts[rows])
            at = flat[at]
            z = np.bincount(of, w[at], len(rows)) + w[-1]
            _, by_z = risk_gradient(z, toxic, share)
            gradient = np.append(np.bincount(at, by_z[of], len(w) - 1), by_z.sum())
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            scale = rate / (np.sqrt(v / (1 - 0.999**step)) + 1e-4)
            w = w - scale * m / (1 - 0.9**step)
            w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - scale[:-1] * l1, 0)
        state, block = np.stack([w, m, v]), shard.column("block")[0].as_py()
        out = [(i // _PART, block, len(shard), state[:, i : i + _PART].tobytes()) for i in range(0, len(w), _PART)]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        return pa.table(columns, names=["part", "block", "n", "state"])

    return run


def _mean(states: pa.Table) -> pa.Table:
    """The mean of one part over the shards, by their rows."""
    rows = states.sort_by("block").to_pylist()
    total = sum(r["n"] for r in rows)
    mean = np.sum([np.frombuffer(r["state"]) * (r["n"] / total) for r in rows], axis=0)
    return pa.table({"part": pa.array([rows[0]["part"]], pa.int32()), "state": pa.array([mean.tobytes()], pa.binary())})


def _outputs(common):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = common.value
        for batch in batches:
            at, of = _sparse(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.bincount(of, w[at], batch.num_rows) + w[-1])], names=["z"])

    return run


def shift_to_prior(outputs: DataFrame, prior: float) -> float:
    """What to add to the outputs ``z`` of unlabelled text for a mean score of ``prior``."""
    low, high = -50.0, 50.0
    for _ in range(6):
        shifts = np.linspace(low, high, CUTS + 2).tolist()
        means = outputs.agg(*[F.avg(1 / (1 + F.exp(-F.greatest(F.least(F.col("z") + s, F.lit(60.0)), F.lit(-60.0))))) for s in shifts[1:-1]]).first()
        at = sum(x <= prior for x in means)  # the means rise with the shift
        low, high = shifts[at], shifts[at + 1]
    return (low + high) / 2


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(i, _AT_ONCE) for i in range(0, batch.num_rows, _AT_ONCE))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``gram, toxic, free`` of a task's rows: how many toxic and how many documents hold the gram; gram -1 for all of them."""
    let_go()
    toxic, free = (np.zeros(1 << HASH_BITS, np.int32) for _ in range(2))
    n_toxic = n_free = 0
    words = Words()
    for batch in _slices(batches):
        grams, row = grams_in(batch.column("text").to_pylist(), words)
        each = np.split(grams, np.searchsorted(row, np.arange(1, batch.num_rows)))
        for of_text, is_toxic in zip(each, batch.column("is_toxic").to_pylist(), strict=True):
            free[of_text] += 1  # a place that repeats in the index is raised once
            n_free += 1
            if is_toxic:
                toxic[of_text] += 1
                n_toxic += 1
    met = np.flatnonzero(free).astype(np.int32)
    columns = (np.append(met, -1), np.append(toxic[met], n_toxic), np.append(free[met], n_free))
    for i in range(0, len(met) + 1, 1 << 16):
        part = [pa.array(c[i : i + (1 << 16)], t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)]
        yield pa.RecordBatch.from_arrays(part, names=["gram", "toxic", "free"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on every document of the training folds.

    The prior is the share of ``toxic`` in the labels of those folds, with one toxic and nine clean ones more, so that a
    handful of labels does not call everything toxic.
    """
    ensure_defaults(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("bigint"), "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    seen, marked = known.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    if not marked:
        return Model()
    # written, so that small ones are sent to the documents and the documents stay where they are
    confirmed = materialize(known.where("toxic = 1").select("doc_id").distinct().withColumn("is_toxic", F.lit(True)))
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    free = texts.where("doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    repeated = materialize(free.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    once = free if repeated.isEmpty() else free.join(repeated, "doc_id", "left_anti").unionByName(
        free.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))
    rows = once.join(confirmed, "doc_id", "left").select("doc_id", F.col("is_toxic").isNotNull().alias("is_toxic"), "text")
    tasks = rows.select("is_toxic", "text").mapInArrow(_count, "gram int, toxic bigint, free bigint")
    counts = materialize(tasks.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("free").alias("free")))
    n_toxic, n_free = counts.where("gram = -1").agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("free"), F.lit(0))).first()
    return fit(Examples(rows, counts, n_toxic, n_free), (marked + 1) / (seen + 10))


def score(text: Column, model: Model, spark) -> Column:
    """The score of a text column, 0 to 1."""
    shared = spark.sparkContext.broadcast(model)  # the weights that are not zero: no more than the hashed grams

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        let_go()
        model, weights = shared.value, np.zeros(1 << HASH_BITS)
        words = Words(_mask(model.grams))
        weights[model.grams] = model.weights
        for texts in batches:
            z = np.full(len(texts), model.bias)
            for i in range(0, len(texts), _AT_ONCE):
                grams, row = distinct_grams(texts.iloc[i : i + _AT_ONCE].tolist(), words)
                part = z[i : i + _AT_ONCE]
                part += np.bincount(row, weights[grams], len(part))
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -700, 700))) * np.isfinite(z))

    return run(text)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row for each row of ``docs``."""
    value = score(F.col("text").cast("string"), train(docs, labels), docs.sparkSession)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), value.alias("score")).select(
        "*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not call toxic."""
    return docs.where(score(F.col("text").cast("string"), train(docs, labels), docs.sparkSession) < THRESHOLD)

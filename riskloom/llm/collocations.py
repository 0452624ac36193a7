"""Phrase collocation mining over sorted occurrence relations (SETM).

R(k), the occurrences of frequent phrases of k words, is a written table of ``(block, pos, gram)``: a block of documents
holds its part as two arrays sorted by place, with a gap in the places between pieces. So the merge-join of R(k) with itself
by piece and adjacent position pairs neighbours whose places differ by one, and never crosses a piece. Each length then

1. merge-joins R(k) into pairs ``(left, right)`` of grams of k words that overlap in k - 1, which name a gram of k + 1 words,
   and sends each owner (by a hash of the pair) one message: the block's distinct pairs there with their counts, packed;
2. group-counts the pairs at their owner and writes the frequent ones, numbered, as C(k + 1);
3. semi-joins: the owner answers each message with the numbers of its frequent pairs, the answers meet their blocks, and
   what is left is written as R(k + 1).

Words, as grams of one word, are exchanged in the same way. R tables are bucketed by block, so only messages and answers
move, and a word or pair that holds a third of all occurrences sends one entry for each block. The number of owners follows
the number of entries. C(k) carries the counts of all beginnings and ends of its phrases, so scores need no further search.

Occurrences of a phrase of which a part is not frequent need not be kept: no phrase is more frequent than its parts.

Words and pieces: A-Z lower-cased; pieces end at ``. , ; : ! ?`` and line breaks, words at spaces and tabs. Everything is
counted for each language on its own; a null language is ``und``. Null and empty texts have no words. Repeated rows count
each time; ids and other columns are ignored. An empty table gives an empty result. A text is never cut: a block holds one
at least, however long.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import ensure_defaults
from ..sources.sinks import materialize
from . import blocks as bl

LEAST = 100
LONGEST = 5
SHARE = 100  # percent of a phrase's occurrences that lie in one longer phrase, from which on it is dropped
BLOCK_BYTES = 8 << 20
AT_ONCE = 2 << 20

_BREAK = b"\n"
_NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x0A if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 0x09 else b for b in range(256)
)
_GAP = 0

OWNER_ENTRIES = 1 << 22

_TEXTS = (
    "block bigint, langs array<string>, n array<bigint>, n_words bigint, words binary, word_lang binary, word_n binary, seq binary"
)
_RELATION = "block bigint, rows bigint, pos binary, gram binary"
_WORDS_SENT = "owner bigint, block bigint, lang string, words binary, n binary"
_PAIRS_SENT = "owner bigint, block bigint, pairs binary"
#: from an owner: answers (``block``; places in its message and numbers of what is frequent there) and frequent grams
_ANSWERED = "owner bigint, block bigint, lang string, numbers binary, gram bigint, a bigint"
_WORDS_COUNTED = _ANSWERED + ", spelled string"
_PAIRS_COUNTED = _ANSWERED + ", `left` bigint, `right` bigint"


def _portions(texts: list[bytes]) -> Iterator[bytes]:
    """Normalised texts with a break between them, a few megabytes at once."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= AT_ONCE:
            yield _BREAK.join(part).translate(_NORMAL)
            part, size = [], 0
    if part:
        yield _BREAK.join(part).translate(_NORMAL)


def _numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words, and each place's word number or a gap."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    nothing, end = numbers[b""], numbers[_BREAK]
    seq = []
    for text in _portions(texts):
        tokens = text.replace(_BREAK, b" \n ").split(b" ")
        found = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
        seq += [found[found != nothing], np.array([end], np.int32)]
    return list(numbers)[2:], np.concatenate(seq) - 2  # the end of a piece becomes -1


def _read(buckets: int, block_bytes: int):
    def block(number: int, texts: dict[str, list[bytes]]) -> pa.RecordBatch:
        words, word_lang, word_n, n, seqs = [], [], [], [], []
        for i, own in enumerate(texts.values()):
            distinct, seq = _numbered(own)
            inside = seq >= 0
            word_n.append(np.bincount(seq[inside], minlength=len(distinct)))
            n.append(int(inside.sum()))
            seqs.append(np.where(inside, seq + len(words) + 1, _GAP))
            words += distinct
            word_lang.append(np.full(len(distinct), i, np.int32))

        def listed(values, kind):
            values = pa.array(values, kind)
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        import zstandard

        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                listed(list(texts), pa.string()),
                listed(n, pa.int64()),
                pa.array([len(words)], pa.int64()),
                pa.array([zstandard.ZstdCompressor(level=3).compress(_BREAK.join(words))], pa.binary()),
                pa.array([_packed(np.concatenate(word_lang))], pa.binary()),
                pa.array([_packed(np.concatenate(word_n))], pa.binary()),
                pa.array([_packed(np.concatenate(seqs))], pa.binary()),
            ],
            names=["block", "langs", "n", "n_words", "words", "word_lang", "word_n", "seq"],
        )

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = bl.block_ids(TaskContext.get().partitionId(), buckets)
        texts, size = defaultdict(list), 0
        for batch in batches:
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py()
                texts[lang].append(text)
                size += len(text)
                if size >= block_bytes:
                    yield block(next(numbers), texts)
                    texts, size = defaultdict(list), 0
        if texts:
            yield block(next(numbers), texts)

    return read


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length and without negative values, in as few bytes each as their largest value needs, compressed.

    The lowest bytes of all values come first, then the next ones: high bytes are mostly alike.
    """
    import zstandard

    parts = [len(arrays[0]).to_bytes(8, "little")]
    for x in arrays:
        width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
        parts += [bytes([width]), np.ascontiguousarray(_bytes_of(x)[:, :width].T).tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _bytes_of(x: np.ndarray) -> np.ndarray:
    return x.astype("<i8").view(np.uint8).reshape(-1, 8)


def _unpacked(data: bytes) -> list[np.ndarray]:
    raw = bl.unpacked(data)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    while at < len(raw):
        width, x = raw[at], np.zeros((n, 8), np.uint8)
        x[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 1).reshape(width, n).T
        out.append(x.view("<i8").ravel().astype(np.int64))
        at += 1 + n * width
    return out


def _batch(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values(), strict=True)], names=list(schema))


_LONG, _BYTES, _TEXT = pa.int64(), pa.binary(), pa.string()
_RELATION_ROW = {"block": _LONG, "rows": _LONG, "pos": _BYTES, "gram": _BYTES}


def _relation(block: int, pos: np.ndarray, gram: np.ndarray) -> tuple:
    return block, len(pos), _packed(np.diff(pos, prepend=0)), _packed(gram)


def _relations(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for block, pos, gram in zip(*(batch.column(c) for c in ("block", "pos", "gram")), strict=True):
        yield block.as_py(), np.cumsum(_unpacked(pos.as_py())[0]), _unpacked(gram.as_py())[0]


def _word_owners(words: list[bytes], owners: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % owners


def _answer(numbers: np.ndarray) -> bytes:
    """The entries of a message that have a number: places, then numbers."""
    places = np.flatnonzero(numbers)
    return _packed(np.diff(places, prepend=0), numbers[places])


def _put(numbers: np.ndarray, sent: np.ndarray, answer: bytes) -> None:
    gaps, found = _unpacked(answer)
    numbers[sent[np.cumsum(gaps)]] = found


def _by_owner(owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each owner and the places of its entries, in order."""
    order = np.argsort(owner, kind="stable")
    starts = np.flatnonzero(np.diff(owner[order], prepend=-1))
    for places in np.split(order, starts[1:]) if len(order) else ():
        yield int(owner[places[0]]), places


def _words_of(row: dict[str, pa.Scalar]) -> tuple[list[bytes], np.ndarray]:
    word_lang = _unpacked(row["word_lang"].as_py())[0]
    return bl.unpacked(row["words"].as_py()).split(_BREAK) if len(word_lang) else [], word_lang


def _send_words(owners: int):
    schema = {"owner": _LONG, "block": _LONG, "lang": _TEXT, "words": _BYTES, "n": _BYTES}

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                words, word_lang = _words_of(row)
                owner, n, out = _word_owners(words, owners), _unpacked(row["word_n"].as_py())[0], []
                for k, lang in enumerate(row["langs"].as_py()):
                    own = np.flatnonzero(word_lang == k)
                    for o, places in _by_owner(owner[own]):
                        sent = own[places]
                        blob = zip_.compress(_BREAK.join([words[j] for j in sent.tolist()]))
                        out.append((o, row["block"].as_py(), lang, blob, _packed(n[sent])))
                yield _batch(schema, out)

    return send


def _count_words(least: int, owners: int):
    schema = {"owner": _LONG, "block": _LONG, "lang": _TEXT, "numbers": _BYTES, "gram": _LONG, "a": _LONG, "spelled": _BYTES}

    def count_words(messages: pa.Table) -> pa.Table:
        owner, rows = messages.column("owner")[0].as_py(), messages.drop_columns(["owner"])
        total: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(int))
        for row in (r for b in rows.to_batches(max_chunksize=64) for r in b.to_pylist()):
            own = total[row["lang"]]
            for word, n in zip(bl.unpacked(row["words"]).split(_BREAK), _unpacked(row["n"])[0].tolist(), strict=True):
                own[word] += n
        frequent = sorted((lang, word) for lang, own in total.items() for word, n in own.items() if n >= least)
        out = [(owner, None, lang, None, i * owners + owner, total[lang][word], word) for i, (lang, word) in enumerate(frequent)]
        numbers: dict[str, dict[bytes, int]] = defaultdict(dict)
        for _, _, lang, _, gram, _, word in out:
            numbers[lang][word] = gram + 1
        for row in (r for b in rows.to_batches(max_chunksize=64) for r in b.to_pylist()):
            words, own = bl.unpacked(row["words"]).split(_BREAK), numbers[row["lang"]]
            found = np.fromiter(map(own.get, words, repeat(0)), np.int64, len(words))
            if found.any():
                out.append((owner, row["block"], row["lang"], _answer(found), None, None, None))
        table = pa.Table.from_batches([_batch(schema, out)])
        return table.set_column(6, "spelled", table.column("spelled").cast(_TEXT))

    return count_words


def _first(owners: int):
    """R(1): the places of frequent words."""

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                words, word_lang = _words_of(row)
                owner, langs = _word_owners(words, owners), {x: k for k, x in enumerate(row["langs"].as_py())}
                number = np.zeros(len(words) + 1, np.int64)  # the first one is read at gaps
                of_lang: dict[int, dict[int, np.ndarray]] = {}
                for a in row["answers"].as_py():
                    k = langs[a["lang"]]
                    if k not in of_lang:
                        own = np.flatnonzero(word_lang == k)
                        of_lang[k] = {o: own[places] for o, places in _by_owner(owner[own])}
                    _put(number, of_lang[k][a["owner"]] + 1, a["numbers"])
                grams = number[_unpacked(row["seq"].as_py())[0]]
                pos = np.flatnonzero(grams)
                yield _batch(_RELATION_ROW, [_relation(row["block"].as_py(), pos, grams[pos] - 1)])

    return first


class _Pairs:
    """The merge-join of a relation with itself by adjacent place: its distinct pairs, sorted, and each one's owner."""

    def __init__(self, pos: np.ndarray, gram: np.ndarray, owners: int):
        self.at = np.flatnonzero(np.diff(pos) == 1)  # the left one's row
        grams, numbers = np.unique(gram, return_inverse=True)
        codes = numbers[self.at] * max(1, len(grams)) + numbers[self.at + 1]
        pairs, self.pair_of, self.n = np.unique(codes, return_inverse=True, return_counts=True)
        self.left, self.right = grams[pairs // max(1, len(grams))], grams[pairs % max(1, len(grams))]
        mixed = (self.left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (self.right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        self.owner = ((mixed >> np.uint64(32)) % np.uint64(owners)).astype(np.int64)


def _send_pairs(owners: int):
    schema = {"owner": _LONG, "block": _LONG, "pairs": _BYTES}

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pos, gram in _relations(batch):
                p = _Pairs(pos, gram, owners)
                yield _batch(
                    schema,
                    [(o, block, _packed(np.diff(p.left[own], prepend=0), p.right[own], p.n[own])) for o, own in _by_owner(p.owner)],
                )

    return send


def _count_pairs(least: int, owners: int):
    answer = {"owner": _LONG, "block": _LONG, "numbers": _BYTES}
    schema = answer | {"lang": _TEXT, "gram": _LONG, "a": _LONG, "left": _LONG, "right": _LONG}

    def count_pairs(messages: pa.Table) -> pa.Table:
        owner, blocks = messages.column("owner")[0].as_py(), messages.column("block").to_pylist()
        sent = [_unpacked(m.as_py()) for m in messages.column("pairs")]
        left = np.concatenate([np.cumsum(m[0]) for m in sent])
        right, n = (np.concatenate([m[i] for m in sent]) for i in (1, 2))
        order = np.lexsort((right, left))
        new = (np.diff(left[order], prepend=-1) != 0) | (np.diff(right[order], prepend=-1) != 0)
        first = np.flatnonzero(new)
        total = np.add.reduceat(n[order], first)
        gram = np.where(total >= least, (np.cumsum(total >= least) - 1) * owners + owner, -1)
        numbers = np.empty(len(left), np.int64)
        numbers[order] = gram[np.cumsum(new) - 1] + 1
        ends = np.cumsum([len(m[0]) for m in sent])[:-1]
        answers = [(owner, b, _answer(x)) for b, x in zip(blocks, np.split(numbers, ends), strict=True) if x.any()]
        kept = np.flatnonzero(gram >= 0)
        columns = {"gram": gram[kept], "a": total[kept], "left": left[order[first[kept]]], "right": right[order[first[kept]]]}
        columns |= {"owner": np.full(len(kept), owner)}
        found = [pa.array(columns[c], t) if c in columns else pa.nulls(len(kept), t) for c, t in schema.items()]
        replies = pa.Table.from_batches([_batch(answer, answers)])
        for c, t in list(schema.items())[3:]:
            replies = replies.append_column(c, pa.nulls(len(answers), t))
        return pa.concat_tables([replies, pa.table(dict(zip(schema, found, strict=True)))])

    return count_pairs


def _next(owners: int):
    """R(k + 1): the pairs of R(k) that are frequent, at the left one's place."""

    def extend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (block, pos, gram), answers in zip(_relations(batch), batch.column("answers"), strict=True):
                p = _Pairs(pos, gram, owners)
                number, own = np.zeros(len(p.left), np.int64), dict(_by_owner(p.owner))
                for a in answers.as_py():
                    _put(number, own[a["owner"]], a["numbers"])
                longer = number[p.pair_of]
                found = np.flatnonzero(longer)
                yield _batch(_RELATION_ROW, [_relation(block, pos[p.at[found]], longer[found] - 1)])

    return extend


def _answered(table: DataFrame, counted: DataFrame, *names: str, step: Callable) -> DataFrame:
    """The blocks that have answers, run through ``step`` and written."""
    rows = bl.answered(table, counted.where("block IS NOT NULL"), *names).where("answers IS NOT NULL")
    return bl.save(rows.mapInArrow(step, _RELATION), "relation")


def _entries(column: Column, table: DataFrame) -> int:
    return table.agg(F.sum(column)).first()[0] or 0


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``lang, words, a, cut, l, r, n, score`` of each phrase of 2 to ``longest`` words with ``least`` occurrences that no longer phrase holds.

    ``a``: occurrences; ``l``, ``r``: those of its first ``cut`` words and of the rest, at the cut of lowest
    score ``floor(1000 a n / (l r))``; ``n``: all words of the language.
    """
    spark = ensure_defaults(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    table = bl.save(texts.mapInArrow(_read(bl.buckets(spark), block_bytes), _TEXTS), "occurrences")
    totals = (
        table.select(F.explode(F.arrays_zip("langs", "n")).alias("t")).groupBy(F.col("t.langs").alias("lang")).agg(F.sum("t.n").alias("n"))
    )
    owners = max(bl.buckets(spark), -(-_entries(F.col("n_words"), table) // OWNER_ENTRIES))
    sent = table.select("block", "langs", "words", "word_lang", "word_n").mapInArrow(_send_words(owners), _WORDS_SENT)
    counted = materialize(sent.groupBy("owner").applyInArrow(_count_words(least, owners), _WORDS_COUNTED))
    grams = counted.where("gram IS NOT NULL").select(
        "gram", "lang", F.array("spelled").alias("words"), "a", F.array("a").alias("begins"), F.array("a").alias("ends")
    )
    relation = _answered(table.select("block", "langs", "words", "word_lang", "seq"), counted, "lang", "owner", "numbers", step=_first(owners))
    levels = []
    for size in range(2, longest + 1):
        owners = max(bl.buckets(spark), -(-_entries(F.col("rows"), relation) // OWNER_ENTRIES))
        sent = relation.mapInArrow(_send_pairs(owners), _PAIRS_SENT)
        counted = materialize(sent.groupBy("owner").applyInArrow(_count_pairs(least, owners), _PAIRS_COUNTED))
        before = grams.select(F.col("gram").alias("left"), "lang", "words", "begins")
        after = grams.select(F.col("gram").alias("right"), "ends", F.element_at("words", -1).alias("last"))
        longer = counted.where("gram IS NOT NULL").drop("lang").join(before, "left").join(after, "right")
        grams = materialize(
            longer.select(
                "gram", "lang", "left", "right", "a",
                F.concat("words", F.array("last")).alias("words"),
                F.concat("begins", F.array("a")).alias("begins"),
                F.concat("ends", F.array("a")).alias("ends"),
            )
        )
        levels.append(grams)
        if size < longest:
            relation = _answered(relation, counted, "owner", "numbers", step=_next(owners))
    kept = [_not_inside(c, longer, share) for c, longer in zip(levels, [*levels[1:], None], strict=True)]
    found = kept[0]
    for more in kept[1:]:
        found = found.unionByName(more)
    return _scored(found.join(totals, "lang"))


def _not_inside(grams: DataFrame, longer: DataFrame | None, share: int) -> DataFrame:
    """Grams of which no longer frequent one holds ``share`` percent: one word longer is enough, as still longer ones are no more frequent."""
    grams = grams.select("lang", "words", "a", "begins", "ends", "gram")
    if longer is not None:
        most = longer.select(F.explode(F.array("left", "right")).alias("gram"), F.col("a").alias("more"))
        most = most.groupBy("gram").agg(F.max("more").alias("more"))
        grams = grams.join(most, "gram", "left").where(F.col("more").isNull() | (100 * F.col("more") < share * F.col("a"))).drop("more")
    return grams.drop("gram")


def _exact(value: Column, digits: int) -> Column:
    return value.cast(f"decimal({digits},0)")


def _scored(grams: DataFrame) -> DataFrame:
    """The lowest score of all cuts, ties to the first; products in decimals of 38 digits (a and n below 10^16)."""
    size = F.size("words")

    def cut(k: Column) -> Column:
        left, right = F.get("begins", k - 1), F.get("ends", size - k - 1)
        above = _exact(F.lit(1000), 4) * _exact(F.col("a"), 16) * _exact(F.col("n"), 16)
        score = F.call_function("div", above, _exact(left, 18) * _exact(right, 18))
        return F.struct(score.alias("score"), k.alias("cut"), left.alias("l"), right.alias("r"))

    best = F.array_min(F.transform(F.sequence(F.lit(1), size - 1), cut))
    return grams.withColumn("best", best).select("lang", "words", "a", "best.cut", "best.l", "best.r", "n", "best.score")


def ranked(found: DataFrame, first: int) -> DataFrame:
    """``rank`` and ``phrase``: each language's ``first`` phrases by score, occurrences and spelling."""
    found = found.withColumn("phrase", F.array_join("words", " "))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first).withColumn("rank", F.col("rank").cast("bigint"))

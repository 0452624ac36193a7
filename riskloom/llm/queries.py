"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import byte_bpe, packing, pii, secret_scan, toxicity
from .chunk_dedup import chunk_dedup
from .collocations import collocations, ranked
from .decontamination import decontaminate
from .embedding_dedup import embedding_dedup
from .exact_dedup import exact_dedup
from .simhash_dedup import simhash_dedup
from .spelling_variants import spelling_variants
from .suffix_dedup import suffix_dedup


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose something."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return chunk_dedup(_documents(spark, sf_dir), with_text=False).where("size(spans) > 0").select(
        "doc_id",
        "n_bytes",
        "n_chunks",
        "n_dup_chunks",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        "first_doc_ids",
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir).select("doc_id", "text"))


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
"""



def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(_documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.secret_scan(_documents(spark, sf_dir)))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(_documents(spark, sf_dir), path, public_tokenizers.PATTERN, with_decoded=True)
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(_documents(spark, sf_dir)))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


# links by comparing all valid vectors; components by reaching out along the links
OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT a AS vec_id, b AS other FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), comp AS (SELECT vec_id, min(other) AS least FROM reach GROUP BY vec_id),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, least(v.vec_id, coalesce(c.least, v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce(c.least, v.vec_id)) AS kept
FROM v LEFT JOIN comp c USING (vec_id) LEFT JOIN degree d USING (vec_id)
"""


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup(_documents(spark, sf_dir))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


# all windows of 50 bytes as hexadecimal text; pages only keep substr from walking long texts again and again
OP9_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), pages AS (
  SELECT doc_id, n, k, substr(h, 1000 * k + 1, 1098) AS page FROM (SELECT *, unnest(generate_series(0, (n - 1) // 500)) AS k FROM d WHERE n > 0)
), bytes AS (
  SELECT doc_id, n, 500 * k + j AS p, substr(page, 2 * j + 1, 100) AS win
  FROM (SELECT *, unnest(generate_series(0, least(499, n - 1 - 500 * k))) AS j FROM pages)
), w AS (
  SELECT doc_id, p AS s, win FROM bytes WHERE p <= n - 50
), firsts AS (SELECT win, min(doc_id) AS least FROM w GROUP BY win),
hit AS (SELECT w.doc_id, w.s FROM w JOIN firsts USING (win) WHERE least < w.doc_id),
b AS (SELECT doc_id, p, substr(win, 1, 2) AS x FROM bytes), covered AS (
  SELECT b.doc_id, b.p, b.x,
    coalesce(max(hit.s) OVER (PARTITION BY b.doc_id ORDER BY b.p) >= b.p - 49, false) AS gone
  FROM b LEFT JOIN hit ON b.doc_id = hit.doc_id AND b.p = hit.s
), edges AS (
  SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY p) AS begins FROM covered
), cut AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans,
    coalesce(string_agg(x, '' ORDER BY p) FILTER (WHERE NOT gone), '') AS kept
  FROM edges GROUP BY doc_id
)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, coalesce(c.n_removed, 0) AS n_removed, coalesce(c.n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(c.kept, ''))) AS kept_sha256
FROM d LEFT JOIN cut c USING (doc_id)
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.with_checksum(pieces)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


# windows of each length that the items have, joined whole; a word is hit if a window that occurs begins less than its length before
OP11_SQL = r"""
WITH lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), d AS (
  SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), cut AS (
  SELECT item_id, w, least(10, len(w)) AS size, unnest(generate_series(1, greatest(1, len(w) - 9))) AS p FROM items WHERE len(w) > 0
), windows AS (SELECT DISTINCT item_id, size, array_to_string(w[p:p + size - 1], ' ') AS win FROM cut
), sizes AS (SELECT DISTINCT size FROM windows
), places AS (
  SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS p FROM d JOIN sizes ON len(w) >= size
), found AS (
  SELECT places.doc_id, places.p, places.size, windows.item_id
  FROM places JOIN windows ON places.size = windows.size AND array_to_string(w[p:p + places.size - 1], ' ') = windows.win
), hit AS (
  SELECT doc_id, count(DISTINCT p + j) AS n_hit
  FROM (SELECT doc_id, p, unnest(generate_series(0, size - 1)) AS j FROM (SELECT DISTINCT doc_id, p, size FROM found)) GROUP BY doc_id
), of_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit h USING (doc_id) LEFT JOIN of_items i USING (doc_id)
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ranked(collocations(_documents(spark, sf_dir)), 2000)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP12_SQL = r"""
WITH pieces AS (
  SELECT doc_id, lang, unnest(range(len(p))) AS k, unnest(p) AS piece FROM (
    SELECT row_number() OVER () AS doc_id, coalesce(lang, 'und') AS lang, regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p
    FROM documents)
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), starts AS (
  SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(w) >= size
), f AS (
  SELECT lang, size, array_to_string(w[p:p + size - 1], ' ') AS phrase, count(*) AS a FROM starts GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT f.*, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k FROM f WHERE size > 1
), scores AS (
  SELECT c.lang, c.size, c.phrase, c.a, c.k, l.a AS l, r.a AS r, t.n,
    CAST((1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM cuts c JOIN totals t USING (lang)
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:c.k], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.k + 1:], ' ')
), best AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT DISTINCT lang, array_to_string(string_split(phrase, ' ')[s:e], ' ') AS phrase, a
  FROM (SELECT *, unnest(range(s, size + 1)) AS e FROM (SELECT *, unnest(range(1, size + 1)) AS s FROM f WHERE size > 2))
  WHERE e > s AND e - s + 1 < size
), kept AS (
  SELECT b.* FROM best b LEFT JOIN (SELECT lang, phrase, max(a) AS more FROM inside GROUP BY ALL) i USING (lang, phrase)
  WHERE i.more IS NULL OR 100 * i.more < 100 * b.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_documents(spark, sf_dir))


# the checksum byte by byte from its table; near pairs meet in the words without one letter, at its place (replaced) or not (inserted)
OP13_SQL = r"""
WITH RECURSIVE bit AS (
  SELECT list(c ORDER BY i) AS tbl FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\x{C0}-\x{FF}]+')) AS run
  FROM documents
), each AS (
  SELECT run, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL
), bytes AS (
  SELECT run, n, list_transform(range(0, length(h) // 2), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT)) AS b FROM each
), summed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b),
    lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1]))) AS h
  FROM bytes, bit
), cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n
  FROM summed
), words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), less AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN less b ON a.word = b.rest
  UNION SELECT b.word, a.word, a.n FROM words a JOIN less b ON a.word = b.rest
), best AS (
  SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, n AS other_n FROM pairs
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1
), forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form,
    CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), walk AS (
  SELECT word, word AS here FROM forms UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON walk.here = f.word WHERE f.form IS NOT NULL
), roots AS (SELECT walk.word, here AS root FROM walk JOIN forms f ON walk.here = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_pii": op7_pii,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_packing": op10_packing,
    "op11_decontamination": op11_decontamination,
    "op12_collocations": op12_collocations,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES: dict[str, str] = {
    "op3_exact_dedup": OP3_SQL,
    "op8_embedding_dedup": OP8_SQL,
    "op9_suffix_dedup": OP9_SQL,
    "op11_decontamination": OP11_SQL,
    "op12_collocations": OP12_SQL,
    "op13_spelling_variants": OP13_SQL,
}

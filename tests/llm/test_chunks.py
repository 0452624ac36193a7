"""Content-defined chunking: edges, the duplicates against a plain table, planted passages, shifts."""
import random

import numpy as np
import pytest

from riskloom.llm import chunk_dedup as cd
from riskloom.llm import queries


def _rolled(raw):
    h, out = 0, []
    for b in bytes(cd._GAP) + raw:
        h = ((h << 1) + int(cd._GEAR[b])) & 0xFFFF
        out.append(h)
    return out[cd._GAP :]


def plain_chunks(raw):
    h = _rolled(raw)
    cuts = []
    for t in range(len(raw)):
        before = h[max(0, t - cd.REACH) : t]
        after = h[t + 1 : t + 1 + cd.REACH]
        if h[t] > max([0, *before]) and h[t] >= max([0, *after]) and t + 1 > cd.REACH and len(raw) - t - 1 > cd.REACH:
            cuts.append(t + 1)
    edges = [0, *cuts, len(raw)]
    return [(s, min(s + cd.MAX_CHUNK, b)) for a, b in zip(edges, edges[1:]) for s in range(a, b, cd.MAX_CHUNK)]


def brute(rows):
    least = {}
    cut = [(i, raw, plain_chunks(raw)) for i, raw in rows]
    for i, raw, chunks in cut:
        for a, b in chunks:
            if b - a > cd.REACH:
                least[raw[a:b]] = min(i, least.get(raw[a:b], i))
    out = []
    for i, raw, chunks in cut:
        dups = [(a, b) for a, b in chunks if b - a > cd.REACH and least[raw[a:b]] < i]
        spans = []
        for a, b in dups:
            if spans and spans[-1][1] == a:
                spans[-1][1] = b
            else:
                spans.append([a, b])
        spans = [tuple(s) for s in spans if s[1] - s[0] >= cd.MIN_SPAN]
        firsts = sorted({least[raw[a:b]] for a, b in dups if any(s <= a and b <= e for s, e in spans)})
        kept = b"".join(raw[x:y] for x, y in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(raw)]))
        out.append((i, len(raw), len(chunks), len(dups), tuple(spans), tuple(firsts), kept))
    return sorted(out)


def got(df):
    return sorted((r.doc_id, r.n_bytes, r.n_chunks, r.n_dup_chunks, tuple((s.start, s.end) for s in r.spans),
                   tuple(r.first_doc_ids), bytes(r.kept)) for r in df.collect())


@pytest.fixture(scope="module")
def made():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(n) for n in (8, 20, 60, 200)]
    docs = ["", "a", "short text", "a" * 3000, "ab" * 900]
    docs += [" ".join(rng.choice([text(rng.randint(1, 60)), rng.choice(shared)]) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    docs += docs[20:26] + ["x" + docs[30]]
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    return list(zip(ids, docs))


def test_edges_are_those_of_the_rolling_hash(made):
    texts = [d.encode() for _, d in made]
    doc, start, end = cd.chunk_edges(texts)
    for i, raw in enumerate(texts):
        assert list(zip(start[doc == i].tolist(), end[doc == i].tolist())) == (plain_chunks(raw) if raw else [])


@pytest.mark.parametrize("block_bytes", [1 << 22, 900])
def test_duplicates(spark, made, block_bytes):
    docs = spark.createDataFrame([(i, d, "x") for i, d in made], "doc_id long, text string, kept string").repartition(3)
    assert got(cd.chunk_dedup(docs, block_bytes=block_bytes)) == brute([(i, d.encode()) for i, d in made])


def test_odd_rows(spark):
    long = " ".join(f"word{i * i}" for i in range(100))
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, long), (4, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by = {}
    for r in cd.chunk_dedup(docs).collect():
        by.setdefault(r.doc_id, []).append(bytes(r.kept))
    assert by[1] == by[2] == [b""] and by[3] == [long.encode()] * 2 and by[4] == by[None] == [b""]
    assert cd.chunk_dedup(docs.where("false")).count() == 0


def test_planted_passages_are_found_in_any_place(spark):
    """Passages of 51 words, at different offsets of otherwise fresh documents."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(map(chr, rng.integers(97, 123, int(rng.integers(2, 9)))))
    text = lambda n: " ".join(word() for _ in range(n))
    docs, planted = [], []
    for k in range(100):
        passage = text(51)
        for _ in range(2):
            planted.append(len(docs))
            docs.append(f"{text(int(rng.integers(1, 80)))} {passage} {text(int(rng.integers(1, 80)))}")
    clean = range(len(docs), len(docs) + 100)
    docs += [text(120) for _ in clean]
    rows = cd.chunk_dedup(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), with_text=False).collect()
    found = {r.doc_id for r in rows if r.spans} | {i for r in rows for i in r.first_doc_ids}
    assert not found & set(clean)
    assert len(found & set(planted)) >= 0.97 * len(planted)


def test_query_over_the_whole_small_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    expected = [(i, n, c, d, n - len(k), len(s), f) for i, n, c, d, s, f, k in brute(rows) if s]
    out = [(r.doc_id, r.n_bytes, r.n_chunks, r.n_dup_chunks, r.n_removed, r.n_spans, tuple(r.first_doc_ids))
           for r in queries.op1_substring_dedup(spark, path).collect()]
    assert sorted(out) == expected

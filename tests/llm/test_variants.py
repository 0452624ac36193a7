"""Spelling variants against brute force over all pairs; trees of any depth; odd rows; DuckDB on the small table."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from riskloom.llm import queries, spelling_variants as sv
from riskloom.sources.sinks import materialize


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def of_words(n):
    out = {}
    for w in n:
        close = sorted((-n[v], v) for v in n if near(w, v))
        form = close[0][1] if close and -close[0][0] >= 10 * n[w] else None
        out[w] = (form, len(close), n[form] if form else None)
    rows = set()
    for w, (form, k, fn) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n[w], k, fn))
    return rows


def brute(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return of_words({w: c for w, c in n.items() if len(w) >= 7 and c >= 2})


def got(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, word string").repartition(3)


def random_rows(seed, docs=150):
    rng = random.Random(seed)
    stems = ["collation", "cOllatiom", "Éléphante", "elephante", "stationer", "Größenwa", "÷×÷×÷×÷", "abababab", "babababa"]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(40):
            w = list(rng.choice(stems) if rng.random() < 0.8 else "".join(rng.choice("abé") for _ in range(rng.randrange(5, 10))))
            if rng.random() < 0.05:
                w[rng.randrange(len(w))] = rng.choice("abcé")
            words.append("".join(w))
        rows.append((i, rng.choice([" ", "-", "1"]).join(words)))
    return rows


ODD = [(None, "collation collation"), (None, None), (5, ""), (5, "short"), (7, "collation " * 3), (7, "collation " * 3), (9, "z" * 700 + " " + "z" * 700),
       (9, "z" * 700 + "y " + "z" * 700 + "y"), (11, "longword " * 100_000),
       (13, "chainingg " * 3), (14, "chaining " * 40), (15, "chainin " * 600)]


@pytest.mark.parametrize("cell,leaf", [(16_384, 64), (30, 4), (3, 1)])
def test_all_pairs(spark, cell, leaf):
    rows = random_rows(1) + ODD
    found = got(sv.spelling_variants(frame(spark, rows), cell=cell, leaf=leaf))
    assert found == brute(rows) and len(found) > 80
    assert any(r[1] and r[1] != r[2] for r in found), "a path of two forms"


def test_one_vector_in_many_slices_and_a_small_sample(spark):
    rng = random.Random(3)
    n = {"".join(rng.sample("aabbcdefg", 9)): rng.randrange(2, 300) for _ in range(300)}
    n |= {w[:3] + "h" + w[4:]: 2 for w in list(n)[:50]} | {w + "a": 3000 for w in list(n)[:50]}
    words = materialize(spark.createDataFrame(list(n.items()), "word string, n long"))
    found = sv.near_words(words, sample=20, cell=20, leaf=2).collect()
    want = {w: (k, form) for w, form, _, _, k, _ in of_words(n) if k}
    assert {r.word: r.n_near for r in found} == {w: k for w, (k, _) in want.items()}
    assert all(want[r.word][1] in (None, r.form) for r in found)


def test_empty_table(spark):
    docs = frame(spark, ODD)
    assert sv.spelling_variants(docs.where("false")).collect() == []
    assert sv.spelling_variants(docs.where("doc_id = 5")).collect() == []


_word = st.text("abé", min_size=7, max_size=9)


@settings(max_examples=100, deadline=None)
@given(st.lists(_word, min_size=2, max_size=40, unique=True))
def test_a_cell_finds_each_pair_once(words):
    cell = sv._Cell([w.encode("latin-1") for w in words], np.full(len(words), sv.HOME), 2)
    same = sorted((int(a), int(b)) for x, y, _ in cell.pairs for a, b in zip(x, y))
    assert same == sorted((i, j) for i, a in enumerate(words) for j, b in enumerate(words) if len(a) == len(b) and near(a, b))


def test_counts_beyond_the_cap():
    long, more = b"a" * 600 + b"b" * 7, b"a" * 599 + b"b" * 8
    kinds = np.array([sv.HOME, sv.HOME, sv.LONGER])
    cell = sv._Cell([long, more, b"a" * 599 + b"b" * 7], kinds, 1)
    assert {(int(a), int(b)) for x, y, _ in cell.pairs for a, b in zip(x, y)} == {(0, 1), (1, 0), (2, 0), (2, 1)}


def test_query_over_the_small_table(spark):
    from oracle_compare import compare, duck

    path = "/root/testdata/sf0.01"
    df = queries.op13_spelling_variants(spark, path)
    assert compare(df, queries.ORACLES["op13_spelling_variants"], duck(path)) == []
    assert df.where("form IS NOT NULL").count() > 0

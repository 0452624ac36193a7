"""Collocations against brute force over all phrases; odd rows; blocks of any size; DuckDB on the small table."""
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import blocks, collocations as cl, queries


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, least, longest=5, share=100):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lowered(text)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f.update((lang, tuple(words[p : p + size])) for p in range(len(words) - size + 1))
    frequent = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = set()
    for (lang, ws), a in frequent.items():
        holds = [
            b for (other, longer), b in frequent.items()
            if other == lang and len(longer) > len(ws) and any(longer[p : p + len(ws)] == ws for p in range(len(longer)))
        ]
        if any(100 * b >= share * a for b in holds):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws))]
        score, cut, l, r = min(cuts)
        out.add((lang, ws, a, cut, l, r, n[lang], score))
    return out


def got(df):
    return {(r.lang, tuple(r.words), r.a, r.cut, r.l, r.r, r.n, r.score) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(1, t, x, 9, "z") for t, x in rows], "doc_id long, text string, lang string, block int, words string").repartition(3)


def random_rows(seed, docs=120):
    rng = random.Random(seed)
    words = ["a", "A", "b", "c", "dé", "E", "f\x0bf", "g\th", "x;y"] + [f"w{i}" for i in range(6)]
    rows = []
    for _ in range(docs):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", ". ", "\n", "!"]) for _ in range(rng.randrange(60)))
        rows.append((text + "new york city hall park " * rng.randrange(2), rng.choice(["en", "en", "", None, "und"])))
    return rows


ODD = [(None, "en"), ("", None), ("   \t\n", "en"), ("one", "en"), ("a a a a a a a a a", "fr"), ("q r " * 50_000, "fr")]


@pytest.mark.parametrize("block_bytes,share", [(8 << 20, 100), (500, 100), (500, 60)])
def test_all_phrases(spark, block_bytes, share):
    rows = random_rows(1) + ODD[:-1]
    found = got(cl.collocations(frame(spark, rows), least=5, share=share, block_bytes=block_bytes))
    assert found == brute(rows, 5, share=share) and len(found) > 20


def test_a_long_text_and_repeated_rows(spark):
    rows = ODD + [("a b c", "en")] * 7 + [("A b\tc", "en")] * 6
    assert got(cl.collocations(frame(spark, rows), least=10)) == brute(rows, 10)


def test_products_beyond_64_bits(spark):
    a, n, f = 3 * 10**12, 9 * 10**15, 5 * 10**12
    row = spark.createDataFrame([("en", ["x", "y"], a, [f, a], [f, a], n)], "lang string, words array<string>, a long, begins array<long>, ends array<long>, n long")
    assert cl._scored(row).first().score == 1000 * a * n // (f * f)


def test_empty_table(spark):
    docs = frame(spark, ODD)
    assert cl.ranked(cl.collocations(docs.where("false")), 5).collect() == []
    assert cl.collocations(docs.where("text = 'one'")).collect() == []


def test_ranks(spark):
    found = cl.collocations(frame(spark, random_rows(2)), least=8)
    best = cl.ranked(found, 3).collect()
    rows = sorted(((r.lang, -r.score, -r.a, " ".join(r.words).encode()) for r in found.collect()))
    for lang in {r[0] for r in rows}:
        assert [r.phrase.encode() for r in sorted(best, key=lambda r: r["rank"]) if r.lang == lang] == [r[3] for r in rows if r[0] == lang][:3]


def test_numbers_keep_a_tasks_blocks_in_few_buckets(spark):
    ids = np.array([2**40 + 5, 0, 1, 123456789012345], np.int64)
    hashed = [r.h for r in spark.createDataFrame([(int(i),) for i in ids], "i long").select(F.hash("i").alias("h")).collect()]
    assert blocks._spark_hash(ids).tolist() == hashed
    for task in (0, 7, 20_000):
        numbers = blocks.block_ids(task, 50)
        mine = np.array([next(numbers) for _ in range(40)], np.int64)
        assert len(set(mine.tolist())) == 40 and set(mine >> 24) == {task}
        assert len(set((blocks._spark_hash(mine) % 50).tolist())) <= blocks.SPREAD


def test_query_over_the_small_table(spark):
    from oracle_compare import compare, duck

    path = "/root/testdata/sf0.01"
    df = queries.op12_collocations(spark, path)
    assert compare(df, queries.ORACLES["op12_collocations"], duck(path)) == []
    assert df.count() > 0

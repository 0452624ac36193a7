"""SimHash near-dedup and its components against brute force."""
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskloom.llm import components as cc
from riskloom.llm import simhash_dedup as sh


def _fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def _components(items, linked):
    root = {k: k for k, _ in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            if linked(x, y):
                r, s = sorted((find(a), find(b)))
                root[s] = r
    return {k: find(k) for k in root}


def test_whole_small_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = {r.doc_id: _fingerprint(r.text) for r in docs.collect()}
    whole = _components(sorted(expected.items()), lambda x, y: bin(x ^ y).count("1") <= 2)
    rows = sh.simhash_dedup(docs).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {k: f"{v:016x}" for k, v in expected.items()}
    assert {r.doc_id: r.component_id for r in rows} == whole


def test_odd_rows(spark):
    rows = [(5, None, 1), (7, "", 2), (9, " \n\t", 3), (2, "One", 4), (3, "one", 5), (4, "ÀB c\x0bd", 6), (4, "ÀB c\x0bd", 7),
            (None, "one", 8), (11, "w " * 200_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    out = sh.simhash_dedup(docs).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[5].fingerprint == "0" * 16 and {by[i].component_id for i in (5, 7, 9)} == {5}
    assert by[2].component_id == by[3].component_id == by[None].component_id == 2
    for i, text, _ in rows:
        assert by[i].fingerprint == f"{_fingerprint(text):016x}"
    assert sh.simhash_dedup(docs.where("false")).count() == 0
    assert {r.doc_id for r in sh.drop_near_copies(docs).collect()} == {5, 2, 4, 11}


@pytest.mark.parametrize("seed", [1, 2])
def test_links_connect_exactly_the_close_fingerprints(spark, seed):
    rng = random.Random(seed)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(6):  # chains at 1 to 3 bits
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
            fps.add(f)
    items = [(i, f) for i, f in enumerate(sorted(fps))]
    table = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in items], "rep long, fp long")
    found = {r.vertex: r.component for r in cc.components(sh.links(table), "a", "b").collect()}
    expected = _components(items, lambda x, y: bin(x ^ y).count("1") <= 2)
    assert {i: found.get(i, i) for i, _ in items} == expected


def test_segment_counts_bound_the_bit_distance(spark):
    rng = np.random.default_rng(5)
    rows = [(int(x),) for x in rng.integers(-(2**63), 2**63 - 1, 200)] + [(-1,), (0,), (2**63 - 1,), (-(2**63),)]
    out = spark.createDataFrame(rows, "fp long").select("fp", sh.segment_counts(F.col("fp")).alias("c")).collect()
    for r in out:
        word = r.fp % (1 << 64)
        assert [r.c >> 2 * i & 3 for i in range(32)] == [bin(word >> 2 * i & 3).count("1") for i in range(32)]


def test_cells_are_the_points_one_step_away(spark):
    fps = [(int(x),) for x in np.random.default_rng(6).integers(-(2**63), 2**63 - 1, 20)] + [(-1,), (0,)]
    out = spark.createDataFrame(fps, "fp long").select(sh.segment_counts(F.col("fp")).alias("p")).select("p", sh.grid_cells(F.col("p")).alias("cells"))
    for r in out.collect():
        point = [r.p >> 2 * i & 3 for i in range(32)]
        expected = {tuple(point)}
        for i in range(32):
            for to in (point[i] - 1, point[i] + 1):
                if 0 <= to <= 2:
                    expected.add((*point[:i], to, *point[i + 1 :]))
        assert {tuple(c >> 2 * i & 3 for i in range(32)) for c in r.cells if c is not None} == expected


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(200, 260)] + [(1, 1), (3, 2), (2, 3)]
    got = {r.vertex: r.component for r in cc.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert {got[i] for i in range(100, 141)} == {100}
    assert {got[i] for i in [7, *range(200, 260)]} == {7}
    assert got[2] == got[3] == 2 and 1 not in got
    assert cc.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_ids_that_repeat_or_are_null_bring_nothing_together(spark):
    """Brute force over rows, not ids: repeated ids with unlike texts, null ids, copies of a row, a clashing column."""
    rows = [(1, "red green blue"), (1, "one two three four"), (2, "One two three four"), (3, "x y z"), (3, "red green blue"), (5, "a b"),
            (None, "null one"), (None, "null two"), (None, "x y z"), (None, "null two"), (5, "a  b"), (5, "a b"), (0, None), (0, "")]
    prints = [_fingerprint(t) for _, t in rows]
    whole = _components(list(enumerate(prints)), lambda x, y: bin(x ^ y).count("1") <= 2)
    members = {}
    for k, root in whole.items():
        members.setdefault(root, []).append(rows[k])
    least = {root: min((i for i, _ in m if i is not None), default=None) for root, m in members.items()}
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, _kept_id string")
    out = [(r.doc_id, r.fingerprint, r.component_id) for r in sh.simhash_dedup(docs).collect()]
    assert sorted(out, key=str) == sorted(((i, f"{p:016x}", least[whole[k]]) for k, ((i, _), p) in enumerate(zip(rows, prints))), key=str)
    kept = sh.drop_near_copies(docs)
    assert kept.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(kept) == len(members)
    for root, m in members.items():
        assert sum((i, t) in m and i == least[root] for i, t in kept) == 1


def test_pipeline_stage_keeps_one_row_of_each_component(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = _components(sorted((r.doc_id, _fingerprint(r.text)) for r in docs.collect()), lambda x, y: bin(x ^ y).count("1") <= 2)
    assert sorted(r.doc_id for r in sh.drop_near_copies(docs).collect()) == sorted(set(whole.values()))

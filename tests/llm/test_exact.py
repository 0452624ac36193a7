"""Golomb-Rice coding and exact dedup against a dictionary, odd rows, many blocks."""
import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from riskloom.llm import blocks, exact_dedup as ed, queries


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 10**6), min_size=1, max_size=200), st.integers(0, 20))
def test_coding_is_lossless(values, k):
    sorted_values = np.array(sorted(values), np.int64)
    assert ed.rice_decode(len(values), k, *ed.rice_encode(sorted_values, k)).tolist() == sorted_values.tolist()


def brute(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    key = lambda i: (i is None, i or 0)
    return sorted(((i, min(groups[t], key=key), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm), key=str)


def got(rows):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str)


@pytest.mark.parametrize("block_bytes", [1 << 22, 60])
def test_groups(spark, monkeypatch, block_bytes):
    texts = [None, "", " ", "\t\n", "a b", "a  b", "a\x0bb", "a\xa0b", "é\r\né", "é é", " lead", "lead ", "x" * 200_000, "x" * 200_000]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(7, "a b"), (7, "a b"), (None, "a b"), (None, "only null id")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, block int").repartition(3)
    write = blocks.write_blocks
    monkeypatch.setattr(blocks, "write_blocks", lambda d: write(d, block_bytes))
    out = ed.exact_dedup(docs).collect()
    assert got(out) == brute(rows)
    kept = [r for r in out if r.kept]
    assert len(kept) == len({r.text_sha256 for r in out}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)
    assert ed.exact_dedup(docs.where("false")).count() == 0


def test_query_over_the_whole_small_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    assert got(queries.op3_exact_dedup(spark, path).collect()) == brute(rows)

"""Suffix dedup against a plain table of all windows."""
import random

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import queries, suffix_dedup as sd


def brute(rows, depth=sd.DEPTH):
    """(n_bytes, spans, kept) of each (doc_id, bytes)."""
    least = {}
    for i, raw in rows:
        for s in range(len(raw) - depth + 1):
            w = raw[s : s + depth]
            least[w] = min(least.get(w, 2**63 - 1), i)
    out = []
    for i, raw in rows:
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - depth + 1):
            if least[raw[s : s + depth]] < i:
                gone[s : s + depth] = True
        edges = np.flatnonzero(np.diff(gone, prepend=False, append=False)).tolist()
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if raw else b""
        out.append((i, len(raw), tuple(zip(edges[::2], edges[1::2])), kept))
    return sorted(out)


def got(df):
    return sorted((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in df.collect())


@pytest.fixture(scope="module")
def made():
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    parts = [text(n) for n in (30, 49, 50, 51, 60, 90, 400)]
    docs = ["", "x", text(49), "a" * 300, "a" * 120 + "b" + "a" * 60, "ab" * 200, text(5000)]
    for _ in range(60):
        docs.append("".join(rng.choice([text(rng.randint(0, 80)), rng.choice(parts)]) for _ in range(rng.randint(1, 6))))
    docs += docs[10:20]
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    return [(i, d) for i, d in zip(ids, docs)]


@pytest.mark.parametrize("block_bytes,hot", [(1 << 22, 1 << 16), (700, 1 << 16), (2000, 3)])
def test_every_kind_of_repeat(spark, made, monkeypatch, block_bytes, hot):
    monkeypatch.setattr(sd, "HOT_RUNS", hot)  # local mode forks its workers after this
    docs = spark.createDataFrame([(i, d, "x") for i, d in made], "doc_id long, text string, sizes string").repartition(3)
    assert got(sd.suffix_dedup(docs, block_bytes)) == brute([(i, d.encode()) for i, d in made])


def test_hot_anchors_go_as_single_windows(made):
    """The owner's side alone, so that the split of hot anchors is certain to be used."""
    import pyarrow as pa

    rows = [(i, d.encode()) for i, d in made]
    for hot in (1 << 16, 1):
        asked, sent, tables = [], [], []
        for k in range(0, len(rows), 9):
            part = rows[k : k + 9]
            tables.append({"block": k, "doc_ids": [i for i, _ in part], "sizes": [len(r) for _, r in part],
                           "data": sd._zip(b"".join(r for _, r in part))})
        batch = lambda t, **more: pa.RecordBatch.from_pylist([t | more])
        for t in tables:
            asked += [r for b in sd._ask(3)([batch(t)]) for r in b.to_pylist()]
        old, sd.HOT_RUNS = sd.HOT_RUNS, hot
        try:
            told = [r for o in range(3) if (mine := [a for a in asked if a["owner"] == o])
                    for r in sd._tell(pa.Table.from_pylist(mine)).to_pylist()]
        finally:
            sd.HOT_RUNS = old
        for t in tables:
            answers = [{k: v for k, v in a.items() if k != "block"} for a in told if a["block"] == t["block"]]
            sent += [r for b in sd._send(3)([batch(t, answers=answers)]) for r in b.to_pylist()]
        assert (max(r["n"] for r in sent if r["owner"] >= 0) > 0) and (hot > 1 or any(
            np.any(sd._unzip(r["data"], (r["n"], "i8"), (r["n"], "u1"))[1] == 1) for r in sent if r["owner"] >= 0))
        back = [r for o in sorted({s["owner"] for s in sent})
                for r in sd._answer(pa.Table.from_pylist([s for s in sent if s["owner"] == o])).to_pylist()]
        result = []
        for t in tables:
            answers = [{k: v for k, v in a.items() if k != "block"} for a in back if a["block"] == t["block"]]
            for b in sd._finish([batch(t, answers=answers)]):
                result += [(r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), r["kept"])
                           for r in b.to_pylist()]
        assert sorted(result) == brute(rows)


def test_runs_of_an_anchor_are_counted_in_full(monkeypatch):
    """Two blocks with more than 255 runs of one anchor each make it hot by their sum."""
    import zstandard

    rng = random.Random(11)
    phrase, batches, counts = "a most common phrase of forty-nine bytes in this.", [], []
    for block in range(2):
        raw = "".join(phrase + "".join(rng.choice("0123456789") for _ in range(30)) for _ in range(700)).encode()
        runs = sd.Runs(np.frombuffer(raw, np.uint8), [len(raw)])
        counts.append(dict(zip(runs.distinct.tolist(), runs.per_anchor(np.zeros(1, np.int64))[1].tolist())))
        batches.append(pa.RecordBatch.from_pylist(
            [{"block": block, "doc_ids": [block], "sizes": [len(raw)], "data": zstandard.ZstdCompressor().compress(raw)}]
        ))
    total = {a: n + counts[1][a] for a, n in counts[0].items() if a in counts[1]}
    assert min(max(c.values()) for c in counts) > 300
    monkeypatch.setattr(sd, "HOT_RUNS", 600)
    expected = sum(n > 600 for n in total.values())
    told = sd._tell(pa.Table.from_batches(list(sd._ask(1)(iter(batches)))))
    assert expected > 0
    assert [int(np.unpackbits(np.frombuffer(r["hot"], np.uint8)).sum()) for r in told.to_pylist()] == [expected] * 2


def test_odd_rows(spark):
    long = "0123456789" * 30
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, long), (4, long + "tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sd.suffix_dedup(docs).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.n_bytes, bytes(r.kept)))
    assert by[1] == by[2] == [(0, b"")]
    assert by[3] == [(300, long.encode())] * 2 and by[None] == [(300, b"")]
    assert by[4] == [(304, b"tail")]
    assert sd.suffix_dedup(docs.where("false")).count() == 0


def test_query_over_the_whole_small_table(spark):
    import hashlib

    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    expected = [(i, n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in brute(rows)]
    assert sorted(map(tuple, queries.op9_suffix_dedup(spark, path).collect())) == expected

"""Secret scans against Python's re, and the linking of weak parts by hand."""
import hashlib
import re

import pytest

from riskloom.llm import queries, secret_scan as ss

RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 24),
]


def base(text):
    found = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(RULES) for m in re.finditer(p, text or "") if ok(m)]
    return [f"{name}:{a}:{b}" for a, _, b, name in sorted(found)]


def check(rows, texts):
    for r in rows:
        expected = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(e.startswith(k) for e in expected) for k in ("assign", "access", "hex")]
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if s.split(":")[0] in ss.BASE] == expected


def test_whole_small_table(spark):
    path = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = queries.op5_secret_scan(spark, path).collect()
    assert {r.doc_id for r in rows} == set(texts)
    check(rows, texts)


HEX = "0123456789abcdef" * 2
ODD = [
    None, "", "é" * 50 + " password='abcdef' 🙂 token : \"token:abcdefg\" ", 'token="token:abcdef"', "secret=abc password=secret=longer",
    "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "xAKIA" + "Z9" * 20, HEX + HEX.upper() + HEX, "API_KEY: " + "x" * 6 + "apikey=12345", "a" * 100_000,
    " ".join([HEX] * 3000), "password" + " " * 50_000 + "=abcdefgh", "passwd\n=abcdefgh secret=\nabcdefgh", "PassWord'=  'Zz9+/_.=-",
]


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(ODD)], "doc_id long, text string, base string, row int")
    check(ss.digests(ss.secret_scan(docs)).collect(), dict(enumerate(ODD)))
    assert ss.secret_scan(docs.where("false")).count() == 0
    twice = spark.createDataFrame([(1, "password=abcdef"), (1, "password=abcdef"), (None, "password=abcdef")], "doc_id long, text string")
    assert [r.n_assign for r in ss.digests(ss.secret_scan(twice)).collect()] == [1, 1, 1]


@pytest.mark.parametrize("text,added", [
    ("user=alice and nothing else", []),
    ("user=alice then Zk9Lw3QpV7xT2mB8sR4d here", ["link_id", "link_secret"]),
    ("user=alice" + " " * 500 + "Zk9Lw3QpV7xT2mB8sR4d", []),
    ("https://db.example.com/x alone", []),
    ("https://db.example.com/x user: bob password=hunter22", ["link_endpoint", "link_id"]),
    ("https://db.example.com/x Zk9Lw3QpV7xT2mB8sR4d", ["link_secret"]),
    ("login=carol " + HEX, ["link_id"]),
    ("AKIA" + "Q" * 16 + " Zk9Lw3QpV7xT2mB8sR4d", ["link_secret"]),
    ("just Zk9Lw3QpV7xT2mB8sR4d", []),
])
def test_weak_parts_need_their_complement(spark, text, added):
    row = ss.digests(ss.secret_scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    got = [s.split(":")[0] for s in row.spans.split(",") if s and s.split(":")[0] in ss.WEAK]
    assert sorted(got) == added


@pytest.mark.parametrize("text,added", [
    ("user=" + "w" * 90 + "1 password=hunter22", {"link_id": "user=" + "w" * 90 + "1"}),
    ("user=alice " + "x" * 45 + "7Q" + "y" * 45, {"link_id": "user=alice", "link_secret": "x" * 45 + "7Q" + "y" * 45}),
    ("user=alice zk9lw3qpv7xt2mb8sr4d", {"link_id": "user=alice", "link_secret": "zk9lw3qpv7xt2mb8sr4d"}),
    ("https://db.example.com/x zkPlwTqpvRxtNmbWsrKd", {"link_secret": "zkPlwTqpvRxtNmbWsrKd"}),
    ("https://db.example.com/some-long-title-of-2024-page/x and more", {}),
    ("user: averylongusername12345 at averylonghostname1234567.example.com", {}),
    ("user=alice internationalisations", {}),
])
def test_long_and_plain_parts(spark, text, added):
    row = ss.digests(ss.secret_scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    spans = [s.split(":") for s in row.spans.split(",") if s and s.split(":")[0] in ss.WEAK]
    assert {k: text[int(a) : int(b)] for k, a, b in spans} == added


def test_scopes_across_cells_against_all_pairs(spark):
    """Parts at many distances, linked exactly when the gap is within the scope."""
    texts = [f"user=alice{' ' * gap}{HEX}" for gap in range(150, 260, 7)] + [f"{HEX}{' ' * gap}user=alice" for gap in range(150, 260, 7)]
    docs = spark.createDataFrame(list(enumerate("." * (37 * i) + " " + t for i, t in enumerate(texts))), "doc_id long, text string")
    for r in ss.digests(ss.secret_scan(docs)).collect():
        gap = len(re.search(" {2,}", texts[r.doc_id]).group())
        assert ("link_id" in r.spans) == (gap <= ss.SCOPE)

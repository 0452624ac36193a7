"""Personal data: the strict rules against Python's re, the model's spans, redaction."""
import hashlib
import re

import pytest

from riskloom.llm import pii, queries


def _luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _digits(s):
    return re.sub("[^0-9]", "", s)


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(_digits(s)) <= 19 and _luhn(_digits(s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(_digits(s)) <= 15),
]


def base(text):
    found = [(m.start(), k, m.end(), n) for k, (n, p, ok) in enumerate(RULES) for m in re.finditer(p, text or "") if ok(m.group())]
    return [f"{n}:{a}:{b}" for a, _, b, n in sorted(found)]


def check(rows, texts):
    for r in rows:
        expected = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest(), (r.doc_id, expected, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(e.startswith(k) for e in expected) for k in ("email", "ip", "card", "phone")]
        assert [s for s in r.spans.split(",") if s and s.split(":")[0] in pii.BASE] == expected


@pytest.fixture(scope="module")
def small(spark):
    path = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    return texts, queries.op7_pii(spark, path).collect()


def test_whole_small_table(small):
    texts, rows = small
    assert {r.doc_id for r in rows} == set(texts)
    check(rows, texts)


ODD = [
    None, "", "é🙂 a@b.c_d@e.f a@b..c x@y z@1.2-3.-", "1.2.3.4.5.6.7.8 1.2.3 0001.002.255.0 1.2.3.256 12.1.2.3", "1" * 100_000, "a" * 100_000,
    "a.b" * 30_000, "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 5500000000000004x340000000000009", "+1 (2) 345-678-90 +12 +1+23456789012 +4 9 (30) 12.34-56)",
    " ".join(["mail to x.y@z.org or +49 30 1234567"] * 700), "a@" + "b." * 20_000 + "c", "1." * 20_000, "0" * 40 + ".1.1.1", "00 " * 30_000, "+" * 5000 + "1" * 50,
]


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(ODD)], "doc_id long, text string, base string, email string")
    check(pii.digests(pii.find(docs)).collect(), dict(enumerate(ODD)))
    assert pii.find(docs.where("false")).count() == 0
    twice = spark.createDataFrame([(1, "a@b.c"), (1, "a@b.c"), (None, "a@b.c")], "doc_id long, text string")
    assert [r.n_email for r in pii.digests(pii.find(twice)).collect()] == [1, 1, 1]


def test_the_model_adds_what_looks_like_personal_data(spark):
    """Trained where mail addresses are plentiful, it also finds the one that is spelt out; page numbers stay."""
    docs = [(i, f"Please contact jane{i}.doe@mail{i}.org or call +1 (555) 010-{1000 + i}. See page {i} of {3 * i}, 19{10 + i % 80}.") for i in range(400)]
    docs.append((9000, "Please contact john (at) mail77.org today"))
    docs.append((9001, "See page 12 of 40, 1987."))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = pii.train(df)
    assert model.trees and model.thresholds["near_email"] is not None
    rows = {r.doc_id: r for r in pii.digests(pii.with_spans(df, model).select("doc_id", "base", "added")).collect()}
    assert rows[9001].spans == ""
    assert all(set(s.split(":")[0] for s in r.spans.split(",")) == {"email", "phone"} for i, r in rows.items() if i < 400)


def test_a_spelt_out_address_is_found_where_all_others_are_plain(spark):
    docs = [(i, f"Please contact jane{i}.doe@mail{i}.org or call +1 (555) 010-{1000 + i}. See page {i} of {3 * i}.") for i in range(400)]
    text = "Please contact john (at) mail77.org today"
    df = spark.createDataFrame([*docs, (9000, text)], "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in pii.digests(pii.find(df)).collect()}
    assert rows[9000] == f"near_email:15:{text.index(' today')}"


def test_many_spans_beyond_the_rules_are_found(spark):
    """Half of the addresses are spelt out and half of the phone numbers have no plus; numbers abound."""
    mails = ["jane{i}.doe@mail{i}.org", "jane{i}.doe (at) mail{i}.org", "jane{i}@mail{i}.org", "jane{i}[at]mail{i} [dot] org"]
    phones = ["+1 (555) 210-{n}", "(555) 210-{n}", "+49 30 123{n}", "030 123{n}"]
    docs, wanted = [], {}
    for i in range(600):
        mail, phone = mails[i % 4].format(i=i), phones[i % 4].format(n=1000 + i)
        text = f"Please write to {mail} or call {phone}; see page {i} of {3 * i}, 19{10 + i % 80}. Order 77{i} {2 * i} {5 * i} {i + 7}, {i * 3001} units"
        docs.append((i, text))
        if i % 4 in (1, 3):
            wanted[i] = {f"{k}:{text.index(t)}:{text.index(t) + len(t)}" for k, t in (("near_email", mail), ("near_number", phone))}
    rows = pii.digests(pii.find(spark.createDataFrame(docs, "doc_id long, text string"))).collect()
    added = {r.doc_id: {s for s in r.spans.split(",") if s.startswith("near_")} for r in rows}
    found = sum(len(wanted[i] & added[i]) for i in wanted)
    assert found >= 0.98 * 2 * len(wanted)
    assert found >= 0.98 * sum(map(len, added.values()))


def test_one_generator_does_not_crowd_out_another(spark, monkeypatch):
    """Few addresses among very many numbers."""
    monkeypatch.setattr(pii, "SAMPLE_CANDIDATES", 500)
    docs = [(i, f"write to jane{i}@mail{i}.org " + " ".join(f"x{i * j} {j}," for j in range(60))) for i in range(300)]
    docs.append((9000, "write to john (at) mail77.org"))
    rows = {r.doc_id: r.spans for r in pii.digests(pii.find(spark.createDataFrame(docs, "doc_id long, text string"))).collect()}
    assert rows[9000] == "near_email:9:29"


def test_redaction(spark):
    docs = spark.createDataFrame(
        [(1, "é a@b.c, 4111 1111 1111 1111 and 10.0.0.1.", "x", 99), (2, None, "x", 5), (3, "clean 12", "x", 8), (4, "+1 (555) 010-1000", "x", 1)],
        "doc_id long, text string, email string, n_chars long",
    )
    rows = {r.doc_id: (r.text, r.email, r.n_chars) for r in pii.redact(docs).collect()}
    assert rows == {1: ("é [EMAIL], [CARD] and [IP].", "x", 27), 2: (None, "x", None), 3: ("clean 12", "x", 8), 4: ("[PHONE]", "x", 7)}


def test_no_python_on_the_executors(spark):
    docs = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    plan = pii.digests(pii.find(docs))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_every_candidate_is_learnt_from(spark):
    """The examples stand for all candidates of all documents, however many have the same form."""
    docs = spark.range(25_000).selectExpr("id AS doc_id", "concat('call (555) 210-', 1000 + id % 9000, ' or see page 12') AS text")
    examples = pii._examples(pii._scanned(docs)).groupBy("kind", "label").agg({"weight": "sum"}).collect()
    assert {(r.kind, r.label): r[2] for r in examples} == {("near_number", 1.0): 25_000, ("near_number", 0.0): 25_000}
    assert pii.train(docs).thresholds["near_number"] is not None

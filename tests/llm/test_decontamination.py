"""The automaton against brute force over all windows; odd rows; one automaton against many."""
import re

from hypothesis import given, settings, strategies as st

from riskloom.llm import decontamination as dc, queries

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text, items, window=10):
    """Words, hit words, items, and spans in code points, from all windows compared with all places."""
    found = [(m.group(), m.start(), m.end()) for m in WORDS.finditer(lowered(text))]
    words = [w for w, _, _ in found]
    hit, ids = set(), set()
    for item_id, item in items:
        iw = WORDS.findall(lowered(item))
        size = min(window, len(iw))
        for s in range(len(iw) - size + 1 if size else 0):
            for p in range(len(words) - size + 1):
                if words[p : p + size] == iw[s : s + size]:
                    hit.update(range(p, p + size))
                    ids.add("" if item_id is None else str(item_id))
    spans = []
    for p in sorted(hit):
        if p - 1 in hit:
            spans[-1] = spans[-1][0], found[p][2]
        else:
            spans.append(found[p][1:])
    return len(words), len(hit), sorted(ids), spans


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], [(s.start, s.end) for s in r.spans]) for r in df.collect()), key=str)


_text = st.lists(st.sampled_from(["a", "B", "b", "é", "É", "c-", " ", ".", "\n", "1"]), max_size=40).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(_text, st.lists(_text, max_size=4), st.integers(1, 4), st.integers(1, 30))
def test_matches_of_random_texts(text, items, window, part):
    windows = dc.Windows([(str(i), t.encode()) for i, t in enumerate(items)], window)
    n, ends, hits = windows.matches(text.encode(), part)
    runs, ids = windows.runs(ends, hits) if hits else ([], set())
    want = brute(text, list(enumerate(items)), window)
    assert (n, sum(b - a for a, b in runs), sorted(ids), dc.code_points(text.encode(), runs)) == want


ITEMS = [
    (1, "One two three four five six seven eight nine ten eleven twelve"),
    (2, "short Item"),
    (2, "élan vital"),
    (10, "three four five six seven eight nine ten eleven twelve"),
    (None, "null-id item"),
    (3, None),
    (4, ""),
    (5, "?!"),
    (1, "One two three four five six seven eight nine ten eleven twelve"),
]
DOCS = [
    (1, "x ONE, two; three four five six seven eight nine (ten) y"),
    (2, "two three four five six seven eight nine ten eleven twelve one"),
    (3, "a short\titem and a Short item; ÉLAN VITAL élan-vital"),
    (4, "null\nid item short itemise"),
    (5, None),
    (6, ""),
    (6, "!?"),
    (None, "short item"),
    (None, "short item"),
    (7, "pad " * 400_000 + "one two three four five six seven eight nine ten" + " é" * 1000),
]


def tables(spark, docs=DOCS, items=ITEMS):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item_id int, block int").repartition(3)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return d, b


def want(docs=DOCS, items=ITEMS):
    long = [(i, t) for i, t in docs if t and len(t) > 10_000]
    out = [(i, *brute(t, items)) for i, t in docs if (i, t) not in long]
    out += [(i, 400_000 + 10 + 1000, 10, ["1"], [(1_600_000, 1_600_000 + 48)]) for i, _ in long]
    return sorted(out, key=str)


def test_odd_rows(spark):
    assert rows(dc.decontaminate(*tables(spark))) == want()


def test_many_automata_give_the_same(spark):
    docs, items = tables(spark)
    assert rows(dc.decontaminate(docs, items, automaton_bytes=60)) == want()


def test_empty_tables(spark):
    docs, items = tables(spark)
    none = dc.decontaminate(docs, items.where("false")).collect()
    assert len(none) == len(DOCS) and all(r.n_hit == 0 and r["items"] == [] and r.spans == [] for r in none)
    assert dc.decontaminate(docs.where("false"), items).count() == 0
    assert dc.decontaminate(docs.where("false"), items, automaton_bytes=60).count() == 0


def test_spans_are_the_passages(spark):
    text = DOCS[0][1]
    spans = next(r.spans for r in dc.decontaminate(*tables(spark)).collect() if r.doc_id == 1)
    assert [text[s.start : s.end] for s in spans] == ["ONE, two; three four five six seven eight nine (ten"]


def test_query_over_the_small_table(spark):
    from oracle_compare import compare, duck

    path = "/root/testdata/sf0.001"
    df = queries.op11_decontamination(spark, path)
    assert compare(df, queries.ORACLES["op11_decontamination"], duck(path)) == []
    assert df.where("contaminated").count() > 0

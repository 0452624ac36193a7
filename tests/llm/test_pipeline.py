"""The corpus pipeline stage by stage against plain Python, and on odd rows."""
import re
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))
sys.path.insert(0, str(Path(__file__).parent))
pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_pii import base  # noqa: E402
from test_simhash import _components, _fingerprint  # noqa: E402

from riskloom.llm import pii, toxicity  # noqa: E402
from riskloom.sources.sinks import materialize  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows(df):
    return {r.doc_id: r for r in df.collect()}


def _normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.fixture(scope="module")
def stages(spark):
    """The stages' results over the whole small table, each one written and read again."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], sf_dir)))
    return sf_dir, out


def test_columns(stages):
    _, out = stages
    assert len(corpus_pipeline.STAGES) == 5 and all(d.columns == COLUMNS for d in out[:-1])


def test_toxicity_drops_what_it_calls_toxic(spark, stages):
    sf_dir, out = stages
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    called = {r.doc_id: r.predicted for r in toxicity.scored(out[0], labels).collect()}
    before, after = _rows(out[0]), _rows(out[1])
    assert after == {i: r for i, r in before.items() if not called[i]}
    clean = [r.doc_id for r in labels.where("toxic = 0").collect() if r.doc_id in before]
    assert sum(i in after for i in clean) >= 0.95 * len(clean)


def test_exact_dedup_keeps_the_smallest_id(stages):
    _, out = stages
    before, after = _rows(out[1]), _rows(out[2])
    least = {}
    for i, r in sorted(before.items()):
        least.setdefault(_normal(r.text), i)
    assert after == {i: before[i] for i in least.values()}


def test_near_dedup_keeps_one_of_each_component(stages):
    _, out = stages
    before, after = _rows(out[2]), _rows(out[3])
    items = sorted((i, _fingerprint(r.text)) for i, r in before.items())
    whole = _components(items, lambda x, y: bin(x ^ y).count("1") <= 2)
    assert after == {i: before[i] for i in set(whole.values())}


def test_redaction_changes_the_spans_only(stages):
    _, out = stages
    before, after = _rows(out[3]), _rows(out[4])
    assert before.keys() == after.keys()
    for i, r in after.items():
        expected, at = "", 0
        for kind, a, b in (s.split(":") for s in base(before[i].text)):
            if int(a) >= at:
                expected += before[i].text[at : int(a)] + f"[{kind.upper()}]"
            at = max(at, int(b))
        if not re.search(r"\[NEAR|\[NUMBER", r.text):
            assert r.text == expected + before[i].text[at:]
        assert r.n_chars == len(r.text) and (r.lang, r.source) == (before[i].lang, before[i].source)


def test_packing_holds_every_id_once(spark, stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    _, out = stages
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in out[5].collect():
        pieces[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    docs = _rows(out[4])
    assert pieces.keys() == docs.keys()
    for i, r in docs.items():
        ids = np.array([*encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024


def test_odd_documents(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, a clashing extra column, and no rows at all."""
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, "word " * 50_000, "en", "s", 5, "x"), (4, "a b c d", None, "s", 7, "x"),
            (4, "a b c d", None, "s", 7, "x"), (None, "no id here at all", "en", "s", 3, "x"), (6, "mail me@x.org now", "en", None, 17, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(1, 0, 1), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    pieces = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert {p.doc_id for p in pieces} >= {3, 4, 6, None}
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").collect() == []


def test_redaction_kinds_are_the_operators(stages):
    assert all(f"[{k.removeprefix('near_').upper()}]" for k in pii.KINDS)


def test_drops_with_repeated_ids_and_clashing_columns(spark):
    from riskloom.llm import exact_dedup, simhash_dedup

    rows = [(1, "a a", "x"), (1, "a  a", "y"), (2, "a\ta", "z"), (1, "b", "z"), (0, "c", "z"), (3, "b", "z"), (None, "d", "z"), (None, "e", "z"), (None, "c", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept_id string")
    kept = exact_dedup.drop_copies(docs).collect()
    assert sorted(((r.doc_id, _normal(r.text)) for r in kept), key=str) == sorted([(1, "a a"), (1, "b"), (0, "c"), (None, "d"), (None, "e")], key=str)
    assert simhash_dedup.drop_near_copies(docs.where("doc_id = 0 OR text = 'b'")).columns == docs.columns

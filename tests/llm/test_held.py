"""A Python worker holds the cache of one operator at most."""
import pyarrow as pa
import pytest

from riskloom.llm import held, simhash_dedup, toxicity


@pytest.fixture(autouse=True)
def empty():
    held.let_go()
    yield
    held.let_go()


def test_a_cache_serves_later_tasks_and_goes_with_another_operator():
    a = held.held("a", list)
    assert held.held("a", list) is a
    held.held("b", dict)
    assert held._HELD.keys() == {"b"}


def test_the_tokenizers_of_packing_go_when_documents_are_counted():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from riskloom.llm import packing

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    assert packing._chunk_ids(definition) is packing._chunk_ids(definition)
    assert held._HELD
    batch = pa.RecordBatch.from_pydict({"is_toxic": pa.array([True, False]), "text": pa.array(["bad words", "good words"])})
    list(toxicity._count(iter([batch])))
    assert not held._HELD


def test_they_go_from_a_spark_worker_when_it_makes_fingerprints(spark):
    def holding(batches):
        from riskloom.llm import held

        for _ in batches:
            held.held("cache", lambda: bytes(1000))
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(held._HELD)], pa.int64())})

    def left(batches):
        from riskloom.llm import held

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(held._HELD)], pa.int64())})

    one = spark.range(1).coalesce(1)
    assert one.mapInArrow(holding, "n long").first()["n"] == 1
    for _ in range(2 * spark.sparkContext.defaultParallelism):  # idle workers take turns
        docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string").coalesce(1)
        simhash_dedup.fingerprints(docs).collect()
    assert one.mapInArrow(left, "n long").first()["n"] == 0

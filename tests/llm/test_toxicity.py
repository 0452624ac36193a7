"""The non-negative risk, and what the classifier finds in held-out documents."""
import zlib

import numpy as np

from riskloom.llm import queries, toxicity as tx


def test_gradient_is_that_of_the_risk():
    rng = np.random.default_rng(1)
    z, toxic, prior = rng.normal(size=40), np.arange(40) < 15, 0.3

    def parts(z):
        loss = lambda x: np.log1p(np.exp(-x))
        clean = loss(-z[~toxic]).mean() - prior * loss(-z[toxic]).mean()
        return prior * loss(z[toxic]).mean(), clean

    for shift, negative in ((0.0, False), (0.0, True)):
        at = z + shift
        if negative:
            at = np.where(toxic, 5.0, -5.0)
        risk, gradient = tx.risk_gradient(at, toxic, prior)
        plus, clean = parts(at)
        assert (clean < 0) == negative and np.isclose(risk, plus + max(0, clean))
        for k in range(40):
            step = np.zeros(40)
            step[k] = 1e-5
            up, down = parts(at + step), parts(at - step)
            expected = -(up[1] - down[1]) if negative else (sum(up) - sum(down))
            assert np.isclose(gradient[k], expected / 2e-5, atol=1e-6)


def test_held_out_documents_of_the_middle_table(spark):
    path = "/root/testdata/sf0.1"
    scored = {r.doc_id: r for r in queries.op2_toxicity(spark, path).collect()}
    docs = spark.read.parquet(f"{path}/documents.parquet").count()
    assert len(scored) == docs and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scored.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in scored.items())
    labels = [(r.toxic, scored[r.doc_id]) for r in spark.read.parquet(f"{path}/labels.parquet").collect()]
    toxic = [s.predicted for t, s in labels if s.held_out and t == 1]
    clean = [s.predicted for t, s in labels if s.held_out and t == 0]
    assert np.mean(toxic) >= 0.8 and np.mean(clean) <= 0.02  # 160 confirmed examples in four languages


def test_odd_rows(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(rng.choice(words, 20)) + (" vilest scumword" if i % 5 == 0 else ""), "x") for i in range(300)]
    docs += [(300, None, "x"), (301, "", "x"), (None, "vilest scumword", "x"), (5, "repeated id", "x"), (302, "alpha " * 100_000, "x")]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(200)] + [(None, 1, 1), (7, None, None), (9999, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = tx.scored(d, l).collect()
    assert len(out) == len(docs)
    by = {r.doc_id: r for r in out}
    assert by[None].predicted == 1 and not by[None].held_out
    assert by[300].score == by[301].score < 0.3 and by[302].predicted == 0
    assert np.mean([by[i].predicted for i in range(200, 300, 5)]) == 1 and np.mean([by[i].predicted for i in range(201, 300, 5)]) == 0
    assert {r.score for r in tx.scored(d, l.where("toxic = 0")).collect()} == {0.0}
    assert tx.scored(d.where("false"), l).count() == 0


def test_repeated_ids_leave_the_sample_bounded(spark, monkeypatch):
    seen, fit = [], tx.fit
    monkeypatch.setattr(tx, "fit", lambda features, *a: seen.append(len(features)) or fit(features, *a))
    d = spark.createDataFrame([(1, f"text {i}") for i in range(400)] + [(i, "other words") for i in range(2, 30)], "doc_id long, text string")
    tx.train(d, spark.createDataFrame([(1, 1), (1, 1), (3, 0)], "doc_id long, toxic int"))
    free = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(1, 30))
    assert seen == [1 + free]


def test_every_training_document_is_learnt_from(spark, monkeypatch):
    """More documents than one shard; the telling word stands only in those that come last by the hash of their id."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(tx, "SHARD_ROWS", 1000)
    ids = spark.range(12000).withColumn("toxic", (F.col("id") % 3 == 0).cast("int")).withColumn("at", F.xxhash64("id"))
    last = sorted((r.at for r in ids.where("toxic = 1").where(~tx.held_out(F.col("id"))).collect()))[2000]
    assert ids.where((F.col("at") >= last) & (F.col("toxic") == 1)).where(~tx.held_out(F.col("id"))).count() > 500
    telling = (F.col("toxic") == 1) & (F.col("at") >= last)
    text = F.concat_ws(" ", F.lit("alpha beta"), F.concat(F.lit("w"), F.col("id") % 50), F.when(telling, "scumword"))
    docs = ids.select(F.col("id").alias("doc_id"), text.alias("text")).localCheckpoint()
    labels = ids.select(F.col("id").alias("doc_id"), "toxic")
    seen, fit = [], tx.fit
    monkeypatch.setattr(tx, "fit", lambda rows, *a: seen.append((rows.n_toxic, rows.n_free)) or fit(rows, *a))
    by = {r.doc_id: r.score for r in tx.scored(docs, labels).collect()}
    kept = [i for i in range(12000) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert seen == [(sum(i % 3 == 0 for i in kept), len(kept))]
    marked = {r.doc_id for r in docs.where("text LIKE '%scumword'").collect()}
    assert min(by[i] for i in marked) > 0.9 and max(by[i] for i in by.keys() - marked) < 0.5


def test_grams_of_many_words_at_once():
    words = ["a", "ab", "abc", "grams", "x" * 40, "straße", "слово", "日本語の", "_1", "é"]
    grams, sizes = tx.hashed(words)
    parts = np.split(grams, np.cumsum(sizes)[:-1])
    assert [sorted(set(p.tolist())) for p in parts] == [sorted(set(tx.grams_of(w))) for w in words]
    assert [len(x) for x in tx.hashed([])] == [0, 0]
    known = tx.Words(tx._mask(np.unique(grams)))
    for _ in range(2):
        found, row = tx.distinct_grams(["a grams a", None, "", "ab straße"], known)
        assert set(zip(row.tolist(), found.tolist())) == {(i, g) for i, t in ((0, "a grams"), (3, "ab straße")) for w in t.split() for g in tx.grams_of(w)}


def test_places_as_gaps():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = [[], [0], [5, 127, 128, 300], [], sorted(rng.choice(1 << 22, 50, replace=False).tolist()), [(1 << 22) - 1], []]
    places, row = np.array(sum(rows, [])), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    data, ends = tx._gaps(places, row, len(rows))
    back, of = tx._sparse(pa.array([data[a:b] for a, b in zip([0, *ends], ends)], pa.binary()))
    assert [back[of == i].tolist() for i in range(len(rows))] == rows
    assert [len(x) for x in tx._sparse(pa.array([b""], pa.binary()))] == [0, 0]

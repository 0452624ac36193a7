"""Embedding near-dedup against brute force: exact links, recall, odd vectors, split lists."""
import numpy as np
import pytest

from riskloom.llm import embedding_dedup as ed
from riskloom.llm import queries


def brute(ids, vectors, cosine=0.95):
    n = len(ids)
    ok = np.array([v is not None and len(v) > 0 and None not in v and bool(np.isfinite(np.array(v, float)).all())
                   and bool(np.any(np.array(v, float))) for v in vectors])
    adj = np.zeros((n, n), bool)
    x = np.array([v for v, k in zip(vectors, ok) if k], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at = np.flatnonzero(ok)
    adj[np.ix_(at, at)] = x @ x.T >= cosine
    np.fill_diagonal(adj, False)
    label = np.array(ids)
    while True:
        new = np.array([min(label[i], *label[adj[i]]) if adj[i].any() else label[i] for i in range(n)])
        if (new == label).all():
            return {i: (int(adj[k].sum()), int(label[k])) for k, i in enumerate(ids)}
        label = new


def got(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


def _clusters(seed, d=32):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, d))
    out = [c + rng.normal(size=d) * rng.uniform(0, 0.25) for c in centres for _ in range(int(rng.integers(1, 12)))]
    out += [out[3]] * 5 + [list(np.array(out[3]) * 7)] + [out[9]] * 2
    return [list(map(float, v)) for v in out]


def test_links_are_exact_and_recall_is_high(spark):
    vectors = _clusters(1)
    ids = np.random.default_rng(2).permutation(len(vectors)).tolist()
    expected = brute(ids, vectors)
    out = got(ed.embedding_dedup(spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<double>")))
    assert out.keys() == expected.keys()
    assert all(out[i][0] <= expected[i][0] for i in ids)
    assert sum(n for n, _ in out.values()) >= 0.97 * sum(n for n, _ in expected.values())


def test_recall_of_the_index_near_the_threshold():
    """Pairs at a cosine of exactly 0.95 in several dimensions and numbers of pivots."""
    rng = np.random.default_rng(4)
    for d in (16, 64):
        for m in (64, 512, 2048):
            x = rng.normal(size=(6000, d))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            a, e = x[:1500], rng.normal(size=(1500, d))
            e -= (e * a).sum(1, keepdims=True) * a
            b = 0.95 * a + np.sqrt(1 - 0.95**2) * e / np.linalg.norm(e, axis=1, keepdims=True)
            pivots = x[rng.choice(6000, m, replace=False)]
            shared = (ed.prefixes(a, pivots)[:, :, None] == ed.prefixes(b, pivots)[:, None, :]).sum(axis=(1, 2))
            assert (shared >= ed.SHARED).mean() >= 0.95


def _dense(seed, n, d, members, mean_cosine=0.96):
    """Unit vectors; the first ``members`` are differing near copies of one centre, the others random."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    centre = rng.normal(size=d)
    x[:members] = centre / np.linalg.norm(centre) + x[:members] * np.sqrt((1 - mean_cosine) / mean_cosine / d)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("d", [8, 32, 64, 384])
@pytest.mark.parametrize("n", [10_000, 100_000])
def test_recall_of_the_index_within_a_dense_group(n, d):
    """A third of the pivots' sample lies in the group; its linked pairs still share enough pivots."""
    m = ed.pivots_for(n)
    x = _dense(5, 2000 + m, d, 2000 + m // 3)
    pivots = ed.apart(x[2000:])
    a, b = np.random.default_rng(6).integers(0, 2000, (2, 20_000))
    linked = (a != b) & ((x[a] * x[b]).sum(axis=1) >= ed.COSINE)
    a, b = a[linked], b[linked]
    near = ed.prefixes(x[:2000], pivots)
    assert len(a) > 100
    assert ((near[a][:, :, None] == near[b][:, None, :]).sum(axis=(1, 2)) >= ed.SHARED).mean() >= 0.97


def test_links_of_a_dense_group(spark):
    """A third of the vectors are differing near copies."""
    x = _dense(8, 3000, 32, 1000)
    ids = np.random.default_rng(9).permutation(len(x)).tolist()
    expected = brute(ids, x.tolist())
    df = spark.createDataFrame(list(zip(ids, x.tolist())), "vec_id long, embedding array<double>")
    out = got(ed.embedding_dedup(df))
    total = sum(n for n, _ in expected.values())
    assert total > 300_000
    assert all(out[i][0] <= expected[i][0] for i in ids)
    assert sum(n for n, _ in out.values()) >= 0.98 * total


def test_whole_small_table_against_brute_force(spark):
    path = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()
    assert got(queries.op8_embedding_dedup(spark, path)) == brute([r.vec_id for r in rows], [r.embedding for r in rows])


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]),
            (6, [float("inf"), 1.0, 1.0]), (7, v), (8, v), (8, v), (None, v), (9, [1.0, 2.0]), (10, [1e-200, 2e-200, 3e-200]),
            (11, [-1.0, -2.0, -3.0])]
    df = spark.createDataFrame([(i, x, "x") for i, x in rows], "vec_id long, embedding array<double>, vec string")
    out = ed.embedding_dedup(df).collect()
    assert len(out) == len(rows)
    by = {r.vec_id: r for r in out}
    for i in (1, 2, 3, 4, 5, 6, 9, 11):
        assert (by[i].n_links, by[i].component_id, by[i].kept) == (0, i, True)
    for i in (7, 8, 10, None):
        assert (by[i].n_links, by[i].component_id) == (4, 7)
    assert ed.embedding_dedup(df.where("false")).count() == 0


def test_vectors_of_each_length_link_among_themselves(spark):
    wide, narrow = _clusters(3), _clusters(5, 16)[:150]
    narrow += [narrow[0]] * 3
    ids = np.random.default_rng(2).permutation(len(wide) + len(narrow)).tolist()
    expected = brute(ids[: len(wide)], wide) | brute(ids[len(wide) :], narrow)
    out = got(ed.embedding_dedup(spark.createDataFrame(list(zip(ids, wide + narrow)), "vec_id long, embedding array<double>")))
    assert out.keys() == expected.keys()
    for some in (ids[: len(wide)], ids[len(wide) :]):
        assert all(out[i][0] <= expected[i][0] for i in some)
        assert sum(out[i][0] for i in some) >= 0.97 * sum(expected[i][0] for i in some) > 0


@pytest.mark.parametrize("rows", [10])
def test_split_lists_miss_nothing(spark, monkeypatch, rows):
    vectors = _clusters(7)
    ids = list(range(len(vectors)))
    df = spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<double>")
    whole = got(ed.embedding_dedup(df))
    monkeypatch.setattr(ed, "LIST_ROWS", rows)  # used on the driver only
    assert got(ed.embedding_dedup(df)) == whole


def test_ids_that_repeat_or_are_null_bring_nothing_together(spark):
    """Brute force over rows, not ids."""
    rng = np.random.default_rng(11)
    a, b, c, d, e = np.linalg.qr(rng.normal(size=(16, 5)))[0].T
    near = [x + 0.05 * rng.normal(size=16) / 4 for x in (a, b, c)]
    rows = [(1, a), (1, b), (2, near[0]), (4, near[1]), (4, c), (None, d), (None, e), (None, near[2]), (7, a), (1, a), (None, d)]
    x = np.array([v / np.linalg.norm(v) for _, v in rows])
    adj = x @ x.T >= 0.95
    reach = np.linalg.matrix_power(adj.astype(int), len(rows)) > 0
    expected = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in np.flatnonzero(reach[k]) if rows[j][0] is not None]
        component = min(ids, default=None)
        expected.append((i, int(adj[k].sum()) - 1, component, i == component))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    out = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in ed.embedding_dedup(df).collect()]
    assert sorted(out, key=str) == sorted(expected, key=str)

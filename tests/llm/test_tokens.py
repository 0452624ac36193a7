"""Byte-level BPE and packing against the reference libraries on whole texts and odd cases."""
import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from riskloom.llm import byte_bpe, packing, queries  # noqa: E402

ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b\n\n", "\ta\t b", "don't I'll 'S  'll",
    "x y   z", "　　wide   line", "日本語 テキスト 123", "🙂🙃 👩‍👩‍👧 é", "\x00\x01\x1c\x1d \x85",
    "a" * 5000, " " * 3000, "ab " * 4000, "1234567890" * 300, "<|endoftext|> <unk> </s> ▁ ▁x", "ֈ꟎ x",
]


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(None, "no id", "x"), (3, "same id", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def _tiktoken():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {p: i for i, p in enumerate(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_alphabet_is_a_bijection():
    assert len(set(byte_bpe.byte_alphabet())) == 256
    assert byte_bpe.to_bytes(byte_bpe.to_characters(bytes(range(256)))) == bytes(range(256))


def test_ids_equal_tiktoken_and_decode_back(odd_docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = _tiktoken()
    out = byte_bpe.decode(byte_bpe.encode(odd_docs, path, public_tokenizers.PATTERN), path).collect()
    texts = [r.text or "" for r in odd_docs.collect()]
    assert len(out) == len(texts)
    for row, text in zip(sorted(out, key=lambda r: bytes(r.decoded)), sorted(texts, key=str.encode)):
        assert bytes(row.decoded) == text.encode()
        assert np.frombuffer(row.ids, "<u4").tolist() == enc.encode_ordinary(text)


def test_query_over_the_whole_small_table(spark):
    enc = _tiktoken()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = queries.op6_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_small_rank_file_with_few_merges(spark, tmp_path):
    pieces = [bytes([b]) for b in range(256)] + [b"ab", b"abab", b"bc"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % i for i, p in enumerate(pieces)))
    docs = spark.createDataFrame([(1, "ababc")], "doc_id long, text string")
    row = byte_bpe.encode(docs, str(path), r"\S+|\s+").first()
    assert np.frombuffer(row.ids, "<u4").tolist() == [257, ord("c")]
    (tmp_path / "gap").write_bytes(base64.b64encode(b"a") + b" 1\n")
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(str(tmp_path / "gap"))


def _ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids, 0]


def _check_packing(pieces, expected, size=1024):
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append((p.start, bytes(p.ids), p.doc_tokens))
        sequences[p.sequence_id].append((p.offset, p.length))
        assert p.length == len(p.ids) // 4 > 0
    for doc_id, ids in expected.items():
        got = sorted(docs[doc_id])
        assert b"".join(g[1] for g in got) == np.array(ids, "<u4").tobytes()
        assert all(g[2] == len(ids) for g in got)
        assert [g[0] for g in got] == np.cumsum([0, *[len(g[1]) // 4 for g in got]])[:-1].tolist()
    total, padded = 0, 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
        total += at
        padded += 0 if at & (at - 1) == 0 else size - at
    return total, padded, len(sequences)


def test_pieces_hold_each_id_once(spark):
    rows = [(i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    _, padded, _ = _check_packing(pieces, {i: _ids(t or "") for i, t in rows})
    assert padded == 0
    assert packing.pack(docs.where("false"), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_query_packs_the_whole_small_table(spark):
    path = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    expected = {i: _ids(t) for i, t in texts.items()}
    pieces = packing.pack(spark.read.parquet(f"{path}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")).collect()
    total, padded, sequences = _check_packing(pieces, expected)
    assert total == sum(map(len, expected.values())) and padded == 0 and sequences <= total / 1024 + 10
    rows = queries.op10_packing(spark, path).collect()
    for r in rows:
        ids = expected[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_level_choice_is_the_smallest_sum_of_squares():
    rng = np.random.default_rng(3)
    packer = packing.SumOfSquares(size=16, max_open=10**9)
    for n in rng.integers(1, 16, 400).tolist():
        sums = {}
        for level in range(0, 16 - n + 1):
            if level and not packer.count[level]:
                continue
            after = packer.count.copy()
            after[level] -= level > 0
            if level + n < 16:
                after[level + n] += 1
            sums[level] = int((after[1:16] ** 2).sum())
        best = max(h for h, s in sums.items() if s == min(sums.values()))
        assert packer.level_for(n) == best
        packer.add((1, 0, b"\0" * 4 * n, n))
    packer.finish()


def test_many_open_windows_are_poured_early():
    packer = packing.SumOfSquares(size=16, max_open=5)
    for i in range(200):
        packer.add((i, 0, bytes([i]) * 4 * 9, 9))
        assert packer.n_open <= 6
    packer.finish()
    assert sum(len(ids) // 4 for w in packer.closed for _, _, ids, _ in w) == 1800

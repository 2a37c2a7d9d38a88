"""Texts that fool polynomial hashes modulo powers of two, through the operators that hash."""

import hashlib

import numpy as np
import pytest

from tracelake.llm import bpe, jaccard, kernels, linededup, lm, quality


def twins(n):
    """The Thue-Morse string of n letters and its complement."""
    x = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[i] for i in x), "".join("ba"[i] for i in x)


def test_slices_and_windows_differ():
    for n in (512, 1024, 2048, 4096):
        a, b = twins(n)
        buf = np.frombuffer((a + b).encode(), np.uint8)
        for which in (0, 1):
            h = kernels.slice_hash(kernels.prefix(buf, kernels.RAW_CODES, which), np.array([0, n]), np.array([n, 2 * n]))
            assert h[0] != h[1]
        x = buf.astype(np.uint64)
        _, w = kernels.window_hash(x, np.repeat([0, 1], n), n)
        assert len(w) == 2 and w[0] != w[1]


def test_hash_of_a_slice_depends_on_its_bytes_only(monkeypatch):
    r = np.random.default_rng(1)
    unit = r.integers(0, 256, 900, dtype=np.uint8)
    buf = np.concatenate([r.integers(0, 256, 77, dtype=np.uint8), unit, r.integers(0, 256, 5000, dtype=np.uint8), unit])
    s, e = np.array([77, 5977]), np.array([977, 6877])
    h = kernels.slice_hash(kernels.prefix(buf, kernels.RAW_CODES), s, e)
    monkeypatch.setattr(kernels, "_EXACT", 64)
    assert h[0] == h[1] and (kernels.slice_hash(kernels.prefix(buf, kernels.RAW_CODES), s, e) == h).all()
    p = (1 << 61) - 1
    v = sum((int(c) + 1) * pow(kernels._POINTS[0], i, p) for i, c in enumerate(unit)) % p
    assert h[0] == kernels.mix(np.array([v], dtype=np.uint64))[0]
    for k in (1, 2, 3, 5, 8, 13):
        _, w = kernels.window_hash(unit.astype(np.uint64), np.zeros(900, int), k)
        assert len(w) == 901 - k and len(set(w.tolist())) == len({unit[i : i + k].tobytes() for i in range(901 - k)})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [x for n in (512, 1024, 2048, 4096) for x in twins(n)]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1), rows


def test_bpe(docs):
    df, rows = docs
    got = {r.row.doc_id: r for r in bpe.decode(bpe.encode(df)).collect()}
    assert [got[i].text for i in range(len(rows))] == rows
    enc = bpe.Encoder(bpe.rank_path())
    buf = np.frombuffer(rows[3].encode(), np.uint8)
    want = enc.encode(buf, np.array([0, len(buf)]))[0].tolist()
    ids = {r.row.doc_id: r.ids for r in bpe.encode(df).collect()}
    assert ids[3] == want and ids[2] != ids[3]


def test_bpe_with_equal_hashes(monkeypatch):
    enc, other = bpe.Encoder(bpe.rank_path()), bpe.Encoder(bpe.rank_path())
    texts = ["one two three", " three one  two!", "Ünï 字 one", ""]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *[len(t.encode()) for t in texts]])
    want = enc.encode(buf, off)
    real = kernels.slice_hash
    monkeypatch.setattr(kernels, "slice_hash", lambda *a: real(*a) & np.uint64(3))
    for x, y in zip(want, other.encode(buf, off), strict=True):
        assert x.tolist() == y.tolist()


def test_lines_stay(docs, spark):
    a, b = docs[1][2], docs[1][3]
    rows = [(1, f"{a}\n{a}"), (2, f"{b}\n{b}"), (3, f"{a}\n{b}"), (4, f"{a}\n{a}")]
    got = {r.row.doc_id: r.n_gone for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 2}


def test_words_and_lines_are_counted_apart(docs):
    rows = docs[1]
    h = lm.tokens(np.frombuffer((rows[2] + " " + rows[3]).encode(), np.uint8), np.array([0, 2 * len(rows[2]) + 1]))[0]
    assert h[0] != h[1]
    text = "\n".join([rows[2], rows[3], rows[2]])
    stats = dict(zip(quality._STATS, quality.text_stats(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])), strict=True))
    assert stats["n_dup_lines"][0] == 1


def test_digest_of_query(docs, spark, tmp_path):
    df, rows = docs
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.decoded_sha256 for r in bpe.op8_byte_bpe(spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(rows)}
    comp = {r.doc_id: r.component_id for r in jaccard.op10_jaccard_join(spark, str(tmp_path)).collect()}
    assert comp == {i: i for i in range(len(rows))}

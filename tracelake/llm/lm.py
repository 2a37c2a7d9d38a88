"""Operator 1: language-model scoring by deleted interpolation.

Tokens are the words of a text and one end. The model is

    p(w | h) = a2[b] c(h w) / c(h) + a1[b] c(w) / N + a0[b] / (V + 1),

with maximum-likelihood estimates from training documents, h the token before (the end
stands before the first word), and weights a[b] for each bucket b of the frequency of
h (powers of two). The weights are learned by expectation-maximisation on held-out
counts: training documents of fold ``HELD`` are deleted from the counts, and their
tokens, aggregated to distinct count tuples, are what the weights are fitted to. The
scores then use the counts of all training documents.

Counts come block by block (see ``counts``): each block of documents asks once for its
distinct words and word pairs. All counts cover the whole corpus; nothing is pruned.

Cases: a null or empty text is its end alone; a word or pair never seen in training
has only the weight of the last term; repeated rows count as documents of their own
and score alike; a null doc_id counts as the empty text in the choice of the fold; with
no training documents N is 0 and both scores rest on V + 1 = 1; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm import counts as C
from tracelake.llm import kernels as K
from tracelake.llm.store import cut, table

FOLDS = 10
TEST, HELD = 0, 1
EM_ROUNDS = 8
BUCKETS = 24
END = np.uint64(0x5EED0F0E0D0C0B0A)
_PAIR = np.uint64(0xA24BAED4963EE407)
_U = np.uint64


def tokens(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each closed by END, and the text of each token."""
    s, e, doc = K.words(b, o, K.SPACED)
    h = K.slice_hash(K.prefix(b, K.LOWER_CODES), s, e)
    n = len(o) - 1
    at = np.searchsorted(doc, np.arange(n), side="right")
    return np.insert(h, at, END), np.insert(doc, at, np.arange(n))


def items(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct item hashes with counts, and for each token the places of its word and its pair."""
    before = np.concatenate([[END], t[:-1]]) if len(t) else t
    pair = K.mix(K.mix(before + _PAIR) ^ (t * _PAIR))
    both = np.concatenate([t & ~_U(1), pair | _U(1)])  # the last bit tells them apart
    u, back, n = np.unique(both, return_inverse=True, return_counts=True)
    return u, n, back[: len(t)], back[len(t) :]


def word_totals(u: np.ndarray, sums: np.ndarray) -> list[int]:
    """Tokens and distinct words of a bucket, with and without the held fold."""
    own = sums[:, (u & _U(1)) == 0]
    return [own[0].sum(), own[1].sum(), (own[0] > 0).sum(), (own[1] > 0).sum()]


def _block_tokens(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list]:
    """Tokens and their row, and the ids, of packed documents; in a fixed order."""
    ids, hs, ds, at = [], [], [], 0
    for r in sorted(rows.select(["ids", "lens", "texts"]).to_pylist(), key=lambda r: r["ids"]):
        lens = np.frombuffer(r["lens"], np.int64)
        buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["texts"]), np.uint8)
        off = np.append(0, np.cumsum(lens))
        ids += C.unpack_ids(r["ids"])
        for i, _, b, o in K.chunks(buf, off):
            h, d = tokens(b, o)
            hs.append(h)
            ds.append(d + at + i)
        at += len(lens)
    if not hs:
        return np.empty(0, _U), np.empty(0, np.int64), ids
    return np.concatenate(hs), np.concatenate(ds), ids


def blocks(docs: DataFrame, n_blocks: int) -> DataFrame:
    """(block, cls, ids, lens, texts): documents packed by block; a block has documents of one class.
    ids are the doc_ids as strings."""
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS))
    cls = F.least(fold, F.lit(2)).cast("int")
    own = F.when(cls == 2, F.lit(max(1, n_blocks * (FOLDS - 2) // FOLDS))).otherwise(F.lit(max(1, n_blocks // FOLDS)))
    block = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")), own) * 3 + cls
    src = docs.select(F.col("doc_id").cast("string").alias("id"), cls.alias("cls"), block.cast("long").alias("block"), F.col("text").cast("string").alias("text"))

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(2).to_numpy(zero_copy_only=False)
            cls = batch.column(1).to_numpy(zero_copy_only=False)
            order = np.argsort(block, kind="stable")
            ids = batch.column(0).take(pa.array(order))
            buf, off = K.texts(batch.column(3).take(pa.array(order)))
            head = np.flatnonzero(np.diff(block[order], prepend=-1))
            ends = np.append(head[1:], len(order))
            out = [(int(block[order[a]]), int(cls[order[a]]), C.pack_ids(ids.slice(a, z - a)), np.diff(off[a : z + 1]).astype(np.int64).tobytes(), press.compress(buf[off[a] : off[z]].tobytes())) for a, z in zip(head, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "cls", "ids", "lens", "texts"])

    return src.mapInArrow(run, "block long, cls int, ids binary, lens binary, texts binary")


def _bucket(c: np.ndarray) -> np.ndarray:
    """Bucket of a context frequency: 0, 1, 2-3, 4-7, ..."""
    return np.minimum(np.where(c > 0, np.log2(np.maximum(c, 1)).astype(np.int64) + 1, 0), BUCKETS - 1)


def _with_counts(rows: pa.Table, got: pa.Table, which: int):
    """(text of each token, c(w), c(h w), c(h), ids) of a block and its answers."""
    t, doc, ids = _block_tokens(rows)
    _, _, word, pair = items(t)
    sums = C.ordered(got)
    c = sums[min(which, len(sums) - 1)] if sums else np.empty(0, np.int64)
    cw = c[word]
    # the count of the token before is that of the word before; the end stands before the first
    ch = np.empty_like(cw)
    if len(cw):
        ch[1:], ch[0] = cw[:-1], cw[-1]
    return doc, cw, c[pair], ch, ids


def fit_weights(held: DataFrame, n: int, v: int) -> list[list[float]]:
    """Expectation-maximisation on (b, c2, ch, c1, times) rows; a small sum a round goes to the driver."""
    a = [[0.0 if b == 0 else 0.4, 0.4, 0.2 + 0.4 * (b == 0)] for b in range(BUCKETS)]
    spark = held.sparkSession
    for _ in range(EM_ROUNDS):
        w = spark.createDataFrame([(b, *x) for b, x in enumerate(a)], "b int, a2 double, a1 double, a0 double")
        terms = held.join(F.broadcast(w), "b").select("b", "times", (F.col("a2") * F.coalesce(F.try_divide("c2", "ch"), F.lit(0.0))).alias("t2"), (F.col("a1") * F.col("c1") / F.lit(max(n, 1))).alias("t1"), (F.col("a0") / F.lit(v + 1)).alias("t0"))
        total = F.col("t2") + F.col("t1") + F.col("t0")
        sums = terms.groupBy("b").agg(*[F.sum(F.col("times") * F.col(t) / total).alias(t) for t in ("t2", "t1", "t0")]).collect()  # BUCKETS rows
        for r in sums:
            s = r["t2"] + r["t1"] + r["t0"]
            # one pseudo-token keeps every weight that the model needs above 0
            p = [r["t2"] + (r["b"] > 0) / 3, r["t1"] + 1 / 3, r["t0"] + 1 / 3]
            a[r["b"]] = [x / sum(p) for x in p] if s else a[r["b"]]
    return a


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``."""
    _, size = C.sizes(docs)
    n_blocks = max(1, -(-size // C.BLOCK_BYTES))
    n_buckets = max(1, -(-size // (4 * C.BUCKET_ITEMS)))
    packed = blocks(docs, n_blocks)

    def request(key, t):
        h, _, _ = _block_tokens(t)
        u, n, _, _ = items(h)
        return C.ask(key[0].as_py(), t.column("cls")[0].as_py(), u, n, n_buckets)

    # sums: over all training documents, and over those outside the held fold
    asked = packed.groupBy("block").applyInArrow(request, C._ASK)
    weights = lambda cls: [float(cls != TEST), float(cls > HELD)]
    reply = lambda cls, sums: list(sums) if cls == HELD else [sums[0]]
    told = cut(C.answers(asked, weights, reply, word_totals).withColumn("cls", F.pmod("block", F.lit(3)).cast("int")), "counts", "cls")

    def held_rows(key, t, got):
        doc, cw, c2, ch, _ = _with_counts(t, got, 1)
        rows, times = np.unique(np.stack([_bucket(ch), c2, ch, cw]), axis=1, return_counts=True) if len(doc) else (np.empty((4, 0), np.int64), np.empty(0, np.int64))
        return pa.table({"b": pa.array(rows[0], pa.int32()), "c2": pa.array(rows[1], pa.int64()), "ch": pa.array(rows[2], pa.int64()), "c1": pa.array(rows[3], pa.int64()), "times": pa.array(times, pa.int64())})

    schema = "b int, c2 long, ch long, c1 long, times long"
    stats = blocks(docs.filter(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD), n_blocks)
    tuples = stats.groupBy("block").cogroup(told.filter((F.col("cls") == HELD) & (F.col("block") >= 0)).drop("cls").groupBy("block")).applyInArrow(held_rows, schema)
    # distinct in each block so far; the rounds below read each tuple once
    held = cut(tuples.groupBy("b", "c2", "ch", "c1").agg(F.sum("times").alias("times")), "held")
    n, n_rest, v, v_rest = told.agg(*[F.coalesce(F.sum(F.get("stats", F.lit(i))), F.lit(0)) for i in range(4)]).first()
    a = np.array(fit_weights(held, n_rest, v_rest))

    def scored(key, t, got):
        doc, cw, c2, ch, ids = _with_counts(t, got, 0)
        m = len(ids)
        base = np.log10((cw + 0.1) / (n + 0.1 * (v + 1)))
        w = a[_bucket(ch)]
        p = w[:, 0] * c2 / np.maximum(ch, 1) + w[:, 1] * cw / max(n, 1) + w[:, 2] / (v + 1)
        cols = [np.bincount(doc, minlength=m), np.bincount(doc, weights=cw > 0, minlength=m).astype(np.int64), np.bincount(doc, weights=base, minlength=m), np.bincount(doc, weights=np.log10(p), minlength=m)]
        held_out = np.full(m, key[0].as_py() % 3 == TEST)
        return pa.table({"doc_id": pa.array(ids, pa.string()), "held_out": held_out, "n_tokens": pa.array(cols[0], pa.int64()), "n_known": pa.array(cols[1], pa.int64()), "train_tokens": pa.array(np.full(m, n), pa.int64()), "base_score": cols[2], "score": cols[3]})

    out = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    rows = packed.groupBy("block").cogroup(told.filter("block >= 0").drop("cls").groupBy("block")).applyInArrow(scored, out)
    return rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))

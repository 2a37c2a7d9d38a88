"""Operator 4: suffix-array deduplication of byte strings.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts anywhere else.
Suffixes are sorted shard by shard with external induced sorting (see ``induced``), and
the shards are cut so that equal strings meet: every string has an anchor, the place of
the least hash among its grams of ``GRAM`` bytes, which equal strings share. Strings
with the same anchor place are one segment of the text. Segments whose anchor gram
occurs nowhere else (exact counts, see ``counts``) hold no repeated string; of the
others each block of documents sends every distinct segment once to the shard of its
anchor gram, with the number of its copies. The shard sorts the suffixes of all its
segments and answers which starts are repeated, and the block removes the bytes.

So the suffixes sorted are those of distinct suspicious segments, and a very common passage
costs one segment for each block. A gram that many segments hold with different text around
it (``HOT``) is split: its segments fall into parts of ``STEP`` distances to the anchor, and
a part goes to the shard of the bytes that all strings of its distances have in common.
Equal strings have the same distance and so the same shard. Runs of the sorter's queues go
to disk beyond its memory.

Cases: null or empty text has no bytes; texts under ``LENGTH`` bytes lose none; matches
never cross documents; equal rows are copies of each other; rows are returned one for
one, also with equal or null ids; a document may be cut inside a character, so what is
kept is bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import counts as C
from tracelake.llm import kernels as K
from tracelake.llm.induced import repeated_starts
from tracelake.llm.store import cut, table

LENGTH = 200
GRAM = 40
BLOCK_BYTES = 5 << 20
#: Bytes of documents for each shard; what a shard sorts is the suspicious part of as many.
SHARD_BYTES = 4 << 20
#: Segments of one gram from which they are split by the text around it.
HOT = 4096
#: Distances to the anchor in one part of a split segment.
STEP = 41
END = 0xFF
_U = np.uint64
_BOTH = _U(0x9FB21C651E98DF25)
#: Bytes of texts whose anchors are found at a time: its arrays stay in a core's cache.
CHUNK = 1 << 17


def _packed(docs: DataFrame, n_blocks: int) -> DataFrame:
    """(block, ids, lens, texts): documents packed by block."""
    block = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")), F.lit(n_blocks))
    src = docs.select(F.col("doc_id").cast("string").alias("id"), block.alias("block"), F.col("text").cast("string").alias("text"))

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(1).to_numpy(zero_copy_only=False)
            order = np.argsort(block, kind="stable")
            ids = batch.column(0).take(pa.array(order))
            buf, off = K.texts(batch.column(2).take(pa.array(order)))
            head = np.flatnonzero(np.diff(block[order], prepend=-1))
            out = [(int(block[order[a]]), C.pack_ids(ids.slice(a, z - a)), np.diff(off[a : z + 1]).tobytes(), press.compress(buf[off[a] : off[z]].tobytes())) for a, z in zip(head, np.append(head[1:], len(order)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "ids", "lens", "texts"])

    return src.mapInArrow(run, "block long, ids binary, lens binary, texts binary")


def _block(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """(bytes, offsets, ids) of a block."""
    parts = sorted(rows.select(["ids", "lens", "texts"]).to_pylist(), key=lambda r: (r["ids"], r["lens"]))
    lens = [np.frombuffer(r["lens"], np.int64) for r in parts]
    buf = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(r["texts"]) for r in parts), np.uint8)
    off = np.append(0, np.cumsum(np.concatenate(lens))) if lens else np.zeros(1, np.int64)
    return buf, off, [x for r in parts for x in C.unpack_ids(r["ids"])]


def anchors(b: np.ndarray, o: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, gram hash, anchor place) of each segment: consecutive starts of
    strings of ``length`` bytes inside one text that have the same anchor."""
    n, w = len(b), length - gram + 1
    if n < length:
        e = np.empty(0, np.int64)
        return e, e, e.astype(_U), e
    h = K.rolling(b, gram)
    m = len(h)
    v = np.full(-(-m // w) * w + w, ~_U(0), dtype=_U)
    v[:m] = (h & ~_U(0xFFFFFFFF)) | np.arange(m, dtype=_U)  # ties go to the left
    v = v.reshape(-1, w)
    left = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(v, axis=1).ravel()
    k = n - length + 1
    place = (np.minimum(left[:k], right[w - 1 : w - 1 + k]) & _U(0xFFFFFFFF)).astype(np.int64)
    # starts from which a string of that length stays inside its text
    room = np.zeros(n + 1, dtype=np.int32)
    long = np.flatnonzero(np.diff(o) >= length)
    np.add.at(room, o[long], 1)
    np.add.at(room, o[long + 1] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(room[:k]) > 0)
    if not len(at):
        e = np.empty(0, np.int64)
        return e, e, e.astype(_U), e
    place = place[at]
    head = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (np.diff(at) > 1)))
    return at[head], np.diff(np.append(head, len(at))), h[place[head]], place[head]


def _segments(buf: np.ndarray, off: np.ndarray):
    """Segments of a whole block, found chunk by chunk: (start, starts, gram hash, content hash, anchor place)."""
    out = [[], [], [], [], []]
    for i, _, b, o in K.chunks(buf, off, CHUNK):
        s, n, h, place = anchors(b, o)
        for x, y in zip(out, (s + off[i], n, h, K.slice_hash(K.prefix(b, K.RAW_CODES), s, s + n + LENGTH - 1), place + off[i]), strict=True):
            x.append(y)
    kinds = (np.int64, np.int64, _U, _U, np.int64)
    return [np.concatenate(x) if x else np.empty(0, k) for x, k in zip(out, kinds, strict=True)]


def _parts(buf: np.ndarray, s: np.ndarray, n: np.ndarray, place: np.ndarray):
    """Segments cut into parts of ``STEP`` distances: (start, starts, hash of the distances and of the bytes that
    all strings of these have in common, content hash)."""
    out = [[], [], [], []]
    for i in range(0, len(s), 1 << 12):
        s0, n0, p0 = s[i : i + (1 << 12)], n[i : i + (1 << 12)], place[i : i + (1 << 12)]
        width = n0 + LENGTH - 1
        sums = K.prefix(buf[_ranges(s0, width)], K.RAW_CODES)
        shift = np.cumsum(width) - width - s0
        far, near = p0 - s0, p0 - s0 - n0 + 1
        for low in range(0, LENGTH - GRAM + 1, STEP):
            top = min(low + STEP - 1, LENGTH - GRAM)
            own = np.flatnonzero((far >= low) & (near <= top))
            hi, lo, p = np.minimum(far[own], top), np.maximum(near[own], low), p0[own]
            core = K.slice_hash(sums, p - low + shift[own], p - top + LENGTH + shift[own])
            content = K.slice_hash(sums, p - hi + shift[own], p - lo + LENGTH + shift[own])
            for x, y in zip(out, (p - hi, hi - lo + 1, K.mix(core + _U(low)), content), strict=True):
                x.append(y)
    return [np.concatenate(x) for x in out]


def _distinct(rows: pa.Table, got: pa.Table):
    """Block bytes, offsets, ids; suspicious segments (start, starts, hash that deals them, content); the first of each content, which of these each segment has, and how many have it."""
    buf, off, ids = _block(rows)
    s, n, h, key, place = _segments(buf, off)
    u, back = np.unique(h, return_inverse=True)
    told = C.ordered(got)
    seen = told[0][back.ravel()] if len(u) else np.zeros(0, np.int64)
    few, many = seen == 2, seen > 2
    if many.any():
        cut_up = _parts(buf, s[many], n[many], place[many])
        s, n, h, key = (np.append(x[few], y) for x, y in zip((s, n, h, key), cut_up, strict=True))
    else:
        s, n, h, key = s[few], n[few], h[few], key[few]
    _, first, back, times = np.unique(K.mix(h + key * _BOTH), return_index=True, return_inverse=True, return_counts=True)
    return buf, off, ids, s, n, h, key, first, back.ravel(), times


def _ranges(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All of s[i] .. s[i] + n[i] - 1, one after the other."""
    heads = np.cumsum(n) - n
    return np.repeat(s - heads, n) + np.arange(n.sum())


def removal(docs: DataFrame):
    """(packed documents, answers): what ``_removed`` needs of each block."""
    _, size = C.sizes(docs)
    n_blocks, n_buckets = max(1, -(-size // BLOCK_BYTES)), max(1, -(-size // (64 * C.BUCKET_ITEMS)))
    n_shards, hot = max(1, -(-size // SHARD_BYTES)), HOT
    packed = _packed(docs, n_blocks)

    def request(key, t):
        buf, off, _ = _block(t)
        _, _, h, content, _ = _segments(buf, off)
        u, n = np.unique(h, return_counts=True)
        kinds = np.bincount(np.searchsorted(u, h[np.unique(K.mix(h + content * _BOTH), return_index=True)[1]]), minlength=len(u))
        return C.ask(key[0].as_py(), 0, u, np.maximum(np.minimum(n, 2), kinds), n_buckets)

    told = cut(C.answers(packed.groupBy("block").applyInArrow(request, C._ASK), lambda cls: [1.0], lambda cls, sums: [np.where(sums[0] > hot, 3, np.minimum(sums[0], 2))], lambda u, sums: []), "grams").filter("block >= 0").select("block", "bucket", "sums")

    def send(key, t, got):
        buf, _, _, s, n, h, content, first, _, times = _distinct(t, got)
        shard = (h[first] % _U(n_shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(n_shards + 1))
        press, out = zstandard.ZstdCompressor(level=1), []
        for i in range(n_shards):
            own = first[order[bounds[i] : bounds[i + 1]]]
            if len(own):
                k = times[order[bounds[i] : bounds[i + 1]]]
                out.append((i, key[0].as_py(), n[own].astype(np.int32).tobytes(), content[own].tobytes(), np.minimum(k, 2).astype(np.uint8).tobytes(), press.compress(buf[_ranges(s[own], n[own] + LENGTH - 1)].tobytes())))
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))], names=["shard", "block", "starts", "keys", "times", "bytes"])

    sent = packed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(send, "shard int, block long, starts binary, keys binary, times binary, bytes binary")

    def sort(key, t):
        rows = t.to_pylist()
        seen: dict[tuple[int, int], int] = {}
        pieces, counts, widths, refs = [], [], [], []
        for r in rows:
            n, keys = np.frombuffer(r["starts"], np.int32), np.frombuffer(r["keys"], _U)
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["bytes"]), np.uint8)
            ends = np.cumsum(n.astype(np.int64) + LENGTH - 1)
            own = []
            for k, w, e, c in zip(keys.tolist(), n.tolist(), ends.tolist(), r["times"], strict=True):
                at = seen.setdefault((k, w), len(pieces))
                if at == len(pieces):
                    pieces += [raw[e - w - LENGTH + 1 : e], _SEP]
                    counts += [c, 0]
                    widths += [w, 0]
                else:
                    counts[at] += c
                own.append(at)
            refs.append(own)
        text = np.concatenate(pieces)
        again = repeated_starts(text, LENGTH)
        begin = np.cumsum([len(x) for x in pieces]) - [len(x) for x in pieces]
        width, count = np.array(widths, dtype=np.int64), np.array(counts)
        out = []
        for own in refs:
            own = np.array(own)
            marks = again[_ranges(begin[own], width[own])] | np.repeat(count[own] > 1, width[own])
            out.append(zstandard.ZstdCompressor(level=1).compress(np.packbits(marks).tobytes()))
        return pa.table({"block": t.column("block"), "bucket": pa.array([-1 - key[0].as_py()] * len(out), pa.int32()), "sums": pa.array(out, pa.binary())})

    marks = cut(sent.groupBy("shard").applyInArrow(sort, "block long, bucket int, sums binary"), "marks")
    return packed, told.unionByName(marks), n_shards


_SEP = np.array([END], dtype=np.uint8)


def _removed(rows: pa.Table, got: pa.Table, n_shards: int):
    """(bytes, offsets, ids, mask of the bytes that go) of a block."""
    kind = got.column("bucket").to_numpy()
    buf, off, ids, s, n, h, _, first, back, _ = _distinct(rows, got.filter(pa.array(kind >= 0)))
    gone = np.zeros(len(buf) + 1, dtype=np.int32)
    if len(first):
        blobs = {-1 - r["bucket"]: r["sums"] for r in got.filter(pa.array(kind < 0)).select(["bucket", "sums"]).to_pylist()}
        order = np.argsort((h[first] % _U(n_shards)).astype(np.int64), kind="stable")
        shard = (h[first[order]] % _U(n_shards)).astype(np.int64)
        starts = n[first[order]]
        at = np.empty(len(first), dtype=np.int64)
        at[order] = np.cumsum(starts) - starts
        marks = []
        for i in np.unique(shard):
            k = int(starts[shard == i].sum())
            marks.append(np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(blobs[int(i)]), np.uint8), count=k).astype(bool))
        marks = np.concatenate(marks)
        hit = _ranges(s, n)[marks[_ranges(at[back], n)]]
        np.add.at(gone, hit, 1)
        np.add.at(gone, hit + LENGTH, -1)
    return buf, off, ids, np.cumsum(gone[:-1]) > 0


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans) of each row."""
    return _apply(docs, lambda kept: kept, "kept binary", pa.binary())


def _apply(docs: DataFrame, tell, column: str, kind: pa.DataType) -> DataFrame:
    packed, told, n_shards = removal(docs)
    name = column.split()[0]

    def run(key, t, got):
        buf, off, ids, gone = _removed(t, got, n_shards)
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        first[off[:-1][np.diff(off) > 0]] = gone[off[:-1][np.diff(off) > 0]]
        sums = np.stack([np.append(0, np.cumsum(x)) for x in (gone, first)])[:, off]
        kept = buf[~gone]
        ends = np.append(0, np.cumsum(~gone))[off]
        out = [tell(kept[a:z].tobytes()) for a, z in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({"doc_id": pa.array(ids, pa.string()), name: pa.array(out, kind), "n_bytes": np.diff(off), "n_removed": np.diff(sums[0]), "n_spans": np.diff(sums[1])})

    out = packed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, f"doc_id string, {column}, n_bytes long, n_removed long, n_spans long")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _apply(table(spark, sf_dir, "documents"), lambda kept: hashlib.sha256(kept).hexdigest(), "kept_sha256 string", pa.string())
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

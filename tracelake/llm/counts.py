"""Corpus counts of item hashes, answered block by block.

Documents are dealt into blocks of a bounded size. A block asks for each of its distinct
items (n-grams, shingles) once: the hashes go, sorted and packed, to the bucket that
owns them with the block's own counts; a bucket sums over all blocks and sends each
block its answers in the order asked. So neither a token nor a document id is shuffled,
a very frequent item costs one entry for each block, and buckets hold a share of the
distinct items that the number of buckets bounds.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
BUCKET_ITEMS = 600_000
_ASK = "bucket int, block long, cls int, items binary"
_ANSWER = "block long, bucket int, sums binary, stats array<long>"


def sizes(docs: DataFrame) -> tuple[int, int]:
    """Rows and bytes of the texts: two numbers, however large the table."""
    r = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    return r["n"], r["b"]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length in one compressed value; sorted uint64 are sent as differences in byte planes."""
    n = len(arrays[0])
    parts = [np.array([n, len(arrays)], dtype=np.int64).tobytes()]
    for a in arrays:
        if a.dtype == np.uint64:
            d = np.diff(a, prepend=np.uint64(0))
            parts.append(b"d" + np.ascontiguousarray(d.view(np.uint8).reshape(n, 8).T).tobytes())
        else:
            parts.append({1: b"1", 4: b"4", 8: b"8"}[a.dtype.itemsize] + a.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, k = np.frombuffer(raw, np.int64, 2)
    at, out = 16, []
    for _ in range(k):
        kind, at = raw[at : at + 1], at + 1
        if kind == b"d":
            planes = np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n)
            out.append(np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel()))
            at += 8 * n
        else:
            dt = {b"1": np.uint8, b"4": np.uint32, b"8": np.int64}[kind]
            out.append(np.frombuffer(raw, dt, n, at))
            at += n * dt().itemsize
    return out


def pack_ids(ids: pa.Array) -> bytes:
    """doc_ids of any type, as strings; null stays null."""
    return json.dumps(ids.to_pylist()).encode()


def unpack_ids(blob: bytes) -> list[str | None]:
    return json.loads(blob)


def narrow(a: np.ndarray) -> np.ndarray:
    """Counts as bytes where they fit."""
    top = a.max() if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint32 if top < 1 << 32 else np.int64)


def split(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of the buckets in sorted hashes: a bucket owns one range of hash values."""
    step = (1 << 64) // buckets + 1
    return np.searchsorted(h, np.array([min(i * step, (1 << 64) - 1) for i in range(buckets)] , dtype=np.uint64)).tolist() + [len(h)]


def ask(block: int, cls: int, h: np.ndarray, n: np.ndarray, buckets: int) -> pa.Table:
    """Request rows of a block: ``h`` distinct and sorted, ``n`` its counts."""
    at = split(h, buckets)
    own = [i for i in range(buckets) if at[i + 1] > at[i]]
    blobs = [pack(h[at[i] : at[i + 1]], narrow(n[at[i] : at[i + 1]])) for i in own]
    return pa.table({"bucket": pa.array(own, pa.int32()), "block": pa.array([block] * len(own), pa.int64()), "cls": pa.array([cls] * len(own), pa.int32()), "items": pa.array(blobs, pa.binary())})


def answers(requests: DataFrame, weights: Callable[[int], list[float]], reply: Callable[[int, np.ndarray], list[np.ndarray]], stats: Callable[[np.ndarray, np.ndarray], list[int]]) -> DataFrame:
    """(block, bucket, sums) rows: sums are those of ``weights(cls)`` times the counts, over all
    blocks; ``reply(cls, sums)`` picks the arrays that a block gets for its items. One more row
    of each bucket, of block -1, has ``stats(items, sums)``."""

    def run(key, t):
        asked = [unpack(x) for x in t.column("items").to_pylist()]
        cls = t.column("cls").to_pylist()
        u, back = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        back = back.astype(np.int32)
        w = [weights(c) for c in cls]
        sums = np.stack([np.bincount(back, weights=np.concatenate([a[1] * x[i] for a, x in zip(asked, w, strict=True)]), minlength=len(u)) for i in range(len(w[0]))])
        out, at = [], 0
        for a, c in zip(asked, cls, strict=True):
            own = sums[:, back[at : at + len(a[0])]].astype(np.int64)
            out.append(pack(*[narrow(x) for x in reply(c, own)]))
            at += len(a[0])
        told = [int(x) for x in stats(u, sums.astype(np.int64))]
        return pa.table({"block": pa.array([*t.column("block").to_pylist(), -1], pa.int64()), "bucket": pa.array([key[0].as_py()] * (len(out) + 1), pa.int32()), "sums": pa.array([*out, None], pa.binary()), "stats": pa.array([None] * len(out) + [told], pa.list_(pa.int64()))})

    return requests.groupBy("bucket").applyInArrow(run, _ANSWER)


def ordered(rows: pa.Table) -> list[np.ndarray]:
    """A block's answers in the order of its sorted hashes."""
    t = rows.select(["bucket", "sums"]).to_pylist()
    parts = [unpack(r["sums"]) for r in sorted(t, key=lambda r: r["bucket"])]
    return [np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(len(parts[0]))] if parts else []

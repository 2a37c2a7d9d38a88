"""Operator 9: edit-aware token counts.

Each document keeps a segment tree: its leaves are runs of about ``LEAF`` pre-tokens with
their bytes and tokens, inner nodes hold sums. ``trees`` makes a table of them, ``recount``
takes that table with edits and gives back counts and the trees after the edits (and the
edited texts), for the edits to come. An edit descends by byte sums to the leaves it
touches. Only those are encoded again, with context: to the left a leaf that holds two
bytes and something solid (further left no pre-token can change), to the right one leaf,
whose start must still start a pre-token (behind it nothing changes then); if it doesn't,
the region reaches to the end of the text. The new counts go into the first leaf and up
its path. Edits of a document are applied from the last to the first, all documents of a
batch side by side; what lies behind an edit is kept as pieces, so no edit copies the text.

An edit is (doc_id, start, length, insert): replace ``length`` code points from
``start`` (0-based, in the text before any edit) by ``insert``. The edits of one document
meet in its row.

Cases: null or empty text has no tokens and takes inserts at 0; null or negative
starts, starts behind the end, and edits of unknown documents are ignored; null or
negative lengths count as 0, null inserts as empty; parts that overlap an edit that
starts later are left to that edit; equal starts are applied in the order of length,
then insert, the larger first; rows that share a doc_id each get its edits; a tree serves
the rows that have its doc_id and the text it was made of, all others (also those with a
null doc_id, which have no edits) are encoded; empty tables give no rows; other columns, of
any name, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm import bpe
from tracelake.llm import kernels as K
from tracelake.llm.store import cut, table

LEAF = 32
_OUT = ("n_before", "n_after", "n_edits", "n_pretokens", "n_reencoded")


class Tree:
    """Bytes, tokens and pre-tokens of the leaves of one text, with sums over all subtrees."""

    def __init__(self, *leaves: list[int]):
        self.n = max(1, len(leaves[0]))
        self.width = 1 << (self.n - 1).bit_length()
        self.size, self.tokens, self.pre = (self._sums(x) for x in leaves)

    def _sums(self, leaves: list[int]) -> list[int]:
        out = [0] * self.width + leaves + [0] * (self.width - len(leaves))
        for i in range(self.width - 1, 0, -1):
            out[i] = out[2 * i] + out[2 * i + 1]
        return out

    def find(self, at: int) -> tuple[int, int]:
        """The leaf with byte ``at`` (the last filled one for the end of the text) and where it starts."""
        i, start = 1, 0
        at = max(0, min(at, self.size[1] - 1))
        while i < self.width:
            i *= 2
            if at - start >= self.size[i]:
                start += self.size[i]
                i += 1
        return i - self.width, start

    def put(self, leaf: int, size: int, tokens: int, pre: int) -> None:
        i = leaf + self.width
        ds, dt, dp = size - self.size[i], tokens - self.tokens[i], pre - self.pre[i]
        while i:
            self.size[i] += ds
            self.tokens[i] += dt
            self.pre[i] += dp
            i //= 2

    def bytes_in(self, leaf: int) -> int:
        return self.size[leaf + self.width]

    def with_leaves(self, a: int, b: int, parts: list[tuple[int, int, int]]) -> Tree:
        """A tree with ``parts`` (size, tokens, pre-tokens) in place of the leaves a .. b; empty leaves go."""
        w = self.width
        old = list(zip(self.size[w : w + self.n], self.tokens[w : w + self.n], self.pre[w : w + self.n], strict=True))
        leaves = [x for x in (*old[:a], *parts, *old[b + 1 :]) if x[0]]
        return Tree(*map(list, zip(*leaves, strict=True)))

    def pack(self) -> bytes:
        """The leaves that hold bytes."""
        leaves = np.array([self.size[self.width :], self.tokens[self.width :], self.pre[self.width :]], dtype=np.int64)
        return np.ascontiguousarray(leaves[:, leaves[0] > 0]).tobytes()


def _unpack(blob: bytes) -> Tree:
    leaves = np.frombuffer(blob, dtype=np.int64).reshape(3, -1)
    return Tree(*leaves.tolist())


class _Text:
    """A text whose end is edited: what stands before ``limit`` is as it was, the rest is a stack of pieces."""

    def __init__(self, old: bytes):
        self.old, self.limit, self.behind = old, len(old), []

    def read(self, a: int, z: int | None = None) -> bytes:
        """Bytes a .. z of the text as it is now; ``a`` is not behind ``limit``."""
        out = [self.old[a : self.limit if z is None else min(z, self.limit)]]
        left = None if z is None else z - max(a, self.limit)
        for piece in reversed(self.behind):
            if left is not None and left <= 0:
                break
            out.append(piece if left is None else piece[:left])
            left = None if left is None else left - len(piece)
        return b"".join(out)

    def edit(self, start: int, end: int, insert: bytes) -> None:
        self.behind += [self.old[end : self.limit], insert]
        self.limit = start


class _Region:
    """One pending edit: leaves a..b of a text, and the leaf behind them as context."""

    def __init__(self, tree: Tree, text: _Text, start: int, end: int, insert: bytes):
        a, at = tree.find(start)
        b, b_at = tree.find(max(start, end - 1))
        b_end = b_at + tree.bytes_in(b)
        while a > 0 and not (at < start and _solid(text.read(at, start))):  # left context that the edit doesn't reach
            a -= 1
            at -= tree.bytes_in(a)
        self.a, self.b, self.at = a, b, at
        nxt = b + 1
        while nxt < tree.n and not tree.bytes_in(nxt):
            nxt += 1
        around = text.read(at, b_end + (tree.bytes_in(nxt) if nxt < tree.n else 0))
        self.tail = around[b_end - at :]
        self.body = around[: start - at] + insert + around[end - at : b_end - at]


def _solid(b: bytes) -> bool:
    return len(b) >= 2 and any(c > 32 for c in b[:-1])


def plant(enc: bpe.Encoder, texts: list[bytes]) -> list[Tree]:
    """The tree of each text."""
    off = np.append(0, np.cumsum([len(t) for t in texts]))
    _, _, _, s, n = enc.encode(np.frombuffer(b"".join(texts), dtype=np.uint8), off)
    own = np.searchsorted(s, off)
    out = []
    for i, t in enumerate(texts):
        heads = np.arange(own[i], own[i + 1], LEAF)
        if not len(heads):
            out.append(Tree([len(t)], [0], [0]))
            continue
        tok = np.add.reduceat(n[own[i] : own[i + 1]], heads - own[i])
        out.append(Tree(np.diff(np.append(s[heads], off[i + 1])).tolist(), tok.tolist(), np.diff(np.append(heads, own[i + 1])).tolist()))
    return out


def count_edits(enc: bpe.Encoder, texts: list[bytes], edits: list[list[tuple[int, int, bytes]]], known: list[Tree | None]) -> tuple[list[tuple[int, ...]], list[Tree], list[_Text]]:
    """``_OUT`` for each text, and the trees and texts after the edits; edits are (start byte, end byte,
    insert) from the last to the first, ``known`` the trees of the texts that have one."""
    new = [i for i, k in enumerate(known) if k is None]
    planted = dict(zip(new, plant(enc, [texts[i] for i in new]), strict=True)) if new else {}
    trees = [planted[i] if k is None else k for i, k in enumerate(known)]
    before, pre = [t.tokens[1] for t in trees], [t.pre[1] for t in trees]
    again = [0] * len(texts)
    now = [_Text(t) for t in texts]
    for r in range(max((len(x) for x in edits), default=0)):
        todo = [i for i, x in enumerate(edits) if len(x) > r]
        regions = [_Region(trees[i], now[i], *edits[i][r]) for i in todo]
        for i in todo:
            now[i].edit(*edits[i][r])
        counts = _encode(enc, [(g.body, g.tail) for g in regions])
        late = [k for k, c in enumerate(counts) if c is None]
        if late:  # no boundary where the context starts: up to the end of the text
            for k in late:
                regions[k].body = now[todo[k]].read(regions[k].at)
                regions[k].b = trees[todo[k]].n - 1
            for k, c in zip(late, _encode(enc, [(regions[k].body, b"") for k in late]), strict=True):
                counts[k] = c
        for i, g, (sizes, tokens) in zip(todo, regions, counts, strict=True):
            again[i] += len(sizes)
            if len(sizes) > 2 * LEAF:  # a leaf that has grown is split, so an edit costs no more for those before it
                heads = np.arange(0, len(sizes), LEAF)
                held = np.diff(np.append(heads, len(sizes)))
                parts = zip(*(x.tolist() for x in (np.add.reduceat(sizes, heads), np.add.reduceat(tokens, heads), held)), strict=True)
                trees[i] = trees[i].with_leaves(g.a, g.b, list(parts))
                continue
            for leaf in range(g.a + 1, g.b + 1):
                if trees[i].bytes_in(leaf):
                    trees[i].put(leaf, 0, 0, 0)
            trees[i].put(g.a, len(g.body), int(tokens.sum()), len(sizes))
    return [(before[i], trees[i].tokens[1], len(edits[i]), pre[i], again[i]) for i in range(len(texts))], trees, now


def _encode(enc: bpe.Encoder, parts: list[tuple[bytes, bytes]]) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Bytes and tokens of the pre-tokens of each body before its tail; None if no pre-token starts with the tail."""
    whole = [a + b for a, b in parts]
    off = np.append(0, np.cumsum([len(x) for x in whole]))
    _, _, _, s, n = enc.encode(np.frombuffer(b"".join(whole), dtype=np.uint8), off)
    out = []
    for i, (a, b) in enumerate(parts):
        lo, cut = np.searchsorted(s, [off[i], off[i] + len(a)])
        out.append((np.diff(np.append(s[lo:cut], off[i] + len(a))), n[lo:cut]) if not b or (cut < len(s) and s[cut] == off[i] + len(a)) else None)
    return out


def _clean(text: bytes, edits: list[dict]) -> list[tuple[int, int, bytes]]:
    """Edits in bytes, from the last to the first, cut where they overlap."""
    todo = [(x["start"], max(0, x["length"] or 0), x["insert"] or "") for x in edits if x["start"] is not None and x["start"] >= 0]
    if not todo:
        return []
    at = np.append(np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80), len(text))
    out, limit = [], len(at) - 1
    for start, length, insert in sorted(todo, reverse=True):
        if start < len(at):
            end = min(start + length, max(limit, start))
            out.append((int(at[start]), int(at[min(end, len(at) - 1)]), insert.encode()))
            limit = start
    return out


def trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text_key, leaves): the tree of each doc_id that is not null. Of rows that share one but differ in
    their texts, the one with the least text_key has it."""
    path = path or bpe.rank_path()
    src = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches):
        enc = bpe.encoder(path)
        for batch in batches:
            if batch.num_rows:
                keys, leaves = [], []
                for texts in _texts(batch.column(1)):
                    keys += [_key(t) for t in texts]
                    leaves += [tree.pack() for tree in plant(enc, texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(leaves, pa.binary())], names=["doc_id", "text_key", "leaves"])

    rows = src.mapInArrow(run, T.StructType([src.schema["doc_id"], *_KEPT]))
    return rows.groupBy("doc_id").agg(F.min("text_key").alias("text_key"), F.min_by("leaves", "text_key").alias("leaves"))


_KEPT = [T.StructField("text_key", T.BinaryType()), T.StructField("leaves", T.BinaryType())]


def _key(text: bytes) -> bytes:
    return hashlib.md5(text).digest()


def _texts(column: pa.Array):
    """The texts of a column, about a megabyte at a time."""
    buf, off = K.texts(column)
    for i, j, b, o in K.chunks(buf, off):
        yield [b[o[k] : o[k + 1]].tobytes() for k in range(j - i)]


def recount(docs: DataFrame, edits: DataFrame, kept: DataFrame | None = None, path: str | None = None, *, texts: bool = False) -> DataFrame:
    """(doc_id, n_before, n_after, n_edits, n_pretokens, n_reencoded, text_key, leaves) for each row of ``docs``:
    counts, and the tree after the edits. ``kept`` are trees of the texts as they are in ``docs``; texts
    without one are encoded. With ``texts`` there is the edited text, too."""
    path = path or bpe.rank_path()
    one = F.struct(F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), F.col("insert").cast("string").alias("insert"))
    own = edits.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("e_id")).agg(F.collect_list(one).alias("edits"))
    if kept is None:
        own = own.select("e_id", "edits", F.lit(None).cast("binary").alias("text_key"), F.lit(None).cast("binary").alias("leaves"))
    else:
        own = own.join(kept.select(F.col("doc_id").alias("e_id"), "text_key", "leaves"), "e_id", "full")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(own, F.col("doc_id") == F.col("e_id"), "left").select("doc_id", "edits", "text_key", "leaves", "text")

    def run(batches):
        enc = bpe.encoder(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            got, keys, blobs = (batch.column(i).to_pylist() for i in (1, 2, 3))
            at = 0
            for part in _texts(batch.column(4)):
                i, at = at, at + len(part)
                known = [_unpack(blobs[i + k]) if keys[i + k] is not None and keys[i + k] == _key(t) else None for k, t in enumerate(part)]
                counts, after, now = count_edits(enc, part, [_clean(t, got[i + k] or []) for k, t in enumerate(part)], known)
                new = [x.read(0) for x in now]
                cols = [pa.array([x[k] for x in counts], pa.int64()) for k in range(len(_OUT))]
                cols += [pa.array([_key(t) for t in new], pa.binary()), pa.array([t.pack() for t in after], pa.binary())]
                if texts:
                    cols.append(pa.array([t.decode() for t in new], pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(part)), *cols], names=["doc_id", *_OUT, "text_key", "leaves", *(["text"] if texts else [])])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in _OUT], *_KEPT, *([T.StructField("text", T.StringType())] if texts else [])]))


def sample_edits(docs: DataFrame) -> DataFrame:
    """Three edits of every document: words put in at a quarter, ten code points cut at the
    half, and five replaced at three quarters of its length."""
    n = F.coalesce(F.length("text"), F.lit(0))
    one = lambda at, length, insert: F.struct(F.floor(n * at).alias("start"), F.lit(length).cast("long").alias("length"), F.lit(insert).alias("insert"))
    return docs.select("doc_id", F.inline(F.array(one(0.25, 0, " (see the note)"), one(0.5, 10, ""), one(0.75, 5, "don't"))))


def op9_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return recount(docs, sample_edits(docs), cut(trees(docs), "trees")).drop("text_key", "leaves")

"""Operator 12: alignment of the tokens of two tokenizers, by merge-path partitioning.

Every text is encoded by A (byte-level BPE, of space and text) and B (pieces with byte
fallback, of the text). The ends of their tokens, as byte offsets, are two sorted lists.
Diagonals of their merge grid at steps of ``WORK`` cut the merge into pieces of equal work;
where a diagonal meets the merge path is found by a binary search for all diagonals at
once. A piece emits for each of its A tokens the last B token that overlaps it, and whether
both end together; what a piece can't see, an end of B that the next piece begins with, is
stitched afterwards. Common ends cut the tokens into groups, and link the pair of tokens
that end there.

Documents are aligned in blocks of about ``BLOCK_BYTES``. A block keeps its links and the
distinct pairs with their counts; pairs are added up over blocks with map-side combine, the
highest count for each B id is found, and every block gets the counts of its own pairs
back. So a frequent pair is a row for each block, never for each link, and what a block
gets is bounded by its size.

Cases: null and empty texts, and texts whose tokens' bytes differ from space and text (as
with a U+2581 in it), have no tokens: zeros, and no groups; strings of special tokens are plain
text; any doc_id type is carried along, null and repeated rows each give a row; ties for the
highest count all hold it; an empty table gives no rows; other columns, of any name, are
carried in ``row``.
"""

from __future__ import annotations

import hashlib
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm import bpe
from tracelake.llm import kernels as K
from tracelake.llm.store import cut, table

A_FILE = "byte_bpe_50k.json"
B_FILE = "piece_bpe_32k.model"
WORK = 1 << 14
BLOCK_BYTES = 4 << 20
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


@lru_cache(1)
def _unnamed() -> np.ndarray:
    """Code points without a category in Python's tables, for which the libraries' tables may know one."""
    return np.array([unicodedata.category(chr(i)) == "Cn" for i in range(0x110000)])


class Pair:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.own = bpe.encoder(a_path)
        names = self.own.bytes_of
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_bytes = self.own.strings
        self.b_bytes = K.Strings([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces])
        self.digits = K.Strings([b"%d," % i for i in range(max(len(names), len(pieces)))])

    def encode_a(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has: by the cached merging of ``bpe`` with the merges of the file. Texts with a
        code point that Python has no category for go through the library."""
        buf, off = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
        ids, _, upto, _, _ = self.own.encode(buf, off)
        if (buf > 0xC2).any():
            cp, at = bpe.code_points(buf)
            odd = np.unique(np.searchsorted(off, at[_unnamed()[cp]], side="right") - 1)
            if len(odd):
                parts = np.split(ids, upto[1:-1])
                for i, x in zip(odd.tolist(), self.a.encode_batch([texts[i].decode() for i in odd.tolist()], add_special_tokens=False), strict=True):
                    parts[i] = np.array(x.ids, dtype=np.int32)
                return np.concatenate(parts), np.array([len(x) for x in parts], dtype=np.int64)
        return ids, np.diff(upto)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A, how many each text has, and the same of B; an empty text has none."""
        a, n_a = self.encode_a([b" " + t.encode() if t else b"" for t in texts])
        b = self.b.encode(texts, num_threads=1)
        n_b = np.fromiter(map(len, b), np.int64, len(b))
        return a.astype(np.int64), n_a, np.fromiter((i for x in b for i in x), np.int64, int(n_b.sum())), n_b


@lru_cache(2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def paths(a_path: str | None = None, b_path: str | None = None) -> tuple[str, str]:
    """The given vocabulary files, or those of the installed package, which are the same on every host."""
    import public_tokenizers

    return a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of A and B ends before each multiple of ``work`` in their merge, A first where both are equal."""
    d = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (low < high).any():
        open_ = low < high
        mid = (low + high) // 2
        first = np.zeros(len(d), dtype=bool)
        first[open_] = a[mid[open_]] <= b[(d - 1 - mid)[open_]]
        low, high = np.where(first, mid + 1, low), np.where(open_ & ~first, mid, high)
    return low, d - low


def piece(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A end, the number of B ends before it, and whether the next one is equal, as far as the piece shows."""
    last = np.searchsorted(b, a)
    same = np.zeros(len(a), dtype=bool)
    seen = last < len(b)
    same[seen] = b[last[seen]] == a[seen]
    return last, same


def merge(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """For each A token the last B token that overlaps it, and whether they end together."""
    at, bt = diagonals(a, b, work)
    done = [piece(a[i:k], b[j:m]) for i, k, j, m in zip(at[:-1], at[1:], bt[:-1], bt[1:], strict=True)]
    last = np.concatenate([x + j for (x, _), j in zip(done, bt, strict=False)] or [np.empty(0, np.int64)])
    same = np.concatenate([x for _, x in done] or [np.empty(0, bool)])
    for i, j in zip(at[1:-1], bt[1:-1], strict=True):  # an A end may close a piece whose equal B end opens the next
        if i > 0 and j < len(b) and a[i - 1] == b[j]:
            same[i - 1] = True
    return last, same


class Aligned:
    """Tokens and groups of some texts: ``upto_*[k]`` tokens or groups come before text k."""

    def __init__(self, p: Pair, texts: list[str | None]):
        a, n_a, b, n_b = p.encode([t or "" for t in texts])
        size = np.array([1 + len(t.encode()) if t else 0 for t in texts], dtype=np.int64)

        def spread(ok: np.ndarray):
            return a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]

        def total(x: np.ndarray, m: np.ndarray) -> np.ndarray:
            sums = np.append(0, np.cumsum(x))
            ends = np.cumsum(m)
            return sums[ends] - sums[ends - m]

        ok = (size > 0) & (total(p.a_bytes.len[a], n_a) == size) & (total(p.b_bytes.len[b], n_b) == size)
        x, y = spread(ok)
        want = np.frombuffer(b"".join(b" " + texts[i].encode() for i in np.flatnonzero(ok)), np.uint8)
        wrong = (p.a_bytes.join(x) != want) | (p.b_bytes.join(y) != want)
        if wrong.any():
            ok[np.repeat(np.flatnonzero(ok), size[ok])[wrong]] = False
            x, y = spread(ok)
        self.a, self.b, self.n_a, self.n_b = x, y, np.where(ok, n_a, 0), np.where(ok, n_b, 0)
        self.last, self.same = merge(np.cumsum(p.a_bytes.len[x]), np.cumsum(p.b_bytes.len[y]))
        self.cut_a = np.flatnonzero(self.same)
        self.cut_b = self.last[self.cut_a]
        self.upto_a, self.upto_b = (np.append(0, np.cumsum(m)) for m in (self.n_a, self.n_b))
        self.upto = np.searchsorted(self.cut_a, self.upto_a)
        self.p = p

    def links(self) -> np.ndarray:
        return self.b[self.cut_b] << 32 | self.a[self.cut_a]

    def digests(self) -> list[str]:
        """Digest of each text's groups, written a1,a2|b1;a3|b2,b3."""
        g_a, g_b = np.searchsorted(self.cut_a, np.arange(len(self.a))), np.searchsorted(self.cut_b, np.arange(len(self.b)))
        to_a, to_b = np.append(0, self.cut_a + 1), np.append(0, self.cut_b + 1)
        at_a, at_b = np.arange(len(self.a)) + to_b[g_a], np.arange(len(self.b)) + to_a[g_b + 1]
        ids, marks = np.empty(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        marks[at_a[self.cut_a]], marks[at_b[self.cut_b]] = ord("|"), ord(";")
        ends = np.cumsum(self.p.digits.len[ids])
        flat = self.p.digits.join(ids)
        flat[ends - 1] = marks
        upto = np.append(0, ends)[self.upto_a + self.upto_b]
        return [hashlib.sha256(flat[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


def _aligned(batch: pa.RecordBatch, p: Pair) -> Iterator[tuple[pa.RecordBatch, Aligned, int]]:
    column = batch.column(batch.num_columns - 1)
    buf, off = K.texts(column)
    for i, j, b, _ in K.chunks(buf, off):
        yield batch.slice(i, j - i), Aligned(p, column.slice(i, j - i).to_pylist()), len(b)


def _source(docs: DataFrame, text: str) -> DataFrame:
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return docs.select(F.struct(*(others or [F.lit(None).cast("int").alias("none")])).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))


def groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, text: str = "text") -> DataFrame:
    """(row, a_ids, b_ids, groups array<struct<a_end, b_end>>): numbers of A and B tokens up to the end of each group."""
    files, src = paths(a_path, b_path), _source(docs, text)

    def run(batches):
        for batch in batches:
            for rows, x, _ in _aligned(batch, pair(*files)):
                own = np.repeat(np.arange(rows.num_rows), np.diff(x.upto))
                ends = pa.StructArray.from_arrays([pa.array((x.cut_a + 1 - x.upto_a[own]).astype(np.int32)), pa.array((x.cut_b + 1 - x.upto_b[own]).astype(np.int32))], names=["a_end", "b_end"])
                lists = [pa.ListArray.from_arrays(pa.array(n.astype(np.int32)), v) for n, v in ((x.upto_a, pa.array(x.a.astype(np.int32))), (x.upto_b, pa.array(x.b.astype(np.int32))), (x.upto, ends))]
                yield pa.RecordBatch.from_arrays([rows.column(0), *lists], names=["row", "a_ids", "b_ids", "groups"])

    schema = T.StructType([src.schema["row"], *T._parse_datatype_string("a_ids array<int>, b_ids array<int>, groups array<struct<a_end: int, b_end: int>>").fields])
    return src.mapInArrow(run, schema)


def _block(name: str, parts: list[tuple[pa.RecordBatch, Aligned]]) -> pa.RecordBatch:
    links = np.concatenate([x.links() for _, x in parts])
    pairs, back, n = np.unique(links, return_inverse=True, return_counts=True)
    rows = pa.concat_arrays([r.column(0) for r, _ in parts])
    per = [np.concatenate([getattr(x, c) for _, x in parts]) for c in ("n_a", "n_b")] + [np.concatenate([np.diff(x.upto) for _, x in parts])] * 2
    digests = [d for _, x in parts for d in x.digests()]
    packed = zstandard.ZstdCompressor(level=1).compress(back.astype(np.int32).tobytes())

    def one(a):
        return pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)

    return pa.RecordBatch.from_arrays(
        [pa.array([name]), one(rows), *[one(pa.array(x, pa.int64())) for x in per], one(pa.array(digests, pa.string())), one(pa.array(pairs, pa.int64())), one(pa.array(n, pa.int64())), pa.array([packed], pa.binary())],
        names=["block", "rows", *_COUNTS, "groups_sha256", "pairs", "counts", "links"],
    )


def blocks(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, text: str = "text") -> DataFrame:
    """One row for each block of documents: their rows and figures, the block's distinct pairs with counts, and
    for each link the number of its pair. Names of blocks are made in the task, so the frame must be cut before use."""
    files, src = paths(a_path, b_path), _source(docs, text)

    def run(batches):
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for rows, x, n in _aligned(batch, pair(*files)):
                held.append((rows, x))
                size += n
                if size >= BLOCK_BYTES:
                    yield _block(f"{part}-{k}", held)
                    k, held, size = k + 1, [], 0
        if held:
            yield _block(f"{part}-{k}", held)

    longs = ", ".join(f"{c} array<long>" for c in (*_COUNTS, "pairs", "counts"))
    kinds = {f.name: f for f in T._parse_datatype_string(f"block string, {longs}, groups_sha256 array<string>, links binary").fields}
    order = ["block", "rows", *_COUNTS, "groups_sha256", "pairs", "counts", "links"]
    return src.mapInArrow(run, T.StructType([kinds[c] if c in kinds else T.StructField("rows", T.ArrayType(src.schema["row"].dataType)) for c in order]))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best) over all blocks: pair is b_id << 32 | a_id, best says that no pair of the B id has more links."""
    c = aligned.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("count"))
    return c.withColumn("best", F.col("count") == F.max("count").over(W.partitionBy(F.shiftright("pair", 32))))


def _told(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Rows of one block, with what its links count in the corpus."""
    pairs = np.asarray(left.column("pairs").combine_chunks().flatten())
    at = np.searchsorted(pairs, np.asarray(right.column("pair")))
    count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    count[at], best[at] = np.asarray(right.column("count")), np.asarray(right.column("best").cast(pa.int64()))
    links = np.frombuffer(zstandard.ZstdDecompressor().decompress(left.column("links")[0].as_py()), np.int32)
    cols = {c: left.column(c).combine_chunks().flatten() for c in ("rows", *_COUNTS, "groups_sha256")}
    ends = np.cumsum(np.asarray(cols["n_links"]))
    starts = ends - np.asarray(cols["n_links"])
    for name, x in (("n_best", best), ("count_sum", count)):
        sums = np.append(0, np.cumsum(x[links]))
        cols[name] = pa.array(sums[ends] - sums[starts], pa.int64())
    cols["row"] = cols.pop("rows")
    order = ["row", *_COUNTS, "n_best", "count_sum", "groups_sha256"]
    return pa.Table.from_arrays([cols[c] for c in order], names=order)


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, text: str = "text") -> DataFrame:
    """(row: struct of all columns but the text, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    done = cut(blocks(docs, a_path, b_path, text), "blocks")
    known = cut(pair_counts(done), "pairs")
    asked = done.select(F.col("block").alias("of"), F.explode("pairs").alias("pair")).join(known, "pair")
    row = T.StructField("row", done.schema["rows"].dataType.elementType)
    schema = T.StructType([row, *[T.StructField(c, T.LongType()) for c in (*_COUNTS, "n_best", "count_sum")], T.StructField("groups_sha256", T.StringType())])
    return done.groupBy("block").cogroup(asked.groupBy("of")).applyInArrow(_told, schema)


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align(docs).select("row.doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256")

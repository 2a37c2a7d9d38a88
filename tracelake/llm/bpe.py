"""Operator 8: byte-level BPE encoding and decoding, without a regex.

Pre-tokenisation works on arrays. Every code point gets a class (letter, number,
other, apostrophe that opens a contraction, and three kinds of white space told apart
by the next character). A class is a transition function on eight states; the
functions form a small monoid, so the state before every character comes from an
associative scan: blocks are scanned side by side, their totals are scanned in turn,
and the prefixes are composed in. State and class say where a slice starts. Distinct
slices go through a cache to a pair merger that advances all of them together; what comes
out of the cache, which knows slices by a hash, is compared with the text byte for byte; ids
come with the byte offset of each token, and decoding concatenates token bytes.

The pattern that the state machine stands for is the one of the rank file: optional
blank and letters, numbers or others; contractions; white space.

Cases: null text counts as empty and has no tokens; any text decodes to itself; long
runs without a boundary are merged with a heap in n log n; the cache is cleared when
full; an empty table gives no rows; other columns, of any name, are carried along or
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm import kernels as K
from tracelake.llm.store import table

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
CACHE_SLICES = 400_000
LONG_SLICE = 200
SCAN_WIDTH = 128

LETTER, NUMBER, OTHER, SHORT, LONG, BLANK, LONE, SPACE = range(8)
#: Code points with the Unicode property White_Space (fixed values).
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, AFTER_BLANK, NEED_1, NEED_2 = range(8)


def _step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether the character starts a slice."""
    if kind == LETTER and state in (NEED_1, NEED_2):
        return (CLOSED if state == NEED_1 else NEED_1), False
    if kind <= OTHER:
        return IN_LETTERS + kind, state not in (IN_LETTERS + kind, AFTER_BLANK)
    if kind in (SHORT, LONG):
        if state in (IN_OTHERS, AFTER_BLANK):
            return IN_OTHERS, False
        return (NEED_1 if kind == SHORT else NEED_2), True
    if kind == BLANK:
        return AFTER_BLANK, True
    if kind == LONE:
        return CLOSED, True
    return IN_SPACE, state != IN_SPACE


@lru_cache(1)
def _machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class and of each class at a text's start, composition, value at CLOSED, start flags)."""
    plain = [tuple(_step(s, k)[0] for s in range(8)) for k in range(8)]
    first = [tuple(_step(CLOSED, k)[0] for _ in range(8)) for k in range(8)]
    ids: dict[tuple[int, ...], int] = {}
    todo = [tuple(range(8)), *plain, *first]
    while todo:
        f = todo.pop(0)
        if f not in ids:
            ids[f] = len(ids)
            todo += [tuple(g[x] for x in f) for g in (*plain, *first)]
    n = len(ids)
    compose = np.empty((n, n), dtype=np.uint16)
    for f, i in ids.items():
        for g, j in ids.items():
            compose[i, j] = ids[tuple(g[x] for x in f)]
    starts = np.array([[_step(s, k)[1] for k in range(8)] for s in range(8)])
    return np.array([ids[f] for f in (*plain, *first)], dtype=np.uint16), compose, np.array([f[CLOSED] for f in ids], dtype=np.uint8), starts


@lru_cache(1)
def _classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))[0]
        if c == "L":
            out[i] = LETTER
        elif c == "N":
            out[i] = NUMBER
    out[WHITE] = SPACE
    return out


def scan(elements: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Inclusive scan of monoid elements (element 0 is the identity)."""
    n = len(elements)
    if n <= SCAN_WIDTH:
        out, acc = elements.copy(), 0
        for i in range(n):
            out[i] = acc = compose[acc, elements[i]]
        return out
    rows = -(-n // SCAN_WIDTH)
    side = np.zeros(rows * SCAN_WIDTH, dtype=np.uint16)
    side[:n] = elements
    side = np.ascontiguousarray(side.reshape(rows, SCAN_WIDTH).T)
    for i in range(1, SCAN_WIDTH):
        side[i] = compose[side[i - 1], side[i]]
    before = np.zeros(rows, dtype=np.uint16)
    before[1:] = scan(side[-1], compose)[:-1]
    return compose[before[None, :], side].T.ravel()[:n]


def code_points(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte at which each starts."""
    at = np.flatnonzero((b & 0xC0) != 0x80)
    lead = b[at].astype(np.int32)
    out = lead.copy()
    for low, mask, n in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        m = np.flatnonzero(lead >= low) if low == 0xF0 else np.flatnonzero((lead >= low) & (lead < low + (0x20 if low == 0xC0 else 0x10)))
        if len(m):
            v = lead[m] & mask
            for k in range(1, n + 1):
                v = (v << 6) | (b[at[m] + k] & 0x3F)
            out[m] = v
    return out, at


def slices(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every pre-token of the texts."""
    if not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cp, at = code_points(b)
    n = len(cp)
    kind = _classes()[cp]
    first = np.zeros(n + 1, dtype=bool)
    first[np.searchsorted(at, off)] = True  # texts start here; the end counts as one
    ends = first[1:]
    white = kind == SPACE
    solid = np.zeros(n, dtype=bool)  # white space with something solid right behind
    solid[:-1] = white[:-1] & ~white[1:]
    solid &= ~ends
    kind[solid] = np.where(cp[solid] == 32, BLANK, LONE)
    p = np.flatnonzero(cp == 39)
    if len(p):
        pad = np.concatenate([cp, [0, 0]])
        c1 = np.where(ends[p], 0, pad[p + 1])
        inner = ~ends[p] & ~np.concatenate([ends, [True, True]])[p + 1]
        c2 = np.where(inner, pad[p + 2], 0)
        kind[p[np.isin(c1, [ord(c) for c in "stmd"])]] = SHORT
        kind[p[((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))]] = LONG
    gens, compose, value, starts = _machine()
    opening = first[:-1]
    upto = scan(gens[kind + np.where(opening, 8, 0).astype(np.uint8)], compose)
    state = np.zeros(n, dtype=np.uint8)
    state[1:] = value[upto[:-1]]
    state[opening] = CLOSED
    s = at[np.flatnonzero(starts[state, kind])]
    return s, np.append(s[1:], len(b))


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable Latin-1 stands for
    itself, the others, in order, for the code points from 256."""
    plain = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255]
    others = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(others)}


def _read(path: str) -> tuple[dict[bytes, int], dict[int, int]]:
    """Ids of the byte strings of a rank file or of a vocabulary with merges, and the id, which is also the rank, of
    each pair of ids that may be merged: by ranks, all whose bytes are a token; else those listed."""
    if path.endswith(".json"):
        letters = byte_letters()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        named = {name: bytes(map(letters.__getitem__, name)) for name in model["vocab"] if all(c in letters for c in name)}
        ids = {b: model["vocab"][name] for name, b in named.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        if made != sorted(made):
            raise ValueError("ids must follow the order of merges")
        return ids, {(model["vocab"][a] << 20) | model["vocab"][b]: i for (a, b), i in zip(merges, made, strict=True)}
    with open(path, "rb") as f:
        ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ids, {(ids[b[:k]] << 20) | ids[b[k:]]: i for b, i in ids.items() for k in range(1, len(b)) if b[:k] in ids and b[k:] in ids}


class Encoder:
    """The ranks of one file with a bounded cache of encoded slices. One for each task process."""

    def __init__(self, path: str):
        ranks, pairs = _read(path)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.strings = K.Strings(self.bytes_of)
        self.size_of = self.strings.len
        self.single = np.zeros(256, dtype=np.int64)
        for i in range(256):
            self.single[i] = ranks[bytes([i])]
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.pool = np.empty(1 << 16, dtype=np.int32)
        self.at = np.zeros(1 << 14, dtype=np.int64)
        self.len = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    NONE = np.int64(1) << 40

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        q = (a << 20) | b
        i = np.minimum(np.searchsorted(self.keys, q), len(self.keys) - 1)
        return np.where(self.keys[i] == q, self.made[i], self.NONE)

    def merge(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces (concatenated bytes, sizes >= 1) and how many each has."""
        n = len(size)
        ids, own = self.single[flat], np.repeat(np.arange(n), size)
        rank = np.full(len(ids), self.NONE)
        if len(ids) > 1:
            rank[:-1] = np.where(own[:-1] == own[1:], self._rank(ids[:-1], ids[1:]), self.NONE)
        done_ids, done_own = [], []
        while len(ids):
            head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            count = np.diff(np.append(head, len(own)))
            low = np.repeat(np.minimum.reduceat(rank, head), count)
            live = low < self.NONE
            if not live.all():
                done_ids.append(ids[~live])
                done_own.append(own[~live])
                ids, own, rank, low = ids[live], own[live], rank[live], low[live]
                if not len(ids):
                    break
            p = np.flatnonzero(rank == low)
            p = p[np.append(True, own[p[1:]] != own[p[:-1]])]  # the leftmost of each piece
            ids[p] = rank[p]
            keep = np.ones(len(ids), dtype=bool)
            keep[p + 1] = False
            ids, own, rank = ids[keep], own[keep], rank[keep]
            p = p - np.arange(len(p))
            p = np.concatenate([p, p[(p > 0)] - 1])
            nxt = np.minimum(p + 1, len(ids) - 1)
            rank[p] = np.where((nxt > p) & (own[p] == own[nxt]), self._rank(ids[p], ids[nxt]), self.NONE)
        ids, own = np.concatenate(done_ids), np.concatenate(done_own)
        order = np.argsort(own, kind="stable")
        return ids[order].astype(np.int32), np.bincount(own, minlength=n)

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same for one long piece: a heap of pairs over a linked list."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        pairs, heap = self.pairs, []

        def push(i: int) -> None:
            j = right[i]
            if j < n and (r := pairs.get((ids[i] << 20) | ids[j])) is not None:
                heap.append((r, i, ids[i], ids[j])) if building else heapq.heappush(heap, (r, i, ids[i], ids[j]))

        building = True
        for i in range(n - 1):
            push(i)
        heapq.heapify(heap)
        building = False
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = r, False, right[j]
            if right[i] < n:
                left[right[i]] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        return np.array([x for x, y in zip(ids, alive, strict=True) if y], dtype=np.int32)

    def _learn(self, b: np.ndarray, h: list[int], s: np.ndarray, e: np.ndarray) -> None:
        size = e - s
        short = size <= LONG_SLICE
        if short.any():
            n = size[short]
            flat = b[np.repeat(s[short] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]
            ids, counts = self.merge(flat, n)
        else:
            ids, counts = np.empty(0, np.int32), np.empty(0, np.int64)
        total, lens, parts = np.zeros(len(s), dtype=np.int64), counts, [ids]
        total[short] = lens
        for i in np.flatnonzero(~short):
            x = self.merge_long(b[s[i] : e[i]].tobytes())
            total[i] = len(x)
            parts.append(x)
        order = np.concatenate([np.flatnonzero(short), np.flatnonzero(~short)])
        new = np.concatenate(parts)
        k, start = len(self.known), self.used
        while self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while k + len(s) > len(self.at):
            self.at, self.len = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.len, np.zeros_like(self.len)])
        self.pool[start : start + len(new)] = new
        self.used += len(new)
        run = total[order]
        self.len[k : k + len(s)] = run
        self.at[k : k + len(s)] = start + np.cumsum(run) - run
        for i, x in enumerate(order.tolist()):
            self.known[h[x]] = k + i

    def _looked_up(self, b: np.ndarray, key: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all slices, and how many each has; slices with equal keys are encoded once."""
        h, first, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.known) > CACHE_SLICES:
            self._clear()
        hs = h.tolist()
        miss = [i for i, x in enumerate(hs) if x not in self.known]
        if miss:
            m = first[miss]
            self._learn(b, [hs[i] for i in miss], s[m], e[m])
        entry = np.fromiter((self.known[x] for x in hs), dtype=np.int64, count=len(hs))
        at, n = self.at[entry][back], self.len[entry][back]
        ends = np.cumsum(n)
        return self.pool[np.repeat(at - (ends - n), n) + np.arange(ends[-1])], n

    def encode(self, b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, byte offset of each token, tokens up to each text, pre-token starts, tokens of each pre-token)."""
        s, e = slices(b, off)
        if not len(s):
            z = np.zeros(0, np.int64)
            return z.astype(np.int32), z, np.zeros(len(off), np.int64), z, z
        ids, n = self._looked_up(b, K.slice_hash(K.prefix(b, K.RAW_CODES), s, e), s, e)
        if not np.array_equal(self.strings.join(ids), b):  # a slice got the ids of another one with its hash
            number: dict[bytes, int] = {}
            own = [number.setdefault(b[i:j].tobytes(), len(number)) for i, j in zip(s.tolist(), e.tolist(), strict=True)]
            self._clear()
            ids, n = self._looked_up(b, np.array(own, dtype=np.uint64), s, e)
            self._clear()
        width = self.size_of[ids]
        begin = np.cumsum(width) - width
        return ids, begin, np.searchsorted(begin, off), s, n

    def decode(self, ids: np.ndarray) -> bytes:
        return self.strings.join(ids).tobytes()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def rank_path(name: str = RANK_FILE) -> str:
    """Where the installed package of public vocabularies keeps the file; the same on every host."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _chunks(batch: pa.RecordBatch, path: str):
    """(rows of the batch, ids and offsets in its text of each of them), about a megabyte of texts at a time;
    the texts are the last column."""
    enc = encoder(path)
    buf, off = K.texts(batch.column(batch.num_columns - 1))
    for i, j, b, o in K.chunks(buf, off):
        ids, begin, upto, _, _ = enc.encode(b, o)
        yield batch.slice(i, j - i), ids, begin - np.repeat(o[:-1], np.diff(upto)), upto


def _row(df: DataFrame, *without: str) -> Column:
    """The other columns as one struct, whose field names can't clash with those of a result."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in without]
    return F.struct(*(others or [F.lit(None).cast("int").alias("none")])).alias("row")


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """(row: struct of all columns but the text, ids array<int>, offsets array<long>: byte of each token in its text)."""
    path = path or rank_path()
    src = docs.select(_row(docs, text), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for rows, flat, begin, upto in _chunks(batch, path):
                ends = pa.array(upto.astype(np.int32))
                ids, at = pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(begin, pa.int64()))
                yield pa.RecordBatch.from_arrays([rows.column(0), ids, at], names=["row", "ids", "offsets"])

    return src.mapInArrow(run, T.StructType([src.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("offsets", T.ArrayType(T.LongType()))]))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(row, text) of rows with row and ids; null ids give an empty text."""
    path = path or rank_path()
    src = encoded.select("row", "ids")

    def run(batches):
        for batch in batches:
            enc = encoder(path)
            out = [enc.decode(np.array(x or [], dtype=np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "text"])

    return src.mapInArrow(run, T.StructType([src.schema["row"], T.StructField("text", T.StringType())]))


def _digests(path: str):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for rows, flat, _, upto in _chunks(batch, path):
                a, d = [], []
                for i, j in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
                    a.append(hashlib.sha256(",".join(map(str, flat[i:j].tolist())).encode()).hexdigest())
                    d.append(hashlib.sha256(enc.decode(flat[i:j])).hexdigest())
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(np.diff(upto), pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=[*batch.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return docs.mapInArrow(_digests(rank_path()), schema)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their texts in place of the texts, and the number of ids. Columns of
    the documents that are called ids or n_tokens get an underscore, or as many as make the name new."""
    others = [c for c in docs.columns if c != "text"]
    taken, named = {"ids", "n_tokens", *others}, {}
    for c in others:
        new = c
        while c in ("ids", "n_tokens") and new in taken:
            new += "_"
        named[c] = new
        taken.add(new)
    out = encode(docs)
    return out.select(*[F.col("row").getField(c).alias(named[c]) for c in others], "ids", F.size("ids").cast("long").alias("n_tokens"))

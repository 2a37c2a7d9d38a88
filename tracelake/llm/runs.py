"""Operator 11: periodic runs of words, found with string synchronising sets.

A run is a stretch of words with smallest period q, at least ``EXPONENT`` times as long as q,
that no neighbouring word extends. Texts are sequences of word numbers; some documents
are searched together, set apart by numbers that occur once.

Periods below ``SMALL`` are found directly, from stretches of words that equal the word q
before. For longer ones, scale t = 4, 8, 16, ... finds the periods from 2t to 4t - 1. Each
window of t words has a hash; the windows inside a run of a period up to t / 3, known from
smaller scales, count as highly periodic and have none. Position i is in the
synchronising set if the least hash of windows i .. i + t stands at i or at i + t. Whether i is in
depends on the 2t words from i only, so a run of period q that holds i also holds i + q. And every t
consecutive positions hold one, unless they are in a highly periodic region, whose
period a smaller scale has found. So positions with equal contexts (2.5t, 3t, 3.5t or 4t
words, the first of them that is as long as q) follow each other at distance q in a run,
and only at q, as the context is no shorter than q. Such a pair proposes q; pairs of one
period that overlap are one stretch, which is extended both ways by comparing words. What
the hashes propose is thus verified word for word.

``numbers`` are exact (a dictionary of the words), hashes of windows are built by doubling, from mixed
halves. Scales go on while a text is long enough for them; each costs some passes over the
texts that are left, and the sets thin out as t grows.

Cases: null, empty and blank texts have no words and no runs; a very long text is a batch of
its own; repeated rows and any type of doc_id are allowed, each row gives a row; in the query a
null doc_id leaves the text as it is; an empty table gives no rows; other columns, of any name,
are carried in ``row``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm import kernels as K
from tracelake.llm.store import table

EXPONENT = 3
LEAST = 24
SMALL = 8
#: Words compared at once for one stretch, and for all of them.
STEP, AT_ONCE = 16, 1 << 20

_U = np.uint64
_NONE = ~_U(0)


def stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


def least_of(x: np.ndarray, k: int) -> np.ndarray:
    """The least of every ``k`` neighbours: from running minima of blocks of k, forwards and backwards."""
    n = len(x) - k + 1
    y = np.full(-(-len(x) // k) * k, _NONE)
    y[: len(x)] = x
    y = y.reshape(-1, k)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[k - 1 : k - 1 + n])


def equal_ahead(w: np.ndarray, at: np.ndarray, period: np.ndarray, sign: int) -> np.ndarray:
    """For each position, how many words from it on (or before it) equal those ``period`` later."""
    n, out = len(w), np.zeros(len(at), np.int64)
    open_, step = np.arange(len(at)), STEP
    while len(open_):
        left = []
        for k in range(0, len(open_), max(1, AT_ONCE // step)):
            o = open_[k : k + max(1, AT_ONCE // step)]
            x = (at[o] + sign * out[o] - (sign < 0))[:, None] + sign * np.arange(step)
            y = x + period[o][:, None]
            inside = (x >= 0) & (y < n)
            same = inside & (w[np.where(inside, x, 0)] == w[np.where(inside, y, 0)])
            full = same.all(axis=1)
            out[o] += np.where(full, step, same.argmin(axis=1))
            left.append(o[full])
        open_, step = np.concatenate(left), min(2 * step, AT_ONCE)
    return out


class Runs:
    """Runs of at least EXPONENT periods in the order in which they were found: start, end, period."""

    def __init__(self, n: int):
        self.n = n
        self.start, self.end, self.period = (np.empty(0, np.int64) for _ in range(3))

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        """Takes maximal stretches of a period; one that a smaller period of it fills is known already."""
        long = end - start >= EXPONENT * period
        found = np.unique(np.stack([start[long], end[long], period[long]], axis=1), axis=0)
        if not len(found):
            return
        known, m = {}, np.isin(self.start << 32 | self.end, found[:, 0] << 32 | found[:, 1])
        for s, e, p in zip(self.start[m].tolist(), self.end[m].tolist(), self.period[m].tolist(), strict=True):
            known.setdefault((s, e), []).append(p)
        new = [r for r in found.tolist() if not any(r[2] % p == 0 for p in known.get((r[0], r[1]), ()))]
        s, e, p = np.array(new, dtype=np.int64).reshape(-1, 3).T
        self.start, self.end, self.period = np.append(self.start, s), np.append(self.end, e), np.append(self.period, p)

    def periodic(self, top: int, width: int) -> np.ndarray:
        """Which windows of ``width`` lie in a run of a period of at most ``top``."""
        m = (self.period <= top) & (self.end - self.start >= width)
        d = np.zeros(self.n + 1, np.int64)
        np.add.at(d, self.start[m], 1)
        np.add.at(d, self.end[m] - width + 1, -1)
        return np.cumsum(d[:-1]) > 0


def double(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of windows of twice the width ``k``."""
    return K.mix(K.mix(h[:-k] + _U(0x9E3779B97F4A7C15)) ^ h[k:])


def propose(n: int, h: np.ndarray, half_h: np.ndarray, member: np.ndarray, t: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(position, period, context) of pairs of positions that follow each other among those with equal contexts.
    ``h`` and ``half_h`` are the hashes of windows of t and t / 2 of the ``n`` words."""
    half = t // 2
    for halves in (5, 6, 7, 8):
        width = halves * half
        at = member[member + width <= n]
        x = double(h, t)[at]
        if halves >= 6:
            x = K.mix(x + h[at + 2 * t]) if halves < 8 else K.mix(x + double(h, t)[at + 2 * t])
        if halves % 2:
            x = K.mix(x ^ K.mix(half_h[at + width - half] + _U(halves)))
        order = np.argsort(x, kind="stable")
        x, at = x[order], at[order]
        gap = np.diff(at)
        m = np.flatnonzero((x[1:] == x[:-1]) & (gap >= (2 * t if halves == 5 else width - half + 1)) & (gap <= width) & (gap < 4 * t))
        yield at[m], gap[m], width


def merged(at: np.ndarray, period: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of each period that the pairs vouch for, joined where they touch."""
    order = np.lexsort((at, period))
    at, period, end = at[order], period[order], (at + width)[order]
    base = period * (int(end.max()) + 1 if len(end) else 1)
    top = np.maximum.accumulate(end + base)
    first = np.ones(len(at), dtype=bool)
    first[1:] = at[1:] + base[1:] > top[:-1]
    lead = np.flatnonzero(first)
    return at[lead], (np.maximum.reduceat(end + base, lead) - base[lead]) if len(lead) else end[:0], period[lead]


def runs_of(numbers: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in it, length, period) of all runs of at least LEAST words, by text, start and period, of the texts
    whose word numbers (not negative) stand at off[k] .. off[k + 1]."""
    found = Runs(int(off[-1]) + len(off) - 1)
    size = np.diff(off)
    # each text is followed by a number of its own, which no word equals
    w = np.empty(len(numbers) + len(size), np.int64)
    gap = np.cumsum(size + 1) - 1
    word = np.ones(len(w), dtype=bool)
    word[gap] = False
    w[word], w[gap] = numbers, -1 - np.arange(len(size))
    for q in range(1, SMALL):
        s, e = stretches(w[:-q] == w[q:]) if len(w) > q else (gap[:0], gap[:0])
        found.add(s, e + q, np.full(len(s), q))
    place = np.arange(len(w))
    half = K.mix(w.astype(np.int64).view(_U) + _U(0x632BE59BD9B4E019))
    h, t = half, 1  # h: windows of t words of w; half: of t / 2
    while t < 4 and len(h) > t:
        half, h, t = h, double(h, t), 2 * t
    while t >= 4 and len(h):
        # texts shorter than three of the smallest periods of this scale go
        keep = np.repeat(size >= EXPONENT * 2 * t, size + 1)
        if not keep.any():
            break
        if not keep.all():
            size = size[size >= EXPONENT * 2 * t]
            w, place = w[keep], place[keep]
            h, half = h[keep[: len(h)]], half[keep[: len(half)]]  # windows across removed texts hold a number of their own, so they equal no other
        _scale(w, place, h, half, t, found)
        if len(h) <= t:
            break
        half, h, t = h, double(h, t), 2 * t
    text = np.searchsorted(gap, found.start)
    length = found.end - found.start
    m = np.flatnonzero(length >= LEAST)
    order = m[np.lexsort((found.period[m], found.start[m]))]
    begin = np.append(0, gap[:-1] + 1)
    return text[order], found.start[order] - begin[text[order]], length[order], found.period[order]


def _scale(w: np.ndarray, place: np.ndarray, h: np.ndarray, half: np.ndarray, t: int, found: Runs) -> None:
    """Adds the runs of periods 2t .. 4t - 1. ``place`` is where the words stood before texts were removed."""
    n = len(h)
    if n <= t:
        return
    ids = K.mix(h ^ _U(t))
    ids[ids == _NONE] -= _U(1)
    flat = found.periodic(t // 3, t)[place[:n]]
    ids[flat] = _NONE
    low = least_of(ids, t + 1)
    member = np.flatnonzero((low != _NONE) & ((ids[: len(low)] == low) | (ids[t:] == low)))
    pairs = list(propose(len(w), h, half, member, t))
    at, period = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    width = np.concatenate([np.full(len(p[0]), p[2]) for p in pairs])
    s, e, q = merged(at, period, width)
    s = s - equal_ahead(w, s, q, -1)
    e = e + equal_ahead(w, e, q, 1)
    long = e - s >= (EXPONENT - 1) * q
    s, e, q = s[long], e[long], q[long]
    # what the hashes vouched for is compared as well
    sure = np.array([bool((w[a:b] == w[a + p : b + p]).all()) for a, b, p in zip(s.tolist(), e.tolist(), q.tolist(), strict=True)], dtype=bool)
    s, e, q = s[sure], e[sure], q[sure]
    found.add(place[s], place[s] + (e - s) + q, q)


def collapsed(off: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words stay: those in no run after its first period."""
    d = np.zeros(int(off[-1]) + 1, np.int64)
    np.add.at(d, off[text] + start + period, 1)
    np.add.at(d, off[text] + start + length, -1)
    return np.cumsum(d[:-1]) <= 0


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of some texts with their numbers, and how many come before each text."""
    s, e, doc = K.words(buf, off, K.SPACED)
    flat = np.ascontiguousarray(buf[K.SPACED[buf]])
    ends = np.append(0, np.cumsum(e - s))
    words = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)])
    return words.dictionary_encode(), np.searchsorted(doc, np.arange(len(off)))


def repeat_from(numbers: np.ndarray, off: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The word numbers with each word of text k from start[k] on taken from the ``period[k]`` words there; a period of 0 leaves a text alone."""
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    i = np.arange(len(numbers)) - off[text]
    a, p = start[text], period[text]
    return numbers[off[text] + np.where((p > 0) & (i >= a), a + (i - a) % np.maximum(p, 1), i)]


def _found(batch: pa.RecordBatch, planted: bool):
    """(rows, words, numbers, offsets, runs) of some texts of a batch; its last column is the texts, the one before it h or null."""
    buf, off = K.texts(batch.column(batch.num_columns - 1))
    for i, j, b, o in K.chunks(buf, off):
        rows = batch.slice(i, j - i)
        words, at = _words(b, o)
        numbers = np.asarray(words.indices).astype(np.int64)
        if planted:
            n, h = np.diff(at), np.asarray(pc.fill_null(rows.column(rows.num_columns - 2), -1))
            g, on = h // 10, (h >= 0) & (h % 10 == 0) & (n > 0)
            a = np.where(on, g % np.maximum(n, 1), 0)
            numbers = repeat_from(numbers, at, a, np.where(on, 1 + (n - a) // (3 + g % 8), 0))
        yield rows, words.dictionary, numbers, at, runs_of(numbers, at)


def _kept(dictionary: pa.Array, numbers: np.ndarray, off: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The words that stay of each text, joined by one blank."""
    upto = np.append(0, np.cumsum(keep))[off]
    words = dictionary.take(pa.array(numbers[keep]))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), words), pa.scalar(b" ", pa.large_binary()))


def _source(docs: DataFrame, text: str, h: Column | None = None) -> DataFrame:
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    row = F.struct(*(others or [F.lit(None).cast("int").alias("none")])).alias("row")
    return docs.select(row, *([] if h is None else [h.alias("h")]), F.col(f"`{text}`").cast("string").alias("text"))


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row: struct of all columns but the text, runs array<struct<start, length, period>>, collapsed): word numbers
    from 0, and the text without the words that runs repeat."""
    src = _source(docs, text)

    def run(batches):
        for batch in batches:
            for rows, dictionary, numbers, off, (doc, *parts) in _found(batch, False):
                keep = collapsed(off, doc, *parts)
                upto = pa.array(np.searchsorted(doc, np.arange(rows.num_rows + 1)).astype(np.int32))
                runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in parts], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(upto, runs), _kept(dictionary, numbers, off, keep).cast(pa.large_string()).cast(pa.string())], names=["row", "runs", "collapsed"])

    schema = T.StructType([src.schema["row"], *T._parse_datatype_string("runs array<struct<start: long, length: long, period: long>>, collapsed string").fields])
    return src.mapInArrow(run, schema)


def _best(start: list[int], length: list[int], period: list[int]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period; ties go by start, then period, the order of the lists."""
    best = None
    for r in zip(start, length, period, strict=True):
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


_RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digests(batches):
    for batch in batches:
        for rows, dictionary, numbers, off, (doc, *parts) in _found(batch, True):
            texts = _kept(dictionary, numbers, off, collapsed(off, doc, *parts))
            upto = np.searchsorted(doc, np.arange(rows.num_rows + 1)).tolist()
            lists, out = [x.tolist() for x in parts], []
            for k in range(rows.num_rows):
                own = [x[upto[k] : upto[k + 1]] for x in lists]
                s, n, p = _best(*own) or (None, None, None)
                lines = "".join(f"{a},{b},{c}\n" for a, b, c in zip(*own, strict=True))
                out.append((len(own[0]), s, n, p, 1000 * n // p if n else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(texts[k].as_buffer()).hexdigest()))
            names = [f.split()[0] for f in _RESULT.split(", ")]
            kinds = [pa.string() if x.endswith("sha256") else pa.int64() for x in names]
            yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]], names=["row", *names])


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    src = _source(docs, "text", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    found = src.mapInArrow(_digests, T.StructType([src.schema["row"], *T._parse_datatype_string(_RESULT).fields]))
    return found.select("row.doc_id", *[f.split()[0] for f in _RESULT.split(", ")])

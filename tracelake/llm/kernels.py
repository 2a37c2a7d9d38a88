"""Array kernels over batches of texts, used inside Arrow tasks.

A batch of texts is one byte buffer and an offset array. All kernels work on
chunks of a quarter of a megabyte (a longer text is a chunk of its own), so their memory
is bounded by the longest text, and cost a fixed number of passes over the bytes.
Slices are hashed by a polynomial over their bytes modulo the prime 2**61 - 1 at a drawn point:
two different slices of up to n bytes agree for at most n of the 2**61 points, whatever
their bytes are. ``rolling`` is cheaper and can be fooled by structured text, so it only serves
where equal hashes cost work and never change a result.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

#: Arrays from this size on are mapped, and free memory above the second number is handed back.
MAPPED, SPARE = 4 << 20, 32 << 20


def _lean_worker() -> None:
    """Workers live on between tasks, and by default keep what their largest task has freed. Here large arrays go back
    to the system as soon as they are freed."""
    name = ctypes.util.find_library("c")
    libc = ctypes.CDLL(name) if name else None
    if libc is not None and hasattr(libc, "mallopt"):  # not every C library has it
        libc.mallopt(-3, MAPPED)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, SPARE)  # M_TRIM_THRESHOLD
    pa.set_memory_pool(pa.system_memory_pool())


if TaskContext.get() is not None:
    _lean_worker()

CHUNK_BYTES = 1 << 18
#: Strings whose bytes are put together at once.
SLICE = 1 << 18

_U = np.uint64
_P = _U((1 << 61) - 1)
_LOW31, _LOW30 = _U((1 << 31) - 1), _U((1 << 30) - 1)
#: Points at which slices are hashed; drawn once, the same on all hosts.
_POINTS = [int(x) for x in np.random.default_rng(20240229).integers(1 << 50, (1 << 61) - 1, 2)]
#: Bytes of a slice whose sum of codes times half powers is below 2**64.
_EXACT = 1 << 24
_JOIN = _U(0x9E3779B97F4A7C15)
_ODD = 0x9E3779B97F4A7C15
_ODD_INV = pow(_ODD, -1, 1 << 64)
RAW_CODES = np.arange(1, 257, dtype=_U)
_LOWER_BYTES = np.arange(256, dtype=np.uint8)
_LOWER_BYTES[65:91] += 32
LOWER_CODES = RAW_CODES[_LOWER_BYTES]

#: [^\x20\x09-\x0D]+
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_TABLES: dict[int, tuple[np.ndarray, ...]] = {}


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of numbers below it."""
    a1, a0, b1, b0 = a >> _U(31), a & _LOW31, b >> _U(31), b & _LOW31
    mid = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << _U(1)) + (mid >> _U(30)) + ((mid & _LOW30) << _U(31)) + a0 * b0)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _U(61))
    return np.minimum(x, x - _P)  # x - P wraps to a large number if x is below P


def _powers(n: int, which: int) -> tuple[np.ndarray, ...]:
    """Low 31 and high bits of the first ``n`` powers of a point, and its inverse powers."""
    if which not in _TABLES or len(_TABLES[which][0]) < n:
        size, out = max(n, CHUNK_BYTES + 1), []
        for x in (_POINTS[which], pow(_POINTS[which], -1, int(_P))):
            t = np.ones(1, dtype=_U)
            while len(t) < size:
                t = np.concatenate([t, times(t, np.full(len(t), pow(x, len(t), int(_P)), dtype=_U))])
            out.append(t[:size])
        _TABLES[which] = (out[0] & _LOW31, out[0] >> _U(31), out[1])
    return _TABLES[which]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers modulo 2**64 for ``rolling``, and their inverses."""
    if -1 not in _TABLES or len(_TABLES[-1][0]) < n:
        out = []
        for base in (_ODD, _ODD_INV):
            x = np.full(max(n, CHUNK_BYTES + 1), base, dtype=_U)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _TABLES[-1] = tuple(out)
    return tuple(t[:n] for t in _TABLES[-1])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_large_binary(column.type) else "")
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(buf: np.ndarray, off: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, bytes, offsets) with at most ``size`` bytes, or one text."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        j = min(j, n)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(buf: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of bytes of ``kind`` inside a text."""
    m = kind[buf]
    if not len(m):
        e = np.empty(0, np.int64)
        return e, e, e
    first = np.zeros(len(m) + 1, dtype=bool)
    first[off] = True
    opens = m.copy()
    opens[1:] &= ~m[:-1] | first[1:-1]
    closes = m.copy()
    closes[:-1] &= ~m[1:] | first[1:-1]
    s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return s, e, np.searchsorted(off, s, side="right") - 1


def prefix(buf: np.ndarray, codes: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Running sums from which ``slice_hash`` reads the hash of any slice; ``which`` picks the point."""
    low, high, _ = _powers(len(buf) + 1, which)
    c, out = codes[buf], []
    for half in (low, high):
        x = np.zeros(len(buf) + 1, dtype=_U)
        np.cumsum(c * half[: len(buf)], out=x[1:])
        out.append(x)
    return out[0], out[1], which


def slice_hash(sums: tuple[np.ndarray, np.ndarray, int], s: np.ndarray, e: np.ndarray) -> np.ndarray:
    low, high, which = sums
    total, at = np.zeros(len(s), dtype=_U), s
    while True:  # the sums wrap around, but differences over so many bytes are exact
        to = np.minimum(e, at + _EXACT)
        h = _reduced(high[to] - high[at])
        total = _reduced(total + (h >> _U(30)) + ((h & _LOW30) << _U(31)) + _reduced(low[to] - low[at]))
        if (to == e).all():
            return mix(times(total, _powers(len(low), which)[2][s]))
        at = to


def rolling(buf: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` bytes, modulo 2**64."""
    p, q = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=_U)
    np.cumsum(mix(RAW_CODES)[buf] * p[: len(buf)], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * q[: len(buf) - width + 1])


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of two hashes in order."""
    return mix(mix(a + _JOIN) ^ b)


def window_hash(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start numbers and hashes of all ``k`` consecutive items of one text: joined from windows of the powers of two in ``k``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, _U)
    out, done, width = None, 0, 1
    while done < k:
        if k & width:
            part = h[done : done + n]
            out, done = part if out is None else join(out, part), done + width
        if done < k:
            h, width = join(h[:-width], h[width:]), 2 * width
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return at, join(out, np.full(n, k, dtype=_U))[at]


class Strings:
    """Byte strings by number, to be put together for arrays of numbers."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.len = np.fromiter(map(len, strings), np.int64, len(strings))
        self.start = np.cumsum(self.len) - self.len

    def join(self, ids: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(ids), SLICE):
            x = ids[i : i + SLICE]
            n = self.len[x]
            ends = np.cumsum(n)
            out.append(self.flat[np.repeat(self.start[x] - ends + n, n) + np.arange(ends[-1])])
        return np.concatenate(out) if out else np.empty(0, np.uint8)


def per_doc(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights=weights, minlength=n).astype(np.int64)


def repeated(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items in order: does an equal one of the same text exist; does one come earlier."""
    key = mix(h + doc.astype(_U) * _U(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    later = np.zeros(len(key), dtype=bool)
    later[order[1:]] = same
    any_ = later.copy()
    any_[order[:-1]] |= same
    return any_, later


def covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Mask of the items inside windows of ``k`` that start at ``at``."""
    d = np.zeros(n + 1, dtype=np.int64)
    np.add.at(d, at, 1)
    np.add.at(d, at + k, -1)
    return np.cumsum(d[:-1]) > 0

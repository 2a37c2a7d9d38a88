"""Induced sorting of the suffixes of one shard, with common-prefix values, beyond memory.

Suffixes are tuples (position, length of the prefix shared with the tuple before it)
in a priority queue by first byte. The queue hands out tuples in suffix order; each
induces the suffix one byte longer, whose shared prefix is one more than the least of
the values passed since the last tuple of its bucket. Inside a bucket tuples come out
as they went in, so the queue is an array of 256 runs, and runs beyond ``MEMORY`` bytes
go to disk. Suffixes that start an ascent (LMS) are sorted first: by an induction of
their own up to the next one, which names them, and recursion on the string of names.
That string has about as many names as places, so it is the base case, sorted by
prefix doubling, as far as ``depth`` bytes reach.

Tuples are processed in blocks as arrays. Values are cut at ``depth``, and the order of
suffixes that agree on ``depth`` bytes is arbitrary.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

MEMORY = 192 << 20
BLOCK = 1 << 16
GATHER = 1 << 20


class BucketQueue:
    """256 first-in first-out runs of (position, shared prefix) blocks; the largest go to disk."""

    def __init__(self, folder: str, memory: int = MEMORY):
        self.runs: list[list] = [[] for _ in range(256)]
        self.held = [0] * 256
        self.folder, self.memory, self.files = folder, memory, 0

    def push(self, c: int, pos: np.ndarray, shared: np.ndarray) -> None:
        self.runs[c].append((pos, shared))
        self.held[c] += pos.nbytes + shared.nbytes
        if sum(self.held) > self.memory:
            big = int(np.argmax(self.held))
            for i, x in enumerate(self.runs[big]):
                if not isinstance(x, str):
                    path = os.path.join(self.folder, f"{id(self)}-{self.files}.npz")
                    np.savez(path, *x)
                    self.files, self.runs[big][i] = self.files + 1, path
            self.held[big] = 0

    def blocks(self, c: int, backwards: bool = False):
        """The tuples of a run in order, many at a time, also those that are pushed meanwhile."""
        i = 0
        while i < len(self.runs[c]):
            got, n = [], 0
            while i < len(self.runs[c]) and n < GATHER:
                x = self.runs[c][-1 - i if backwards else i]
                if isinstance(x, str):
                    with np.load(x) as f:
                        x = (f["arr_0"], f["arr_1"])
                got.append(x)
                n += len(x[0])
                i += 1
            if backwards:
                got.reverse()
            yield tuple(map(np.concatenate, zip(*got, strict=True))) if len(got) > 1 else got[0]


class _Scan:
    """One induction: what the tuples that were handed out induce."""

    def __init__(self, text: np.ndarray, queue: BucketQueue, depth: int, values: bool):
        self.text, self.queue, self.depth, self.values = text, queue, depth, values
        self.least = np.full(256, 255, dtype=np.uint8)  # of the values passed since the bucket's last tuple
        self.seen = np.zeros(256, dtype=bool)

    def feed(self, pos: np.ndarray, shared: np.ndarray, low: int, high: int) -> None:
        """Hand out tuples; those before which a byte in low .. high stands induce."""
        for a in range(0, len(pos), BLOCK):
            self._feed(pos[a : a + BLOCK], shared[a : a + BLOCK], low, high)

    def _feed(self, pos: np.ndarray, shared: np.ndarray, low: int, high: int) -> None:
        before = self.text[np.maximum(pos - 1, 0)]
        at = np.flatnonzero((pos > 0) & (before >= low) & (before <= high))
        if not len(at):
            np.minimum(self.least, shared.min(), out=self.least)
            return
        target = before[at]
        order = np.argsort(target, kind="stable")
        at, target = at[order], target[order]
        head = np.append(True, target[1:] != target[:-1])
        heads = np.flatnonzero(head)
        if self.values:
            value = self._value(at, target, head, heads, shared)
        else:
            value = np.zeros(len(at), dtype=np.uint8)
        new = pos[at] - 1
        for c, i, j in zip(target[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(at)], strict=True):
            self.queue.push(c, new[i:j], value[i:j])

    def _value(self, at: np.ndarray, target: np.ndarray, head: np.ndarray, heads: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """What each induced suffix shares with the one before it in its bucket."""
        lows = np.empty(len(at), dtype=np.uint8)
        upto = np.minimum.accumulate(shared)
        lows[heads] = np.minimum(upto[at[heads]], self.least[target[heads]])
        rest = np.flatnonzero(~head)
        if len(rest):
            lows[rest] = _range_min(shared, at[rest - 1] + 1, at[rest])
        value = np.minimum(lows.astype(np.int32) + 1, self.depth).astype(np.uint8)
        named = target[heads]
        value[heads[~self.seen[named]]] = 0
        ends = np.append(heads[1:], len(at))
        behind = np.append(np.minimum.accumulate(shared[::-1])[::-1], np.uint8(255))
        np.minimum(self.least, upto[-1], out=self.least)
        self.least[named] = behind[at[ends - 1] + 1]
        self.seen[named] = True
        return value


def _range_min(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of x[lo..hi], both included."""
    span = hi - lo + 1
    out = x[hi].copy()
    far = np.flatnonzero(span > 1)
    if len(far):
        level = np.frexp(span[far].astype(np.float64))[1] - 1
        table, k = x, 0
        for k in range(int(level.max()) + 1):
            m = far[level == k]
            if len(m):
                out[m] = np.minimum(table[lo[m]], table[hi[m] - (1 << k) + 1])
            step = 1 << k
            if len(table) > step:
                table = np.minimum(table[:-step], table[step:])
    return out


class Sorter:
    def __init__(self, text: np.ndarray, depth: int, folder: str, memory: int = MEMORY):
        self.text, self.depth, self.folder, self.memory = text, depth, folder, memory
        n = len(text)
        turn = np.flatnonzero(text[:-1] != text[1:])
        ends = np.append(turn, n - 1)
        width = np.diff(ends, prepend=-1)
        rising = np.append(text[turn] < text[turn + 1], False)
        self.kind = np.repeat(rising, width)
        self.left_in_run = np.minimum(np.repeat(ends, width) - np.arange(n) + 1, 255).astype(np.uint8)
        lms = np.flatnonzero(self.kind[1:] & ~self.kind[:-1]) + 1
        self.lms = lms

    def _induce(self, seeds: np.ndarray, shared: np.ndarray, values: bool = True):
        """All suffixes from the sorted LMS ``seeds``: the L queue, then a walk over the S queue. Without
        ``values`` only the order counts, and shared prefixes are left 0."""
        text, run = self.text, self.left_in_run
        first = text[seeds]
        bounds = np.searchsorted(first, np.arange(257))
        lower = BucketQueue(self.folder, self.memory)
        scan = _Scan(text, lower, self.depth, values)
        scan.queue.push(int(text[-1]), np.array([len(text) - 1], dtype=np.int64), np.zeros(1, np.uint8))
        scan.seen[text[-1]] = True
        for c in range(256):
            last = -1
            for pos, value in lower.blocks(c):
                scan.feed(pos, value, c, 255)
                last = pos[-1]
            a, z = bounds[c], bounds[c + 1]
            if z > a:
                value = shared[a:z].copy()
                value[0] = min(run[last], run[seeds[a]]) if last >= 0 else 0
                scan.feed(seeds[a:z], np.minimum(value, self.depth).astype(np.uint8), c + 1, 255)
        upper = BucketQueue(self.folder, self.memory)
        scan = _Scan(text, upper, self.depth, values)
        for c in range(255, -1, -1):
            last = -1
            for pos, value in upper.blocks(c):
                scan.feed(pos, value, 0, c)
                yield pos, value, True
                last = pos[-1]
            after = None
            for pos, value in lower.blocks(c, backwards=True):
                # backwards, a value belongs to the tuple behind
                back = pos[::-1]
                mine = np.append(np.uint8(0), value[:0:-1])
                if after is not None:
                    mine[0] = after
                elif last >= 0:
                    mine[0] = min(run[last], run[back[0]], self.depth)
                after = value[0]
                if c:
                    scan.feed(back, mine, 0, c - 1)
                else:
                    np.minimum(scan.least, mine.min(), out=scan.least)
                yield back, mine, False

    def _sorted_lms(self) -> tuple[np.ndarray, np.ndarray]:
        """LMS suffixes in order, with the prefix that each shares with the one before."""
        lms, text = self.lms, self.text
        if len(lms) < 2:
            return lms, np.zeros(len(lms), np.uint8)
        order = np.argsort(text[lms], kind="stable")
        is_lms = np.zeros(len(text), dtype=bool)
        is_lms[lms] = True
        found = [pos[is_lms[pos]] for pos, _, upper in self._induce(lms[order], np.zeros(len(lms), np.uint8), values=False) if upper]
        by_piece = np.concatenate(found)[::-1]
        number = np.empty(len(text), dtype=np.int64) if len(text) < 1 << 16 else np.zeros(len(text), dtype=np.int32)
        number[lms] = np.arange(len(lms))
        k = number[by_piece].astype(np.int64)
        size = np.append(np.diff(lms) + 1, len(text) - lms[-1])
        same = size[k[1:]] == size[k[:-1]]
        same[(k[1:] == len(lms) - 1) | (k[:-1] == len(lms) - 1)] = False
        live, j = np.flatnonzero(same), 0
        while len(live):
            differ = text[by_piece[live] + j] != text[by_piece[live + 1] + j]
            same[live[differ]] = False
            live = live[~differ]
            j += 1
            live = live[size[k[live]] > j]
        name = np.empty(len(lms), dtype=np.int64)
        name[k] = np.append(0, np.cumsum(~same))
        ranks, order = self._doubling(name)
        return lms[order], self._shared(ranks, order)

    def _doubling(self, name: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        ranks, step, m = [name], 1, len(name)
        order = np.argsort(name)
        while 2 * step <= self.depth and ranks[-1][order[-1]] < m - 1:  # a name is two bytes or more
            r = ranks[-1]
            key = (r << 32) | np.append(r[step:] + 1, np.zeros(min(step, m), np.int64))[:m]
            order = np.argsort(key)
            new = np.empty(m, dtype=np.int64)
            new[order] = np.append(0, np.cumsum(key[order[1:]] != key[order[:-1]]))
            ranks.append(new)
            step *= 2
        return ranks, order

    def _shared(self, ranks: list[np.ndarray], order: np.ndarray) -> np.ndarray:
        lms, text, m, n = self.lms, self.text, len(order), len(self.text)
        a, b = order[:-1].copy(), order[1:].copy()
        start = b.copy()
        for level in range(len(ranks) - 1, -1, -1):
            # equal ranks cover the same names, so neither reaches over the end
            r = np.append(ranks[level], -1)
            step = (r[a] == r[b]).astype(np.int64) << level
            a += step
            b += step
        at = np.append(lms, n)
        out = at[b] - lms[start]
        live = np.flatnonzero((out < self.depth) & (a < m) & (b < m))
        j = 0
        while len(live):
            x, y = lms[a[live]] + j, lms[b[live]] + j
            go = (x < n) & (y < n)
            go[go] = text[x[go]] == text[y[go]]
            live = live[go]
            out[live] += 1
            live = live[out[live] < self.depth]
            j += 1
        return np.append(0, np.minimum(out, self.depth)).astype(np.uint8)

    def repeated(self) -> np.ndarray:
        """Mask of the suffixes whose first ``depth`` bytes start another suffix too."""
        out = np.zeros(len(self.text), dtype=bool)
        seeds, shared = self._sorted_lms()
        last = -1
        for pos, value, _ in self._induce(seeds, shared):
            hit = value >= self.depth
            out[pos[hit]] = True
            before = np.append(last, pos[:-1])[hit]
            out[before] = True
            last = pos[-1]
        return out


def repeated_starts(text: np.ndarray, depth: int, memory: int = MEMORY) -> np.ndarray:
    """Mask of the places of ``text`` whose next ``depth`` bytes also start elsewhere. The last byte
    must be 0xFF, which separates strings; places closer than ``depth`` to one don't count."""
    assert 0 < depth < 255 and text[-1] == 0xFF
    with tempfile.TemporaryDirectory() as folder:
        if text.nbytes > memory:
            path = os.path.join(folder, "text")
            text.tofile(path)
            text = np.memmap(path, dtype=np.uint8, mode="r")
        return Sorter(text, depth, folder, memory).repeated()

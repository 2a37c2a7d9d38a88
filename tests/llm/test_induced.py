"""External induced sorting against a plain count, also with every run on disk."""

import collections

import numpy as np
import pytest

from tracelake.llm import induced


@pytest.mark.parametrize(("block", "gather", "memory"), [(1 << 16, 1 << 20, 1 << 26), (3, 2, 1 << 8)])
def test_repeated_starts(monkeypatch, block, gather, memory):
    monkeypatch.setattr(induced, "BLOCK", block)
    monkeypatch.setattr(induced, "GATHER", gather)
    rng = np.random.default_rng(7)
    for _ in range(80):
        k, parts = int(rng.integers(1, 5)), []
        for _ in range(int(rng.integers(1, 6))):
            s = rng.integers(65, 65 + k, int(rng.integers(0, 60))).astype(np.uint8)
            if parts and rng.random() < 0.5:
                s = np.concatenate([s, parts[int(rng.integers(len(parts)))][:-1][int(rng.integers(5)) :]])
            parts.append(np.append(s, np.uint8(255)))
        t, d = np.concatenate(parts), int(rng.integers(1, 12))
        got, b = induced.repeated_starts(t, d, memory), t.tobytes()
        seen = collections.Counter(b[i : i + d] for i in range(len(b) - d + 1))
        for i in range(len(b) - d + 1):
            if 255 not in b[i : i + d]:
                assert got[i] == (seen[b[i : i + d]] > 1)

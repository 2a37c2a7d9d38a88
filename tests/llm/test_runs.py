"""Operator 11 against a search of all periods, on random, structured and planted texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tracelake.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, row int, h string, start int, runs string"


def plain_runs(w):
    """All runs: stretches that equal what stands q later, unless a smaller period fills the same stretch."""
    n, out, seen = len(w), [], {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            k = i
            while k + q < n and w[k] == w[k + q]:
                k += 1
            length = k - i + q
            if length >= 3 * q and not any(q % p == 0 for p in seen.get((i, length), ())):
                seen.setdefault((i, length), []).append(q)
                if length >= 24:
                    out.append((i, length, q))
            i = k
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(seed):
    r = random.Random(seed)
    out = [[], [0], [0] * 23, [0] * 24, [0] * 100, [0, 1] * 11, [0, 1] * 12, list(range(50)) * 3, list(range(50)) * 2 + list(range(49))]
    for _ in range(60):
        k, n = r.choice([2, 2, 3, 5, 50, 10**6]), r.randint(1, 700)
        w = [r.randrange(k) for _ in range(n)]
        for _ in range(r.randint(0, 4)):
            p = r.choice([1, 2, 3, 5, 7, 8, 9, 13, 16, 17, 31, 32, 33, 64, 100])
            unit = w[:p] if r.random() < 0.5 else [r.randrange(k) for _ in range(p)]
            if p > 3 and r.random() < 0.4:
                unit = (unit[:2] * p)[:p]
            a, times = r.randrange(len(w) + 1), r.choice([2, 3, 3, 4, 9])
            w[a:a] = (unit * (times + 1))[: p * times + r.randrange(p + 1)]
        out.append(w)
    fib, thue = [[0], [0, 1]], [0]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    for _ in range(10):
        thue += [1 - x for x in thue]
    nested = ([0] * 10 + [1]) * 6 + [2]
    return [*out, fib[-1], thue, nested * 5, (nested + [3] * 40) * 4, [5] * 300 + [6] + [5] * 300 + [6] + [5] * 300 + [6] + [5] * 300]


@pytest.mark.parametrize("seed", range(4))
def test_all_runs_together_and_alone(seed):
    t = texts(seed)
    off = np.append(0, np.cumsum([len(x) for x in t]))
    doc, *parts = runs.runs_of(np.concatenate([np.array(x, dtype=np.int64) for x in t]), off)
    got = list(zip(doc.tolist(), *(x.tolist() for x in parts), strict=True))
    want = [(k, *r) for k, x in enumerate(t) for r in plain_runs(x)]
    assert got == want and len(want) > 40 and max(r[3] for r in want) >= 64


def plain(doc_id, text):
    w, h = WORD.findall(text or ""), -1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if h >= 0 and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_query_equals_the_plain_search(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["a", "b", "é", "字c", "x" * 300]) + "\n" * (r.random() < 0.1) for _ in range(r.randint(0, 400)))) for i in range(150)]
    rows += [(150, None), (151, ""), (152, " \t\n\x0b"), (None, "a " * 90), (None, None), *rows[:4], (153, "\x00 " * 40), (154, "ab\x85cd " * 30)]
    spark.createDataFrame([(*x, 1, "h", 2, "r") for x in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = runs.op11_periodic_runs(spark, str(tmp_path)).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted((plain(*x) for x in rows), key=key)
    assert sum(x.n_runs > 0 for x in got) > 10


def test_operator_gives_runs_and_texts(spark):
    rows = [("u-1", "start " + "x y z " * 9 + "end"), (None, None), ("u-2", "plain text")]
    got = {x.row.doc_id: x for x in runs.periodic_runs(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert [tuple(x) for x in got["u-1"].runs] == [(1, 27, 3)] and got["u-1"].collapsed == "start x y z end"
    assert got[None].runs == [] and got[None].collapsed == "" and got["u-2"].collapsed == "plain text"
    assert runs.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0

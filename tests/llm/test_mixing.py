"""Operator 13 against a plain loop, on hot, tiny, empty and null sources."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tracelake.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size string, row int, key string, target int"


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, budget = set(), 1.5 * sum(sizes.values())
    while True:
        left = [s for s in order if s not in full]
        level = (budget - sum(2 * sizes[s] for s in full)) / sum(w[s] for s in left) if left else 0
        more = {s for s in left if 2 * sizes[s] <= w[s] * level}
        if not more:
            return {s: float(2 * sizes[s]) if s in full else w[s] * level for s in order}
        full |= more


def plain(rows):
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    per = {}
    for r, n in zip(rows, size, strict=True):
        per[r[2]] = per.get(r[2], 0) + n
    goal, out = plain_targets(per), []
    for s in per:
        mine = []
        for r, n in zip(rows, size, strict=True):
            if r[2] == s:
                t = r[1] or ""
                lines = t.split("\n")
                w = 0.1 if r[1] is None else max(0.1, len(set(lines)) / len(lines) * (1 - sum(c in mixing.SYMBOLS for c in t) / max(1, len(t))))
                u = (int(hashlib.md5(f"mix-1:{'' if r[0] is None else r[0]}:{t}".encode()).hexdigest()[:13], 16) + 1) / 2**52
                mine.append((-math.log(u) / w, -1 if r[0] is None else r[0], n))
        run, epochs = 0, int(goal[s] // per[s]) if per[s] else 0
        for _, d, n in sorted(mine):
            out.append((d, n, per[s], round(goal[s], 6), n * (epochs + (2 * (goal[s] - epochs * per[s] - run) > n))))
            run += n
    return sorted(out)


def sample(n=600, seed=5):
    r = random.Random(seed)
    rows = [(i, "\n".join(" ".join("w#"[r.random() < 0.1] * r.randint(1, 5) for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 4))), r.choice(["a", "a", "a", "é", "B", "\U0001f600", "￮", None])) for i in range(n)]
    rows += [(None, "x y z", "B"), (None, None, "a"), (3, None, "nothing"), (4, " \t", "nothing"), *rows[:5], *rows[:5], (9000, "long " * 3000, "a"), (9001, "one", "tiny")]
    return [(*x, "s", 1, None, 2) for x in rows]


@pytest.mark.parametrize("bucket_rows", [3, 400])
def test_equals_the_plain_loop(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    rows = sample()
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(7)).select("row.doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted((-1 if r[0] is None else r[0], r[1], r[2], round(r[3], 6), r[4]) for r in got) == plain(rows)
    assert sum(r.taken for r in got) == pytest.approx(1.5 * sum(r.size for r in got), rel=0.1)
    assert all(0 <= r.taken <= 2 * r.size for r in got)


def test_heavy_documents_come_first(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'a b' AS text", "CASE WHEN id < 2000 THEN 'a' ELSE 'b' END AS source", "CASE WHEN id % 2 = 0 THEN 9.0 ELSE 1.0 END AS q")
    m = mixing.mix(docs, F.col("q"), share=0.4, most=1).filter("source_size > target").groupBy((F.col("row.doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("n"))
    n = {r["odd"]: r["n"] for r in m.collect()}
    assert n[0] > 1.3 * n[1]


def test_text_ids_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([("u-1", "a b", "s"), (None, "c", "s"), ("u-1", "a b", "s")], "doc_id string, text string, source string")
    assert mixing.mix(docs, F.lit(None)).count() == 3
    empty = mixing.mix(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.select("row.size", "row.key").columns == ["size", "key"]

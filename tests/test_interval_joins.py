"""Interval joins against plain loops, and on many pieces of one session."""

import random
import time

from pyspark.sql import functions as F

from tracelake.operators import intervals, segments


def spans(r, n, top=400):
    return [(r.choice("ab"), a, a + r.choice([0, 1, 3, 10, 60]), k) for k in range(n) for a in [r.randrange(top)]]


def test_subtract_overlap_and_cover(spark):
    r = random.Random(4)
    x, y = spans(r, 120), spans(r, 60) + [("c", 1, 2, 99)]
    left = spark.createDataFrame(x, "key string, a long, b long, x long").repartition(3)
    right = spark.createDataFrame(y, "key string, c long, d long, y long").repartition(3)
    got = sorted((t.x, t.a, t.b) for t in intervals.subtract(left, right.select("key", F.col("c").alias("a"), F.col("d").alias("b")), ["key"], "a", "b").collect())
    want = []
    for key, a, b, k in x:
        free = [t for t in range(a, b) if not any(key == s and c <= t and t + 1 <= d for s, c, d, _ in y)]
        # points that a zero-length busy interval splits are apart as well
        run = [t for t in free if t - 1 not in free or any(key == s and c == d == t for s, c, d, _ in y)]
        for t in run:
            e = t
            while e + 1 in free and e + 1 not in run:
                e += 1
            want.append((k, t, e + 1))
    assert got == sorted(want)
    pairs = sorted((t.x, t.y, t.overlap_ms) for t in intervals.overlap(left, right, ["key"], "a", "b", "c", "d").collect())
    assert pairs == sorted((i, j, min(b, d) - max(a, c)) for s, a, b, i in x for t, c, d, j in y if s == t and min(b, d) > max(a, c)) and len(pairs) > 100
    at = spark.createDataFrame([(k, t) for k in "abz" for t in range(-3, 470, 7)], "key string, at long")
    found = {(t.key, t["at"]): t.y for t in intervals.covered_by(at, right, ["key"], "at", "c", "d", "y").collect()}
    assert found == {(k, t): min((j for s, c, d, j in y if s == k and c <= t <= d), default=None) for k in "abz" for t in range(-3, 470, 7)}


def test_time_accounts(spark):
    r = random.Random(6)
    segs = [("s", i, f"g{i}", a, a + r.randrange(200)) for i, a in enumerate(sorted(r.randrange(1000) for _ in range(25)))] + [("t", 0, "only", 5, 9)]
    pieces = [("s", a, a + r.choice([0, 5, 50, 300]), r.choice(["user", "auto", "tail"]), None) for a in (r.randrange(-50, 1100) for _ in range(80))]
    out = segments.time_accounts(spark.createDataFrame(pieces, "session_id string, a_ms long, b_ms long, kind string, idx long"), spark.createDataFrame(segs, "session_id string, seg_no long, stage string, start_ms long, end_ms long"))
    got = {(t.session_id, t.seg_no): (t.duration_ms, t.active_ms, t.wait_ms) for t in out.collect()}
    want = {}
    for s, i, _, a, b in segs:
        over = [(max(0, min(b, d) - max(a, c)), k) for p, c, d, k, _ in pieces if p == s]
        stall = min(sum(o for o, _ in over), b - a)
        want[s, i] = (b - a, b - a - stall, min(sum(o for o, k in over if k == "user"), stall))
    assert got == want


def test_many_pieces_of_one_session(spark):
    n = 100_000
    pieces = spark.range(n).selectExpr("1 AS session_id", "id * 10 AS a_ms", "id * 10 + 7 AS b_ms", "IF(id % 2 = 0, 'user', 'auto') AS kind", "id AS idx")
    segs = spark.range(n).selectExpr("1 AS session_id", "id AS seg_no", "'g' AS stage", "id * 10 + 5 AS start_ms", "id * 10 + 25 AS end_ms")
    began = time.time()
    assert segments.time_accounts(pieces, segs).agg(F.sum("active_ms")).first()[0] == (n - 2) * (20 - 2 - 7 - 5) + 2 * 20 - (2 + 7) - 2
    busy = pieces.select("session_id", "a_ms", "b_ms")
    assert intervals.subtract(segs.select("session_id", F.col("start_ms").alias("a_ms"), F.col("end_ms").alias("b_ms"), "seg_no"), busy, ["session_id"], "a_ms", "b_ms").count() == 2 * n - 1
    at = spark.range(n).selectExpr("1 AS session_id", "id * 10 + 5 AS at_ms")
    assert segments.containing(at, segs).agg(F.sum("seg_no")).first()[0] == sum(max(0, i - 2) for i in range(n))
    assert time.time() - began < 120

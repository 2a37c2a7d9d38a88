"""Verdicts of the robust estimate against a plain minimum covariance determinant."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import quality

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, q_kept int, q_distance string, row string, group_key int, start int, n double, level string, own_key string"


def corpus():
    r = random.Random(5)
    vocabulary = {g: ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, top))) for _ in range(150)] for g, top in (("en", 8), ("de", 13))}
    data = []
    for i in range(900):
        lang, source = (("en", "a"), ("en", "b"), ("de", "a"), ("de", None))[i % 4] if i < 880 else ("xx", "rare")
        words = [r.choice(vocabulary["de" if lang == "de" else "en"]) + ("," if r.random() < 0.1 else "") for _ in range(r.randint(25, 300))]
        if i % 16 in (3, 4):
            words = [w + "###" for w in words]
        elif i % 37 == 5:
            words = [w * 5 for w in words]
        elif i % 41 == 7:
            words = [x for w in words[::3] for x in (w, f"{w}b", w)]
        data.append((i, " ".join(words), lang, source))
    data += [(1000 + k, None, "en", "a") for k in range(2)] + [(1002, "", "de", "a")]
    data += [(2000 + k, data[k % 2][1], *data[k % 2][2:]) for k in range(300)]  # copies of two texts
    return data


def vector(text):
    w = SPACED.findall(text or "")
    marks = sum(33 <= ord(c) < 127 and not c.isalnum() for c in text or "")
    near = sum(x in w[max(0, i - 50) : i] for i, x in enumerate(w))
    n, chars = len(w), sum(map(len, w))
    return math.log((chars + 500) / (n + 100)), math.log((marks + 30) / (chars + 1000)), math.log((near + 26) / (n + 200))


def base_failed(text):
    w = SPACED.findall(text or "")
    win = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = {i + k for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w) < 20 or 100 * len(rep) > 30 * len(w)


def plain_mcd(x):
    """Least determinant over many random starts, whole concentration steps on sorted distances; scaled by the median."""
    rng, best = np.random.default_rng(1), None
    h = math.ceil(quality.SHARE * len(x))
    for _ in range(30):
        own = rng.choice(len(x), 10, replace=False)
        before = None
        while before is None or set(own) != before:
            before = set(own)
            mu, cov = x[own].mean(0), np.cov(x[own].T, bias=True) + 1e-9 * np.eye(3)
            d = np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov), x - mu)
            own = np.argsort(d, kind="stable")[:h]
        if best is None or np.linalg.det(cov) < best[0]:
            best = (np.linalg.det(cov), mu, np.linalg.inv(cov))
    return best[1:]


def plain_verdicts(data):
    """(squared distance, base failed) by id; None where no estimate serves."""
    vec = {d: vector(t) for d, t, _, _ in data}
    failed = {d: base_failed(t) for d, t, _, _ in data}
    distinct = collections.defaultdict(set)
    for d, _, lang, source in data:
        if not failed[d]:
            for key in ((lang, source), lang, "*"):
                distinct[key].add(vec[d])
    out = {}
    fits = {}
    for d, _, lang, source in data:
        key = next((k for k in ((lang, source), lang, "*") if len(distinct[k]) >= quality.MIN_GROUP), None)
        if key is None:
            out[d] = (None, failed[d])
            continue
        if key not in fits:
            x = np.array(sorted(distinct[key]))
            mu, inv = plain_mcd(x)
            dist = np.einsum("ij,jk,ik->i", x - mu, inv, x - mu)
            fits[key] = (mu, inv, quality.chi_square_quantile(0.5, 3) / np.median(dist))
        mu, inv, scale = fits[key]
        v = np.array(vec[d]) - mu
        out[d] = (float(v @ inv @ v) * scale, failed[d])
    return out


@pytest.fixture(scope="module")
def judged(spark):
    data = corpus()
    docs = spark.createDataFrame([(*x, 1, "s", "r", 2, 3, 4.0, "l", "o") for x in data], SCHEMA).repartition(3)
    return data, docs, {r.doc_id: r for r in quality.judge(docs, {"doc_id": F.col("doc_id")}).collect()}


def test_verdicts_are_those_of_a_plain_estimate(judged):
    data, _, got = judged
    want = plain_verdicts(data)
    rejected = 0
    for d, (distance, failed) in want.items():
        assert got[d].q_base_failed == failed
        assert math.isclose(got[d].q_distance, distance, rel_tol=0.35, abs_tol=0.3), (d, got[d].q_distance, distance)
        if abs(math.log(distance / quality.CUTOFF)) > 0.35:
            assert got[d].q_kept == (not failed and distance <= quality.CUTOFF), d
        rejected += not failed and not got[d].q_kept
    assert 100 < rejected < 200
    clean = [i for i in range(880) if i % 16 not in (3, 4) and i % 37 != 5 and i % 41 != 7]
    assert sum(got[i].q_kept for i in clean) > 0.97 * len(clean)
    assert not any(got[i].q_kept for i in range(880) if i % 16 in (3, 4))


def test_the_covariance_decides(judged, monkeypatch):
    """With the ridge alone in place of each covariance the verdicts are others."""
    data, docs, got = judged
    plain = quality.fit

    def ridge_only(rows):
        flat = F.array(*[F.lit(1.0 / quality.RIDGE if i == j else 0.0) for i in range(3) for j in range(3)])
        return plain(rows).withColumn("inverse", flat).withColumn("scale", F.lit(1.0))

    monkeypatch.setattr(quality, "fit", ridge_only)
    other = {r.doc_id: r.q_kept for r in quality.judge(docs, {"doc_id": F.col("doc_id")}).collect()}
    assert sum(other[d] != got[d].q_kept for d in other) > 300


def test_the_least_determinant_is_kept(judged):
    """No start alone ends under the determinant that the operator keeps."""
    data, docs, _ = judged
    x = np.array(sorted({vector(t) for _, t, lang, _ in data if lang == "en" and not base_failed(t)}))
    rows = docs.sparkSession.createDataFrame([("g", *map(float, v)) for v in x], "group_key string, f_len double, f_mark double, f_near double")
    r = quality.fit(rows).first()
    kept = -np.linalg.slogdet(np.array(r["inverse"]).reshape(3, 3))[1]
    _, inv = plain_mcd(x)
    assert kept < -np.linalg.slogdet(inv)[1] + 0.05


def test_stage_keeps_rows_and_columns(judged, spark):
    data, docs, got = judged
    out = quality.quality_stage(spark, docs, "")
    assert out.columns == docs.columns and out.schema == docs.schema
    assert sorted(r.doc_id for r in out.collect()) == sorted(d for d in got if got[d].q_kept)


def test_few_rows_and_equal_rows(spark):
    few = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(30)), None, None) for i in range(50)], "doc_id long, text string, lang string, source string")
    assert [r.q_kept for r in quality.judge(few, {"doc_id": F.col("doc_id")}).collect()] == [True] * 50
    assert math.isclose(quality.chi_square_quantile(0.5, 3), 2.365974, rel_tol=1e-5)
    assert math.isclose(quality.chi_square_quantile(0.99, 5), 15.08627, rel_tol=1e-5)

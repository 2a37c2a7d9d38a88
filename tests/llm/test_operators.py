"""Every dealt operator on nulls, empty and long texts, ties, repeated rows, clashing columns and
empty tables, against brute force where a plain version is short."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tracelake.llm import bpe, chat, decontaminate, edit_counts, jaccard, licenses, linededup, lm, quality, suffix

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, items string, k string, label string, node long, w int, h long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    r = random.Random(11)
    word = lambda: "".join(r.choice(["ab", "th", "é", "Ca", "字", "x1", "ou"]) for _ in range(r.randint(1, 4)))
    base = [[word() for _ in range(r.randint(1, 120))] for _ in range(40)]
    passage = [word() for _ in range(70)]
    out = [None, "", " \n\t ", "one", "One  two", "mit license", "A MIT License, apache license general public license license"]
    for i, w in enumerate(base):
        if i % 4 == 0:
            w = w + passage + w[:5]
        t = " ".join(w)
        out.append(t.replace(" ", "\n", i % 3))
        if i % 5 == 0:
            out += [t, t]
        if i % 6 == 0:
            w2 = list(w)
            w2[r.randrange(len(w2))] = "changed"
            out.append(" ".join(w2))
    lines = [" ".join(word() for _ in range(8)) for _ in range(6)]
    out += ["\n".join(lines), "\n".join(["start", *lines[1:4], "end"]), "\n".join(lines[2:5] + [""] + lines[2:4]), "x" * 5000, "ab " * 3000, "\x00﻿\x85 it's 'RE don't 're   \n\n x"]
    return out


@pytest.fixture(scope="module")
def rows():
    t = texts()
    out = [(i, x, ["en", "fr", None][i % 3], ["s1", None][i % 2], None if i % 7 == 0 else len(x or ""), i, "items", None, "l", i, 1, 2) for i, x in enumerate(t)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Null and repeated ids, and whole rows twice."""
    return spark.createDataFrame([*rows[:12], *rows[5:9], (None, *rows[20][1:]), (None, *rows[21][1:]), (None, *rows[0][1:])], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def words(t, pattern=SPACED):
    return pattern.findall((t or "").translate(LOW))


def test_op1_base_and_model(docs, rows, odd, empty):
    got = by_id(lm.score(docs))
    tok = {r[0]: [*words(r[1]), None] for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tok}
    c = collections.Counter(t for i, x in tok.items() if not held[i] for t in x)
    n, v = sum(c.values()), len(c)
    for i, x in tok.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(x), sum(c[t] > 0 for t in x), n)
        assert math.isclose(r.base_score, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in x), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    assert lm.score(odd).count() == odd.count()
    assert lm.score(empty).count() == 0


def test_op1_scores_match_the_formula(docs, rows, monkeypatch):
    fixed = [[0.0 if b == 0 else 0.5, 0.3, 0.2 + 0.5 * (b == 0)] for b in range(lm.BUCKETS)]
    monkeypatch.setattr(lm, "fit_weights", lambda *a: fixed)
    got = by_id(lm.score(docs))
    tok = {r[0]: [*words(r[1]), None] for r in rows}
    train = [x for i, x in tok.items() if zlib.crc32(str(i).encode()) % 10]
    c = collections.Counter(t for x in train for t in x)
    c2 = collections.Counter(p for x in train for p in zip([None, *x], x, strict=False))
    n, v = sum(c.values()), len(c)
    for i, x in tok.items():
        s = 0.0
        for h, t in zip([None, *x], x, strict=False):
            b = min(lm.BUCKETS - 1, c[h].bit_length())
            a = fixed[b]
            s += math.log10(a[0] * c2[h, t] / max(c[h], 1) + a[1] * c[t] / n + a[2] / (v + 1))
        assert math.isclose(got[i].score, s, rel_tol=1e-9), i


def test_op1_em_raises_the_likelihood(spark):
    rows = [(b, c2, 10, c1, t) for b in (1, 2) for c2, c1, t in ((0, 0, 2), (3, 4, 20), (0, 7, 9), (8, 2, 5))]
    held = spark.createDataFrame(rows, "b int, c2 long, ch long, c1 long, times long")

    def like(a):
        return sum(t * math.log(a[b][0] * c2 / ch + a[b][1] * c1 / 50 + a[b][2] / 21) for b, c2, ch, c1, t in rows)

    start = [[0.0 if b == 0 else 0.4, 0.4, 0.2 + 0.4 * (b == 0)] for b in range(lm.BUCKETS)]
    a = lm.fit_weights(held, 50, 20)
    assert like(a) > like(start)
    assert all(math.isclose(sum(x), 1) for x in a)


def test_op1_weights_equal_plain_em(docs, rows):
    """The learned weights, from counts of the texts to the last round, against loops."""
    seen = {}
    plain = lm.fit_weights

    def spy(held, n, v):
        seen["a"], seen["rows"] = plain(held, n, v), held.count()
        return seen["a"]

    lm.fit_weights = spy
    try:
        lm.score(docs).count()
    finally:
        lm.fit_weights = plain
    fold = {r[0]: zlib.crc32(str(r[0]).encode()) % 10 for r in rows}
    tok = {r[0]: [*words(r[1]), None] for r in rows}
    rest = [x for i, x in tok.items() if fold[i] > 1]
    c, c2 = collections.Counter(t for x in rest for t in x), collections.Counter(p for x in rest for p in zip([None, *x], x, strict=False))
    n, v = sum(c.values()), len(c)
    held = collections.Counter((min(lm.BUCKETS - 1, c[h].bit_length()), c2[h, t], c[h], c[t]) for i, x in tok.items() if fold[i] == 1 for h, t in zip([None, *x], x, strict=False))
    assert seen["rows"] == len(held)
    a = {b: [0.0 if b == 0 else 0.4, 0.4, 0.2 + 0.4 * (b == 0)] for b in range(lm.BUCKETS)}
    for _ in range(lm.EM_ROUNDS):
        got = collections.defaultdict(lambda: [0.0, 0.0, 0.0])
        for (b, k2, kh, k1), times in held.items():
            terms = [a[b][0] * k2 / max(kh, 1), a[b][1] * k1 / n, a[b][2] / (v + 1)]
            for i in range(3):
                got[b][i] += times * terms[i] / sum(terms)
        for b, x in got.items():
            x = [x[0] + (b > 0) / 3, x[1] + 1 / 3, x[2] + 1 / 3]
            a[b] = [y / sum(x) for y in x]
    for b in range(lm.BUCKETS):
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) for x, y in zip(seen["a"][b], a[b], strict=True)), b


def brute_stats(t):
    w = SPACED.findall(t or "")
    win = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = set()
    for i in range(len(w) - 7):
        if win[tuple(w[i : i + 8])] > 1:
            rep.update(range(i, i + 8))
    lines = [x for x in (t or "").split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t or ""), len(lines) - len(set(lines)), len(rep)


def test_op2_statistics_and_verdicts(docs, rows, odd, empty, spark):
    out = by_id(quality.judge(docs, {"doc_id": F.col("doc_id")}))
    for r in rows:
        want, got = brute_stats(r[1]), out[r[0]]
        assert tuple(got[f"q_{c}"] for c in quality._STATS[:5]) == want
        assert got.q_base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (got.q_base_failed and got.q_kept)
    kept = quality.quality_stage(spark, odd, "")
    assert kept.columns == odd.columns
    assert quality.quality_stage(spark, empty, "").count() == 0


def test_op2_rejects_outliers_of_a_group_and_keeps_the_rest(spark):
    r = random.Random(5)
    w = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    good = [(i, " ".join(w() for _ in range(200)), "en", "s") for i in range(300)]
    bad = [(1000 + i, " ".join(w() + "$#" for _ in range(200)), "en", "s") for i in range(20)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")
    kept = {x.doc_id for x in quality.quality_stage(spark, df, "").collect()}
    assert kept == {x[0] for x in good}


def test_op3_round_trip_and_ranking(spark):
    own = "<|im_end|><|im_start|>assistant ok \\ \\\\ <\\| <|nl|>"
    data = [(1, 0, "user", own, 7), (1, 1, "assistant", own, 7), (1, 1, "assistant", own, 7), (2, 5, None, None, 7), (2, 4, "odd\nrole<|", "x\n", 7), (None, 0, "user", "hi", 7), (3, 0, "assistant", "", 7)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, node long")
    out = chat.format_trees(chat.conversation_nodes(df), best=1).select(F.when(~F.col("tree.none"), F.col("tree.id")).alias("c"), chat.parse(F.col("formatted")).alias("t"))
    got = {r["c"]: [(t["role"], t["text"]) for t in r["t"]] for r in out.collect()}
    assert got[1] == [("user", own), ("assistant", own), ("assistant", own)]
    assert got[2] == [("odd\nrole<|", "x\n"), ("", "")]
    assert got[None] == [("user", "hi")] and got[3] == [("assistant", "")]
    assert chat.format_trees(chat.conversation_nodes(df.limit(0))).count() == 0


def test_op3_branches(spark):
    edges = [(5, 1, 3, 0.0), (5, 2, 1, 0.0), (5, 3, 2, 0.0), (5, 4, 3, 0.0), (9, 1, 0, 0.0), (9, 2, 1, 1.0), (9, 3, 1, 2.0), (9, 4, 3, 0.5), (9, 5, 3, 0.5), (9, 6, 2, 9.0), (8, 1, 77, None), (7, 1, 2, 1.0), (7, 2, 1, 1.0)]
    df = spark.createDataFrame([(t, n, p, "user", f"m{n}", s) for t, n, p, s in edges], "tree long, node long, parent long, role string, text string, score double")
    out = {(r["tree"], r["leaf"]): r for r in chat.format_trees(df).collect()}
    assert {k: r["branch_rank"] for k, r in out.items()} == {(9, 6): 1, (9, 4): 2, (9, 5): 3, (8, 1): 1}
    assert out[9, 4]["formatted"].count("<|im_start|>") == 3 and out[9, 4]["branch_score"] == 2.5
    deep = spark.createDataFrame([(1, i, i - 1, "user", str(i), 0.0) for i in range(1, 301)], df.schema)
    got = chat.format_trees(deep).collect()
    assert len(got) == 1 and re.findall(r"user\n(\d+)", got[0]["formatted"]) == [str(i) for i in range(1, 301)]


def test_op4_against_all_substrings(docs, rows, odd, empty, spark):
    n = suffix.LENGTH
    for df in (docs, odd):
        data = [(r["doc_id"], (r["text"] or "").encode()) for r in df.collect()]
        seen = collections.Counter(b[i : i + n] for _, b in data for i in range(len(b) - n + 1))
        want = []
        for d, b in data:
            gone = [False] * len(b)
            for i in range(len(b) - n + 1):
                if seen[b[i : i + n]] > 1:
                    gone[i : i + n] = [True] * n
            spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
            want.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.dedup(df).collect()]
        key = lambda x: (x[0] is None, x[0] or 0, x[1:])
        assert sorted(got, key=key) == sorted(want, key=key)
    assert suffix.dedup(empty).count() == 0


def test_op4_splits_grams_with_much_different_text_around_them(docs, odd, spark, monkeypatch):
    r = random.Random(3)
    shared = "".join(r.choice("abcdefgh") for _ in range(90))
    around = lambda: "".join(r.choice("klmnopqr ") for _ in range(r.randint(60, 400)))
    tail = around()
    few = spark.createDataFrame([(i, around() + shared + (tail if i % 3 == 0 else around())) for i in range(60)], "doc_id long, text string")
    key = lambda x: tuple((y is not None, y) for y in x)
    for df in (docs, odd, few):
        want = sorted(map(tuple, suffix.dedup(df).collect()), key=key)
        monkeypatch.setattr(suffix, "HOT", 1)
        got = sorted(map(tuple, suffix.dedup(df).collect()), key=key)
        monkeypatch.undo()
        assert got == want
    assert sum(x[3] for x in want) > 0


def test_op5_phrases_templates_and_edits(docs, rows, odd, empty, spark):
    got = by_id(licenses.scan(docs))
    for r in rows:
        w = words(r[1], ALNUM)
        at = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        x = got[r[0]]
        assert (x.n_words, x.n_base, x.base_labels) == (len(w), len(at), ",".join(sorted({label for _, label in at})))
        assert (x.first_word, x.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
    own = {label: text.lower() for label, text in licenses.TEMPLATES}
    bsd, mit = own["bsd-terms"].split(), own["mit-text"]
    by = "Licensed under the Creative Commons Attribution-{} 4.0 International License."
    cases = {
        1: (" ".join(bsd), "bsd-terms"),
        2: (" ".join(bsd[:9] + ["oddly"] + bsd[9:]), "bsd-terms"),
        3: (" ".join(bsd[:4]), ""),
        4: ("of the in the of the with or without", ""),
        5: (by.format("ShareAlike"), "cc-by-sa"),
        6: (by.format("NonCommercial"), "cc-by-nc"),
        7: ("Licensed under the Creative Commons Attribution 4.0 International License", "cc-by"),
        8: ("it is licensed under the GNU General Public License, version 2", "gpl,gpl-2-notice"),
        9: ("Licensed under the Apache License, Version 1.1", "apache"),
        10: (f"x {mit} y".replace("liable", "oddly liable"), "mit-text"),
        11: (own["bsd-3-text"], "bsd-3-text"),
        12: (f"{own['bsd-2-text']} and then {own['isc-text']}", "bsd-2-text,isc-text"),
        13: (" ".join(own["apache-2-notice"].split()), "apache,apache-2-notice"),
        14: ("words " * 200_000 + mit, "mit-text"),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in cases.items()], "doc_id long, text string")
    out = by_id(licenses.scan(df))
    assert {i: out[i].labels for i in cases} == {i: x for i, (_, x) in cases.items()}
    assert out[1].score == 1.0 and 0.7 <= out[2].score < 1 and out[3].score == 0
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(empty).count() == 0


def brute_lines(data):
    seen, gone = {}, collections.defaultdict(set)
    order = []
    for d, t in data:
        f = [(i, x) for i, x in enumerate((t or "").split("\n")) if SPACED.search(x)] if t is not None else []
        order += [(tuple(x for _, x in f[i : i + 2]), d, i, range(f[i][0], f[i + 1][0] + 1)) for i in range(len(f) - 1)]
    for run, d, _, span in order:
        if run in seen:
            gone[d].update(span)
        seen.setdefault(run, d)
    return gone


def test_op6_deletes_later_runs(docs, rows, odd, empty, spark):
    gone = brute_lines([(r[0], r[1]) for r in rows])
    for r in linededup.dedup_lines(docs).select("row.doc_id", "text", "n_gone").collect():
        t = rows[r.doc_id][1]
        want = t if t is None or not gone[r.doc_id] else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[r.doc_id])
        assert r.text == want and r.n_gone == len(gone[r.doc_id])
    assert linededup.dedup_lines(odd).count() == odd.count()
    assert linededup.line_stage(spark, empty, "").columns == empty.columns
    assert linededup.line_stage(spark, empty, "").count() == 0


def test_op7_against_brute_force(docs, rows, odd, empty, spark):
    r = random.Random(2)
    w = words(rows[12][1], ALNUM) + words(rows[16][1], ALNUM) + words(rows[20][1], ALNUM)
    items = [(1, " ".join(w[3:30])), (2, "One two"), (3, None), (4, "..."), (5, " ".join(w[40:50])), (6, " ".join(r.sample(w, 12))), (7, "mit license"), (8, "ONE"), (9, " ".join(w[3:12])), (9, "one")]
    bench = spark.createDataFrame([(*x, "x", 1) for x in items], "item_id long, text string, w string, k int")
    win = collections.defaultdict(set)
    for i, t in items:
        b = words(t, ALNUM)
        for j in range(max(1, len(b) - 9) if b else 0):
            win[tuple(b[j : j + 10])].add(i)
    got = by_id(decontaminate.report(docs, bench))
    hit_docs = set()
    for d, t, *_ in rows:
        x = words(t, ALNUM)
        hit, its = set(), set()
        for k in {len(y) for y in win}:
            for j in range(len(x) - k + 1):
                if tuple(x[j : j + k]) in win:
                    hit.update(range(j, j + k))
                    its |= win[tuple(x[j : j + k])]
        g = got[d]
        assert (g.n_words, g.n_hit, g.n_items, g.contaminated) == (len(x), len(hit), len(its), bool(hit))
        assert g.items_sha256 == hashlib.sha256(",".join(sorted(map(str, its))).encode()).hexdigest()
        if hit:
            hit_docs.add(d)
    assert hit_docs
    clean = decontaminate.decontaminate(docs, bench)
    assert {x.doc_id for x in clean.collect()} == {x[0] for x in rows} - hit_docs and clean.columns == docs.columns
    cut = {x.doc_id: x.text for x in decontaminate.decontaminate(docs, bench, spans=True).collect()}
    for d, t, *_ in rows:
        if d in hit_docs:
            assert len(words(cut[d], ALNUM)) <= len(words(t, ALNUM)) - got[d].n_hit + 1
        else:
            assert cut[d] == t
    assert decontaminate.report(empty, bench).count() == 0
    assert not decontaminate.report(docs, bench.limit(0)).filter("contaminated").count()
    assert decontaminate.report(odd, bench).count() == len({x.doc_id for x in odd.collect()})


def library():
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.rank_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op8_equals_the_library_and_round_trips(docs, rows, odd, empty):
    lib = library()
    enc = bpe.encode(docs)
    for r in enc.collect():
        t = rows[r.row.doc_id][1] or ""
        assert r.ids == lib.encode_ordinary(t)
        sizes = [len(lib.decode_single_token_bytes(i)) for i in r.ids]
        assert r.offsets == [sum(sizes[:i]) for i in range(len(sizes))]
    assert {r.row.doc_id: r.text for r in bpe.decode(enc).collect()} == {r[0]: r[1] or "" for r in rows}
    assert bpe.encode(odd).count() == odd.count() and bpe.encode(empty).count() == 0


def test_op8_any_text():
    lib, enc = library(), bpe.encoder(bpe.rank_path())
    r = random.Random(8)
    chars = list("abstrevlmdAZé09٣ \n\t\r 　'’.!$-​\U0001f600字")
    cases = ["".join(r.choice(chars) for _ in range(r.randint(0, 25))) for _ in range(3000)] + ["'" + x for x in ("s", "re", "r", "ll", "S")] + ["a" * 700, " " * 300 + "x", "ab" * 300]
    import numpy as np

    b = [x.encode() for x in cases]
    off = np.append(0, np.cumsum([len(x) for x in b]))
    ids, _, upto, _, _ = enc.encode(np.frombuffer(b"".join(b), np.uint8), off)
    assert [ids[upto[i] : upto[i + 1]].tolist() for i in range(len(b))] == [lib.encode_ordinary(x) for x in cases]


def test_op9_counts_equal_a_new_encoding(docs, rows, odd, empty, spark):
    lib, r = library(), random.Random(4)
    chars = list("ab 's\n\t.é1")
    edits = [(d, r.randint(0, 200), r.choice([0, 1, 7, 400, None]), "".join(r.choice(chars) for _ in range(r.randint(0, 6))) or None) for d, *_ in rows for _ in range(r.randint(0, 4))]
    edits += [(None, 0, 1, "x"), (99999, 0, 1, "x"), (8, None, 1, "x"), (8, -1, 1, "x")]
    df = spark.createDataFrame(edits, "doc_id long, start long, length long, insert string")
    got = by_id(edit_counts.recount(docs, df))
    for d, t, *_ in rows:
        t = t or ""
        assert got[d].n_before == len(lib.encode_ordinary(t))
        limit = len(t)
        for s, n, ins in sorted(((s, n or 0, i or "") for e, s, n, i in edits if e == d and s is not None and 0 <= s <= len(t)), reverse=True):
            t = t[:s] + ins + t[max(s, min(s + n, limit)) :]
            limit = s
        assert got[d].n_after == len(lib.encode_ordinary(t)), d
    assert edit_counts.recount(odd, df).count() == odd.count() and edit_counts.recount(empty, df).count() == 0
    assert edit_counts.recount(docs, df.limit(0)).filter("n_before <> n_after").count() == 0


def test_op9_kept_trees_serve_edit_after_edit(docs, rows, odd, spark, monkeypatch):
    """Trees from one round are those of the next; with them only the edited parts are encoded."""
    lib, r = library(), random.Random(14)
    long = " ".join(str(r.random()) for _ in range(60_000))
    data = [(i, t) for i, t in ((x[0], x[1] or "") for x in rows)] + [(5000, long)]
    now = spark.createDataFrame(data, "doc_id long, text string").repartition(2)
    kept = edit_counts.trees(now)
    for n in range(3):
        ids = [d for d, _ in data]
        edits = spark.createDataFrame([(d, r.randint(0, 150), r.choice([0, 3, 40]), r.choice([" new", "x", "", "'s\n"])) for d in ids for _ in range(3)] + [(5000, 700_000, 5, "!")], "doc_id long, start long, length long, insert string")
        out = edit_counts.recount(now, edits, kept, texts=True).persist()
        got = {x.doc_id: x for x in out.collect()}
        fresh = {x.doc_id: x for x in edit_counts.recount(now, edits, texts=True).collect()}
        for d in ids:
            assert got[d].n_after == len(lib.encode_ordinary(got[d].text)), (n, d)
            assert (got[d].n_before, got[d].text, got[d].n_pretokens) == (fresh[d].n_before, fresh[d].text, fresh[d].n_pretokens)
        assert got[5000].n_pretokens > 50_000 and got[5000].n_reencoded < 1000
        now, kept = out.select("doc_id", "text"), out.select("doc_id", "text_key", "leaves")
    # none is encoded anew: a kept tree that is wrong on purpose shows
    wrong = kept.withColumn("leaves", F.lit(edit_counts.Tree([10**6], [7], [3]).pack()))
    assert {x.n_before for x in edit_counts.recount(now, edits.limit(0), wrong).collect()} == {7}
    other = kept.withColumn("text_key", F.lit(b"other"))
    assert {x.doc_id: x.n_before for x in edit_counts.recount(now, edits.limit(0), other).collect()} == {d: x.n_after for d, x in got.items()}
    assert edit_counts.recount(odd, edits, edit_counts.trees(odd)).count() == odd.count()


def brute_components(data):
    sets = {}
    for d, t in data:
        w = words(t)
        sets.setdefault(d, set()).add(frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else []))
    ids = sorted(sets)
    low = {d: d for d in ids}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= 90 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                low[q] = p
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("task", [jaccard.TASK_ITEMS, 400])
def test_op10_components(docs, rows, odd, empty, spark, monkeypatch, task):
    monkeypatch.setattr(jaccard, "TASK_ITEMS", task)
    r = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    near = []
    for _ in range(60):
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(60)] = f"v{r.randrange(9)}"
        near.append(" ".join(w[: r.randint(52, 60)]))
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(near)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    data = [(x.doc_id, x.text) for x in both.collect()]
    assert {x.doc_id: x.component_id for x in jaccard.components(both).collect()} == brute_components(data)


def test_op10_odd_rows(odd, empty, spark):
    got = [(x.doc_id, x.component_id) for x in jaccard.components(odd).collect()]
    want = brute_components([(x.doc_id, x.text) for x in odd.collect() if x.doc_id is not None])
    assert len(got) == odd.count() and all(c == want.get(d) for d, c in got)
    assert jaccard.components(empty).count() == 0
    assert jaccard.jaccard_stage(spark, empty, "").columns == empty.columns


def test_text_ids(spark, rows, docs):
    """Operators that pack documents keep the type of doc_id."""
    named = docs.withColumn("doc_id", F.concat(F.lit("u-"), F.col("doc_id").cast("string")))
    want = {f"u-{k}": v for k, v in by_id(suffix.dedup(docs)).items()}
    got = by_id(suffix.dedup(named))
    assert {k: tuple(v)[1:] for k, v in got.items()} == {k: tuple(v)[1:] for k, v in want.items()}
    assert set(by_id(lm.score(named))) == set(want)
    own = {f"u-{k}": v.n_shingles for k, v in by_id(jaccard.components(docs, 3, 90)).items()}
    linked = by_id(jaccard.components(named, 3, 90))
    assert {k: v.n_shingles for k, v in linked.items()} == own and all(v.component_id in own for v in linked.values())
    small = spark.createDataFrame([("b", "one two three four", "x"), ("a", "one two three four", "x"), (None, None, "x")], "doc_id string, text string, k string")
    assert {r.doc_id: r.component_id for r in jaccard.components(small, 3, 90).collect()} == {"a": "a", "b": "a", None: None}
    assert [r.doc_id for r in jaccard.jaccard_stage(spark, small.filter("doc_id is not null"), "").collect()] == ["a"]

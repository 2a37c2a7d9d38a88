"""The five-stage pipeline against plain loops."""

import base64
import collections
import random
import re

import pytest

import corpus_pipeline
from tracelake.llm import bpe, jaccard, linededup

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_lines(data):
    """Texts without lines in runs of two filled lines, or of 50 words or more, that stood before."""
    seen, out = set(), {}
    for d, t in data:
        f = [(i, x) for i, x in enumerate(t.split("\n")) if SPACED.search(x)]
        gone = set()
        for (i, a), (j, b) in zip(f, f[1:], strict=False):
            if (a, b) in seen:
                gone.update(range(i, j + 1))
            seen.add((a, b))
        for i, a in f:
            if len(SPACED.findall(a)) >= 50:
                if a in seen:
                    gone.add(i)
                seen.add(a)
        left = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        if not gone or SPACED.search(left):
            out[d] = left
    return out


def shingles(t, k):
    w = SPACED.findall(t.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def brute_near(data, k, percent):
    """The ids of which no smaller id is in the component."""
    sets = {d: shingles(t, k) for d, t in data.items()}
    low = {d: d for d in data}
    for a in sorted(data):
        for b in sorted(data):
            if b < a and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = sorted((low[a], low[b]))
                low = {d: p if x == q else x for d, x in low.items()}
    return {d for d in data if low[d] == d}


def windows(t, n=10):
    w = ALNUM.findall(t.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def corpus():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(3, 8)))
    texts = [" ".join(word() for _ in range(100)) for _ in range(60)]
    near = []
    for k, t in enumerate(texts[:12]):
        w = t.split()
        for i in (20, 50, 80)[: k % 3 + 1]:
            w[i] = word()
        near.append(" ".join(w))
    shared = "\n".join(" ".join(word() for _ in range(9)) for _ in range(3))
    lined = [f"{texts[i][:300]} {word()}\n{shared}\n\n{word()} {word()} {texts[i][300:]}" for i in range(40, 46)]
    lone = f"{word()}\n{texts[50]}\n{word()} {word()} {near[0]} {word()}"
    data = list(enumerate(texts + near + lined + [lone, texts[51], "too short", " ".join(["again and"] * 60)]))
    items = [" ".join(texts[i].split()[30:45]) for i in (30, 33)]
    return data, items


def test_pipeline_against_brute_force(spark, tmp_path):
    import public_tokenizers as P
    import tiktoken

    data, items = corpus()
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in data], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # the robust estimate has its own tests: what it keeps is the start of the loops
    kept = {x.doc_id for x in corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert len(kept) > 60 and len(data) - 1 not in kept and len(data) - 2 not in kept
    want = brute_lines([x for x in data if x[0] in kept])
    lined = len(want)
    ids = brute_near(want, 5, 80)
    bench = set().union(*map(windows, items))
    clean = {d: want[d] for d in ids if not windows(want[d]) & bench}
    assert len(clean) < len(ids) < lined
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.rank_path(), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {x.doc_id: (x.ids, x.n_tokens, x.n_chars) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {d: (lib.encode_ordinary(t), len(lib.encode_ordinary(t)), len(t)) for d, t in clean.items()}


@pytest.mark.parametrize("task", [jaccard.TASK_ITEMS, 300])
def test_stage_takes_five_words_and_80_percent(spark, monkeypatch, task):
    monkeypatch.setattr(jaccard, "TASK_ITEMS", task)
    data = dict(corpus()[0])
    pairs = [(d, 60 + d) for d in range(12)]
    at = lambda k, p: {x for x in pairs if 100 * len(shingles(data[x[0]], k) & shingles(data[x[1]], k)) >= p * len(shingles(data[x[0]], k) | shingles(data[x[1]], k))}
    assert at(5, 80) - at(3, 90) and set(pairs) - at(5, 80)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in data.items()], SCHEMA)
    assert collections.Counter(x.doc_id for x in jaccard.jaccard_stage(spark, docs, "").collect()) == collections.Counter(brute_near(data, 5, 80))


def test_line_stage_deletes_later_copies_of_single_long_lines(spark):
    line = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    long, short = line("a", 50), line("b", 49)
    data = [(0, f"x\n{long}\ny"), (1, f"z\n\n{long}\nu"), (2, long), (3, f"p\n{short}\nq"), (4, f"r\n{short}\ns"), (5, short), (6, f"v\n{line('c', 60)}\nw\n{line('c', 60)}\n{long}"), (7, f"x\n{long}\nk")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in data], SCHEMA)
    want = brute_lines(data)
    assert 2 not in want and want[1] == "z\n\nu" and want[6] == f"v\n{line('c', 60)}\nw" and want[5] == short and want[7] == "k"
    assert {x.doc_id: x.text for x in linededup.line_stage(spark, docs, "").collect()} == want
    assert {x.row.doc_id: x.text for x in linededup.dedup_lines(docs).collect()} == dict(data) | {7: "k"}

"""Texts over a megabyte cost what their length costs, and stages carry columns of any name."""

import random
import time

import numpy as np
import pytest

import corpus_pipeline
from tracelake.llm import bpe, decontaminate, jaccard, linededup

#: Names that operators use inside, each once a column of the documents.
NAMES = (
    "row d t w h k i pos near gone bad ids offsets n_gone n_words n_tokens run mark at start low high key1 key2 sid grp tokens items node label cluster task side own_key group_key level "
    "q_kept q_distance q_base_failed k_row g_lang g_source __text __gone __bad __d __n_gone block bucket sums component_id n_shingles parts g __row own first v"
).split()


def seconds(f):
    f()
    took = []
    for _ in range(2):
        began = time.time()
        f()
        took.append(time.time() - began)
    return min(took)


def word(r):
    return "".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(3, 8)))


@pytest.mark.parametrize("gap", [1, 2])
def test_words_of_a_long_text_cost_alike(spark, gap):
    r = random.Random(3)
    small = [word(r) for _ in range(400_000)]
    item = " ".join(small[1000:1015])
    bench = spark.createDataFrame([(1, item), (2, "never seen " * gap * 6)], "item_id int, text string")

    def run(n):
        docs = spark.createDataFrame([(1, " ".join(small[:n]))], "doc_id int, text string")
        got = decontaminate.report(docs, bench).collect()
        assert [(x.n_words, x.n_hit, x.n_items) for x in got] == [(n, 15, 1)]

    assert seconds(lambda: run(400_000)) < 3 * seconds(lambda: run(200_000))


def test_hits_all_along_a_long_text_cost_alike(spark):
    r = random.Random(4)
    passage = [word(r) for _ in range(40)]
    bench = spark.createDataFrame([(1, " ".join(passage))], "item_id int, text string")

    def run(n):
        docs = spark.createDataFrame([(1, " ".join(passage * n))], "doc_id int, text string")
        assert [(x.n_words, x.n_hit) for x in decontaminate.report(docs, bench).collect()] == [(40 * n, 40 * n)]
        assert [x.text.strip() for x in decontaminate.decontaminate(docs, bench, spans=True).collect()] == [""]

    assert seconds(lambda: run(4000)) < 3 * seconds(lambda: run(2000))


def test_lines_of_a_long_text_cost_alike(spark):
    r = random.Random(5)
    lines = [f"{word(r)} {word(r)} {i}" for i in range(128_000)]

    def run(n):
        text = "\n".join(lines[:n])
        docs = spark.createDataFrame([(1, text), (2, text), (3, f"{text}\nmore")], "doc_id int, text string")
        got = {x.doc_id: (x.text, x.n_gone) for x in linededup.dedup_lines(docs).select("row.doc_id", "text", "n_gone").collect()}
        assert got == {1: (text, 0), 2: ("", n), 3: ("more", n)}

    assert seconds(lambda: run(128_000)) < 3 * seconds(lambda: run(64_000))


def test_hot_values_come_by_broadcast(spark, monkeypatch):
    """A line in every document, with keys on both sides of the bound."""
    data = [(i, f"own {i}\ncommon\nline two\nown too {i}\nx {i % 7}\ny {i % 7}") for i in range(200)]
    docs = spark.createDataFrame(data, "doc_id int, text string")
    for hot in (1, 20, 10_000):
        monkeypatch.setattr(linededup, "HOT", hot)
        got = {x.doc_id: x.text for x in linededup.dedup_lines(docs).select("row.doc_id", "text").collect()}
        assert got == {i: t if i == 0 else t.replace("common\nline two\n", "") if i < 7 else f"own {i}\nown too {i}" for i, t in data}


def test_anchors_in_parts(spark, monkeypatch):
    r = random.Random(6)
    texts = [[word(r) for _ in range(60)] for _ in range(30)]
    items = [(i, " ".join(t[5:40])) for i, t in enumerate(texts[:9])] + [(20, " ".join(texts[10][:2])), (21, " ".join(texts[11][3:7]))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id int, text string")
    bench = spark.createDataFrame(items, "item_id int, text string")
    want = sorted(decontaminate.report(docs, bench).collect())
    assert [x.n_hit for x in want] == [35] * 9 + [0, 2, 4] + [0] * 18
    monkeypatch.setattr(decontaminate, "PART_ROWS", 7)
    assert sorted(decontaminate.report(docs, bench).collect()) == want


def test_op10_of_texts_without_words(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "doc_id long, text string").coalesce(1)
    assert sorted(map(tuple, jaccard.components(docs).collect())) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_carry_columns_of_any_name(spark, tmp_path, stage):
    r = random.Random(7)
    text = "\n".join(" ".join(word(r) for _ in range(12)) for _ in range(8))
    data = [(1, text), (2, None), (3, ""), (4, text), (None, text), (4, text), (5, " ".join(word(r) for _ in range(60)))]
    rows = [(d, t, "en", "s", len(t or ""), *[f"{n}/{k}" for n in NAMES]) for k, (d, t) in enumerate(data)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    spark.createDataFrame([(1, " ".join(text.split()[:20])), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    out = stage(spark, docs, str(tmp_path))
    got = out.collect()
    if stage is not bpe.encode_stage:
        assert out.columns == docs.columns
        assert all(x.q_kept.split("/")[1] == x.row.split("/")[1] for x in got)
    else:
        assert len(got) == len(data) and "text" not in out.columns
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_op9_edits_at_one_place_cost_the_same():
    """200 inserts of 900 bytes at one place, in calls of their own and in one call."""
    import random

    from tracelake.llm import bpe, edit_counts

    r = random.Random(2)
    enc, word = bpe.encoder(bpe.rank_path()), lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 7)))
    text = " ".join(word() for _ in range(4000)).encode()
    tree, costs, now = None, [], text
    for k in range(200):
        insert = " ".join(word() for _ in range(200)).encode()[:900]
        at = 3000 + 13 * (k % 3)
        got, trees, texts = edit_counts.count_edits(enc, [now], [[(at, at, insert)]], [tree])
        now = now[:at] + insert + now[at:]
        assert texts[0].read(0) == now
        costs.append(got[0][4])
        tree = edit_counts._unpack(trees[0].pack())
    assert max(costs) <= 2 * costs[0] and max(tree.pre[tree.width :]) <= 2 * edit_counts.LEAF + 1
    want = len(enc.encode(np.frombuffer(now, np.uint8), np.array([0, len(now)]))[0])
    assert tree.tokens[1] == want
    got, trees, texts = edit_counts.count_edits(enc, [text], [[(3000, 3000, b" again and again" * 60)] * 100], [None])
    assert got[0][4] < 100 * 3 * costs[0]
    whole = texts[0].read(0)
    assert got[0][1] == len(enc.encode(np.frombuffer(whole, np.uint8), np.array([0, len(whole)]))[0])

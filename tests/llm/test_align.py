"""Operator 12 against a plain alignment, and merge-path pieces of every size against one merge."""

import collections
import hashlib
import random

import numpy as np
import pytest

from tracelake.llm import align, bpe

SCHEMA = "doc_id long, text string, row int, block string, pair int, n_a int"
TEXTS = [
    None, "", " ", "a", "Hello  world\n\n x", "naïve café 字典 \U0001f600 é", "a▁b", "<|endoftext|> <s> </s> <unk> <0x41>",
    "tab\tand\r\nline", "the the the the", "of the of the of the", "zzzz" * 700, "newer \u1c89b \ua7cbx \U00010d50y", "\x00\x01 \x85﻿ x", "1234567 89", " lead and trail ",
]


def plain(rows):
    p = align.pair(*align.paths())
    letters = bpe.byte_letters()
    docs, total = [], collections.Counter()
    for i, t in rows:
        out = (i, 0, 0, [], [])
        if t:
            a = p.a.encode(" " + t, add_special_tokens=False).ids
            b = p.b.encode(t)
            ab = [bytes(letters[c] for c in p.a.id_to_token(x)) for x in a]
            bb = [bytes([int(p.b.id_to_piece(x)[3:5], 16)]) if p.b.is_byte(x) else p.b.id_to_piece(x).replace("▁", " ").encode() for x in b]
            if b"".join(ab) == b"".join(bb) == (" " + t).encode():
                groups, links, ga, gb, i_a, i_b, ea, eb = [], [], [], [], 0, 0, 0, 0
                while i_a < len(a) or i_b < len(b):
                    if ea <= eb:
                        ga.append(a[i_a])
                        ea += len(ab[i_a])
                        i_a += 1
                    else:
                        gb.append(b[i_b])
                        eb += len(bb[i_b])
                        i_b += 1
                    if ea == eb and ga and gb:
                        groups.append((ga, gb))
                        links.append((ga[-1], gb[-1]))
                        ga, gb = [], []
                out = (i, len(a), len(b), groups, links)
                total.update(links)
        docs.append(out)
    top = collections.Counter()
    for (_, b), n in total.items():
        top[b] = max(top[b], n)
    say = lambda x: ",".join(map(str, x))
    return sorted(
        (-1 if i is None else i, na, nb, len(g), len(k), sum(total[x] == top[x[1]] for x in k), sum(total[x] for x in k), hashlib.sha256(";".join(f"{say(a)}|{say(b)}" for a, b in g).encode()).hexdigest() if g else "")
        for i, na, nb, g, k in docs
    )


def sample():
    r = random.Random(3)
    words = ["the", "of", "naïve", "Straße", "字典", "x1", "tokenizer", "\n", "1999", "!?", "İ"]
    texts = TEXTS + [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(60)]
    return [*enumerate(texts), (None, "the end"), (3, "a"), (3, "a")]


@pytest.mark.parametrize("block_bytes", [50, 1 << 22])
def test_equals_the_plain_alignment(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(align, "BLOCK_BYTES", block_bytes)
    rows = sample()
    docs = spark.createDataFrame([(*x, 1, "b", 2, 3) for x in rows], SCHEMA).repartition(3)
    got = align.align(docs).select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    want = plain(rows)
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == want
    assert sum(w[1] == 0 for w in want) >= 3 and sum(w[3] for w in want) > 500


def test_cached_merging_gives_the_ids_of_the_library():
    p, r = align.pair(*align.paths()), random.Random(8)
    texts = [t for _, t in sample() if t] + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x20, 0x2FFF), r.randrange(0xE000)]) or 65) if r.random() < 0.9 else r.choice([" ", "'s", "'ll", "\n"]) for _ in range(300)) for _ in range(150)]
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + ["ab" * 3000, "x" * 999 + " y"]
    ids, n = p.encode_a([t.encode() for t in texts])
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [x.ids for x in p.a.encode_batch(texts, add_special_tokens=False)]


def test_groups_cover_all_tokens(spark):
    rows = sample()
    got = align.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {r[0]: r for r in plain(rows)}
    for r in got:
        w = want[-1 if r.row.doc_id is None else r.row.doc_id]
        assert (len(r.a_ids), len(r.b_ids), len(r.groups)) == w[1:4]
        assert not r.groups or tuple(r.groups[-1]) == w[1:3]


@pytest.mark.parametrize("work", [1, 2, 3, 7, 64, 10**6])
def test_pieces_are_stitched(work):
    r = np.random.default_rng(work)
    for n, m, top in ((0, 0, 1), (1, 1, 1), (5, 200, 300), (400, 300, 900), (64, 64, 64)):
        a, b = (np.sort(r.choice(top, min(x, top), replace=False)) if x else np.empty(0, np.int64) for x in (n, m))
        last, same = align.merge(a, b, work)
        assert last.tolist() == [int((b < x).sum()) for x in a]
        assert same.tolist() == [bool((b == x).any()) for x in a]


def test_text_ids_and_empty_table(spark):
    assert align.align(spark.createDataFrame([("u-1", "a b")], "doc_id string, text string")).select("row.doc_id").first()[0] == "u-1"
    assert align.align(spark.createDataFrame([], SCHEMA)).count() == 0

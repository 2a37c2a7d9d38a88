"""Polling of growing files: whole lines once, unterminated records, replaced files, bounds, many files, a restart."""

import json
import os

from pyspark.sql import functions as F

from tracelake.streaming import landing


def landed(spark, folder):
    rows = spark.read.schema(landing.LANDED + ", poll int").parquet(f"{folder}/landed").filter("is_line")
    return [tuple(x) for x in rows.select("poll", F.element_at(F.split("path", "/"), -1), "generation", "byte", "line").orderBy("poll", "path", "byte").collect()]


def test_whole_lines_once_and_records_without_line_feed(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    os.makedirs(src / "p" / "s")
    (src / "p" / "a.jsonl").write_text('{"a":1}\n{"b"')
    (src / "p" / "s" / "b.jsonl").write_text('x\n\n{"c":3}')
    (src / "p" / "note.txt").write_text("no\n")
    assert landing.poll(spark, str(src), out) == 2
    assert landed(spark, out) == [(0, "a.jsonl", 0, 0, '{"a":1}'), (0, "b.jsonl", 0, 0, "x"), (0, "b.jsonl", 0, 2, ""), (0, "b.jsonl", 0, 3, '{"c":3}')]
    assert landing.poll(spark, str(src), out) == 0  # a half line is still one
    with open(src / "p" / "a.jsonl", "a") as f:
        f.write(":2}\n")
    with open(src / "p" / "s" / "b.jsonl", "a") as f:
        f.write('\n{"d":4}\r\n')
    assert landing.poll(spark, str(src), out) == 2
    new = [x[1:] for x in landed(spark, out) if x[0] > 0]
    assert new == [("a.jsonl", 0, 8, '{"b":2}'), ("b.jsonl", 0, 10, ""), ("b.jsonl", 0, 11, '{"d":4}')]
    (src / "p" / "a.jsonl").write_text("new\n")
    assert landing.poll(spark, str(src), out) == 1
    assert landed(spark, out)[-1][1:] == ("a.jsonl", 1, 0, "new")
    (src / "p" / "s" / "b.jsonl").write_text('y\n\n{"c":3}\n{"d":4}\r\nlonger than before\n')  # replaced, not shorter
    assert landing.poll(spark, f"file://{src}", out) in (1, 2)  # other names of the same files are other files
    assert {x[2] for x in landed(spark, out) if x[1] == "b.jsonl"} >= {0}


def test_bound_of_bytes_and_many_files(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    for i in range(60):
        os.makedirs(src / str(i % 7), exist_ok=True)
        (src / str(i % 7) / f"{i}.jsonl").write_text("".join(json.dumps({"i": i, "k": k}) + "\n" for k in range(5)))
    polls = 0
    while landing.poll(spark, str(src), out, max_bytes=60 * 20):
        polls += 1
    rows = landed(spark, out)
    assert polls == 3 and len(rows) == 300 == len({(x[1], x[3]) for x in rows})
    assert landing.offsets(spark, out)[1].count() == 60


def test_a_poll_that_died_is_done_again(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    os.makedirs(src)
    (src / "a.jsonl").write_text("one\n")
    spark.createDataFrame([(True, "half", 0, 0, "x", None, None, None, None)], landing.LANDED).write.parquet(f"{out}/landed/poll=0")
    assert landing.poll(spark, str(src), out) == 1
    assert [x[1] for x in landed(spark, out)] == ["a.jsonl"]


def test_replaced_file_of_the_same_size(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    os.makedirs(src)
    (src / "a.jsonl").write_text("one\ntwo\n")
    landing.poll(spark, str(src), out)
    (src / "a.jsonl").write_text("1ne\n2wo\n")
    os.utime(src / "a.jsonl", (1, 1))
    assert landing.poll(spark, str(src), out) == 1
    assert [x[2:] for x in landed(spark, out)][-2:] == [(1, 0, "1ne"), (1, 4, "2wo")]

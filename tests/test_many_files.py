"""Many small transcripts: lines keep their order, and tasks, frames and state calls are not one for each file."""

import glob
import re

import pandas as pd
from pyspark.sql import functions as F

from tracelake.plans import ingest
from tracelake.streaming import landing
from tracelake.streaming.shared import Held
from tracelake.streaming.tail import TailReader

DATA = "/root/testdata/sf0.001"


def test_files_are_in_the_order_of_idx_whatever_arrives_first(spark, monkeypatch):
    made = ingest.rollout_lines

    def late(spark, d):
        lines = made(spark, d)
        return lines.filter("idx >= 0").unionByName(lines.filter("idx < 0"))  # the first records come last

    monkeypatch.setattr(ingest, "rollout_lines", late)
    rows, metas = ingest._rollouts(spark, DATA)
    sessions = spark.read.parquet(f"{DATA}/events.parquet").agg(F.count_distinct("user_id")).first()[0]
    assert metas.count() == sessions and rows.select("path").distinct().count() == sessions


def test_one_file_for_each_session_and_agent(spark, tmp_path):
    lines = spark.createDataFrame([(s, a, i, f"{s}.{a}.{i}") for i in range(30, -1, -1) for s in range(40) for a in (0, 1)], "session_id long, agent long, idx long, value string")
    root = ingest._put(lines.repartition(7, "value"), f"file://{tmp_path}/out", "agent").removeprefix("file://")
    found = {p: open(p).read() for p in glob.glob(f"{root}/**/*.txt", recursive=True)}
    names = {p: re.search(r"/s=s(\d+)/agent=(\d)/", p).groups() for p in found}
    assert len(found) == 80 == len(set(names.values()))
    assert all(found[p] == "".join(f"{s}.{a}.{i}\n" for i in range(31)) for p, (s, a) in names.items())


def test_small_files_share_a_task_and_a_frame(tmp_path):
    for i in range(300):
        (tmp_path / str(i)).mkdir()
        (tmp_path / str(i) / "a.txt").write_text(f"{i}\n")
    (tmp_path / "0" / "big.txt").write_text("x\n" * (1 << 23))
    reader = TailReader(f"{tmp_path}/**/*.txt")
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(parts) <= 4
    assert sorted(x[3] for p in parts for x in reader.read(p) if x[3] != "x") == sorted(map(str, range(300)))
    frames = list(landing._entries(iter([pd.DataFrame({"path": [str(tmp_path / str(i)) for i in range(300)]})])))
    assert len(frames) == 1 and len(frames[0]) == 301


class Counted(dict):
    calls = 0

    def containsKey(self, k):  # noqa: N802
        Counted.calls += 1
        return k in self

    def getValue(self, k):  # noqa: N802
        Counted.calls += 1
        return self[k]

    def updateValue(self, k, v):  # noqa: N802
        Counted.calls += 1
        self[k] = v

    def iterator(self):
        return iter(self.items())


def test_held_state_asks_once_and_writes_once():
    state = Counted({("a",): (1,)})
    held = Held(state, False)
    for n in range(50):
        held.put(("a",), ((held.get(("a",)) or (0,))[0] + 1,))
        held.put(("b",), ((held.get(("b",)) or (0,))[0] + n,))
    assert state == {("a",): (1,)} and held.keys() == [("a",)]
    held.write()
    assert state == {("a",): (51,), ("b",): (1225,)} and Counted.calls == 5
    new = Held(Counted(), True)
    assert new.get(("x",)) is None and new.keys() == [] and Counted.calls == 5
    held.clear()
    assert state == {} and held.get(("a",)) is None

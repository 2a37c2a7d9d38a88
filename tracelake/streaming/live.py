"""Live state of sessions: a stateful reduction of record streams, and its snapshot.

State of a session (one file): usage of each message (the latest record wins, whole
numbers are added as differences), tool calls, counters, status and stage. A file that
shrank or was replaced comes with the next generation: the state before it is dropped,
and so is what still arrives of older generations. A call whose id was seen before is
ignored; broken lines are counted. The sink keeps one row for each session and batch; a
snapshot is the newest row of each. Run to the end of the input, it equals the batch
operators on the same files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracelake.streaming import landing
from tracelake.streaming.shared import Held, shared_folder

OUT = "session_id long, records long, tool_calls long, failed long, open_tools long, prompts long, output_tokens long, covered_lines long, bad_lines long, generation long, status string, stage string"
EVENTS = 80


def parse(line: str) -> dict | None:
    try:
        rec = json.loads(line)
    except ValueError:
        return None
    return rec if isinstance(rec, dict) else None


class SessionReducer(StatefulProcessor):
    """Reduces rows (session_id, generation, at, line) of one session; ``at`` orders the records of a batch."""

    _NEW = {"records": 0, "tool_calls": 0, "failed": 0, "open": 0, "prompts": 0, "output": 0, "covered": 0, "bad": 0, "generation": 0, "status": "waiting", "stage": "setup"}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = (
            handle.getMapState("usage", "msg string", "out long"),
            handle.getMapState("calls", "id string", "path string, done boolean"),
            handle.getMapState("spans", "path string", "spans string"),
        )
        self.counts = handle.getValueState("counts", ", ".join(f"{k} {'string' if isinstance(v, str) else 'long'}" for k, v in self._NEW.items()))

    def handleInputRows(self, key, rows, timerValues):
        got = list(rows)
        old = self.counts.get()
        c = dict(zip(self._NEW, old, strict=True)) if old is not None else dict(self._NEW)
        self.usage, self.calls, self.spans = (Held(state, old is None) for state in self.states)
        newest = max(r.generation for r in got)
        if newest > c["generation"]:
            for held in (self.usage, self.calls, self.spans):
                held.clear()
            c = self._NEW | {"generation": newest}
        for r in sorted((r for r in got if r.generation == c["generation"]), key=lambda r: r.at):
            rec = parse(r.line)
            if rec is not None:
                self._record(rec, c)
            elif r.line.strip():
                c["bad"] += 1
        for held in (self.usage, self.calls, self.spans):
            held.write()
        self.counts.update(tuple(c.values()))
        yield Row(**dict(zip([x.split()[0] for x in OUT.split(", ")], (key[0], *c.values()), strict=True)))

    def _record(self, rec: dict, c: dict) -> None:
        c["records"] += 1
        msg = rec.get("message") if isinstance(rec.get("message"), dict) else {}
        content, kind = msg.get("content"), rec.get("type")
        blocks = [b for b in content if isinstance(b, dict)] if isinstance(content, list) else []
        if kind == "user" and rec.get("promptSource") == "typed" and isinstance(content, str) and content.strip():
            c["prompts"] += 1
            c["status"] = "running"
        skill = str(rec.get("attributionSkill") or "").split(":")[-1]
        if skill:
            c["stage"] = skill
        use = msg.get("usage")
        if isinstance(use, dict) and not str(msg.get("model") or "").startswith("<"):
            mid, out = str(msg.get("id") or f"#{c['records']}"), int(use.get("output_tokens") or 0)
            old = self.usage.get((mid,)) or (0,)
            self.usage.put((mid,), (out,))
            c["output"] += out - old[0]
        for b in blocks:
            if b.get("type") == "tool_use":
                self._call(b, c)
            elif b.get("type") == "tool_result":
                self._result(b, rec.get("toolUseResult"), c)
        text = content if isinstance(content, str) else " ".join(b.get("text") or "" for b in blocks)
        if "request interrupted" in text.lower():
            c["status"] = "interrupted"
        elif kind == "assistant":
            stop = msg.get("stop_reason")
            calls = any(b.get("type") == "tool_use" for b in blocks)
            if stop in ("end_turn", "stop_sequence") or (stop is None and text.strip() and not calls):
                c["status"] = "waiting"

    def _call(self, block: dict, c: dict) -> None:
        name = (str(block.get("id")),)
        if self.calls.get(name):
            return
        given = block.get("input") if isinstance(block.get("input"), dict) else {}
        self.calls.put(name, (str(given.get("file_path") or "") if block.get("name") == "Read" else "", False))
        c["tool_calls"] += 1
        c["open"] += 1
        c["status"] = "running"

    def _result(self, block: dict, told, c: dict) -> None:
        name = (str(block.get("tool_use_id")),)
        path, done = self.calls.get(name) or ("", True)
        if done:
            return
        self.calls.put(name, (path, True))
        c["open"] -= 1
        c["failed"] += bool(block.get("is_error"))
        shown = told.get("file") if isinstance(told, dict) and isinstance(told.get("file"), dict) else {}
        if path and shown.get("numLines"):
            c["covered"] += self._cover(path, int(shown.get("startLine") or 1), int(shown["numLines"]))

    def _cover(self, path: str, start: int, n: int) -> int:
        """Adds a line span of a file to its merged spans; how many lines are new."""
        old = json.loads((self.spans.get((path,)) or ("[]",))[0])
        merged: list[list[int]] = []
        for a, b in sorted([*old, [start, start + n]]):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        self.spans.put((path,), (json.dumps(merged),))
        return sum(b - a for a, b in merged) - sum(b - a for a, b in old)

    def close(self) -> None:
        pass


def reduce(lines: DataFrame) -> DataFrame:
    """The stateful stream over streaming rows (session_id, generation, at, line)."""
    return lines.groupBy("session_id").transformWithState(statefulProcessor=SessionReducer(), outputStructType=OUT, outputMode="Update", timeMode="None")


def run(stream: DataFrame, folder: str) -> None:
    """Drains a stream of snapshot rows into ``folder``/state, one batch after the other."""
    spark = stream.sparkSession
    keep = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("version", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{folder}/state/version={n}/")

    try:
        stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        if keep is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", keep)


def latest(spark: SparkSession, folder: str, key: str = "session_id") -> DataFrame:
    """The newest row of each session."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/state")
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "version").alias("r")).select(key, "r.*")


def snapshot(spark: SparkSession, root: str, session: Column) -> DataFrame:
    """Lands the transcript files below ``root`` (a folder that all hosts see) and streams their lines through the reducer; the
    newest row of each session. ``session`` is an expression over column path."""
    folder = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    landing.poll(spark, root, folder, pattern=r"\.txt$")
    at = F.concat_ws("/", "path", F.lpad(F.col("byte").cast("string"), 20, "0"))
    run(reduce(landing.lines(spark, folder).select(session, "generation", at.alias("at"), "line")), folder)
    return latest(spark, folder)


def events_feed(msgs: DataFrame, key: str, last: int = EVENTS) -> DataFrame:
    """The last ``last`` notable events of each session: prompts, writes and compactions."""
    from pyspark.sql import Window

    from tracelake.sources import transcripts as S

    uses = S.tool_uses(msgs, key).filter("kind is not null").select(key, "idx", "t_ms", F.lit("write").alias("event"), F.col("brief").alias("text"))
    said = S.prompts(msgs, key).select(key, "idx", "t_ms", F.lit("prompt").alias("event"), F.col("prompt").alias("text"))
    marks = S.markers(msgs, key).select(key, "idx", "t_ms", F.lit("compact").alias("event"), F.lit("").alias("text"))
    w = Window.partitionBy(key).orderBy(F.desc("idx"), "event")
    return uses.unionByName(said).unionByName(marks).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= last).drop("_r")

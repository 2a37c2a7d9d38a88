"""Stage segments of a session: boundaries, bounds, labels, and what belongs to a stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators import intervals


def _numbered(records: DataFrame, starts: Column, key: str) -> DataFrame:
    """Records with seg_no, a running count of boundary records; ``starts`` also holds at the first record."""
    w = Window.partitionBy(key).orderBy("idx")
    return records.withColumn("seg_no", (F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long"))


def assign(records: DataFrame, *, key: str = "session_id", skill: str = "skill") -> DataFrame:
    """Every record with its seg_no and stage. A record whose skill differs from the current one opens
    a stage; records before the first are ``setup``; a null skill keeps the current stage."""
    w = Window.partitionBy(key).orderBy("idx")
    before = F.last(skill, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.col(skill).isNotNull() & ~F.col(skill).eqNullSafe(before)
    first = F.row_number().over(w) == 1
    rows = records.withColumn("_first", first).withColumn("_opens", opens)
    rows = _numbered(rows, F.col("_opens") | F.col("_first"), key)
    stage = F.coalesce(F.last(skill, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("setup"))
    return rows.withColumn("stage", stage).drop("_first", "_opens")


def segments(records: DataFrame, *, key: str = "session_id", skill: str = "skill") -> DataFrame:
    """(key, seg_no, stage, label, start_idx, end_idx, start_ms, end_ms): times are the least and the
    greatest inside. A session of one stage is called ``session``; a stage's later runs are numbered."""
    return _labelled(assign(records, key=key, skill=skill), key)


def _labelled(rows: DataFrame, key: str) -> DataFrame:
    segs = rows.groupBy(key, "seg_no").agg(F.first("stage").alias("stage"), F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"))
    alone = F.count(F.lit(1)).over(Window.partitionBy(key)) == 1
    segs = segs.withColumn("stage", F.when(alone, F.lit("session")).otherwise(F.col("stage")))
    nth = F.row_number().over(Window.partitionBy(key, "stage").orderBy("seg_no"))
    label = F.when(nth > 1, F.concat("stage", F.lit(" ·"), nth.cast("string"))).otherwise(F.col("stage"))
    return segs.select(key, "seg_no", "stage", label.alias("label"), "start_idx", "end_idx", "start_ms", "end_ms")


def boundaries(marks: DataFrame, skill_calls: DataFrame | None = None, launches: DataFrame | None = None, *, key: str = "session_id", skill: str = "skill") -> DataFrame:
    """(key, idx, stage), one for each place: where the attribution ``skill`` of the records ``marks`` changes; the first
    call (key, idx, skill) of each skill that a session never attributes a record to; and each launch (key, idx,
    name) of a workflow, as ``wf:name``. Of several at one place the least name counts."""
    w = Window.partitionBy(key).orderBy("idx")
    named = marks.filter(F.col(skill).isNotNull())
    out = named.withColumn("_p", F.lag(skill).over(w)).filter(~F.col(skill).eqNullSafe(F.col("_p"))).select(key, "idx", F.col(skill).alias("stage"))
    if skill_calls is not None:
        never = skill_calls.select(key, "idx", F.col(skill).alias("stage")).join(out.select(key, "stage").distinct(), [key, "stage"], "left_anti")
        out = out.unionByName(never.groupBy(key, "stage").agg(F.min("idx").alias("idx")))
    if launches is not None:
        out = out.unionByName(launches.select(key, "idx", F.concat(F.lit("wf:"), "name").alias("stage")))
    return out.groupBy(key, "idx").agg(F.min("stage").alias("stage"))


def segments_at(records: DataFrame, bounds: DataFrame, *, key: str = "session_id") -> DataFrame:
    """As ``segments``, with a stage for each of ``bounds`` (key, idx, stage), also if it has the name of the one before;
    records before the first are ``setup``."""
    w = Window.partitionBy(key).orderBy("idx")
    rows = records.select(key, "idx", "t_ms").join(bounds.select(key, "idx", F.col("stage").alias("_stage")), [key, "idx"], "left")
    rows = rows.withColumn("_first", F.row_number().over(w) == 1)
    rows = _numbered(rows, F.col("_stage").isNotNull() | F.col("_first"), key)
    stage = F.coalesce(F.last("_stage", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("setup"))
    return _labelled(rows.withColumn("stage", stage), key)


#: The tool with which a session stops to ask its user (fixed value).
QUESTION = "AskUserQuestion"


def question_stalls(tools: DataFrame, *, key: str = "session_id", question: str = QUESTION) -> DataFrame:
    """(key, a_ms, b_ms, kind, idx) as of ``stalls``: the time that a question waits for its user. No record resumes it."""
    asked = tools.filter((F.col("name") == question) & (F.col("dur_ms") > 0))
    return asked.select(key, F.col("t_ms").alias("a_ms"), (F.col("t_ms") + F.col("dur_ms")).alias("b_ms"), F.lit("user").alias("kind"), F.lit(None).cast("long").alias("idx"))


def busy(tools: DataFrame, agents: DataFrame | None = None, *, key: str = "session_id", question: str = QUESTION) -> DataFrame:
    """(key, a_ms, b_ms): tools at work, but for questions, and the lives (key, start_ms, end_ms) of agents."""
    out = tools.filter((F.col("name") != question) & (F.col("dur_ms") > 0)).select(key, F.col("t_ms").alias("a_ms"), (F.col("t_ms") + F.col("dur_ms")).alias("b_ms"))
    if agents is None:
        return out
    return out.unionByName(agents.filter("end_ms > start_ms").select(key, F.col("start_ms").alias("a_ms"), F.col("end_ms").alias("b_ms")))


def asof(rows: DataFrame, segs: DataFrame, *, key: str = "session_id", at: str = "idx", start: str = "start_idx") -> DataFrame:
    """Rows with the last segment that starts at or before them (below the first: the first), by one
    union and window instead of a range join."""
    cols = [c for c in rows.columns if c not in (key, at)]
    one = rows.select(key, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*([F.col(c) for c in cols] or [F.lit(1).alias("_none")])).alias("_row"), F.lit(None).cast("struct<seg_no: bigint, stage: string>").alias("_seg"))
    two = segs.select(key, F.col(start).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(one.schema["_row"].dataType).alias("_row"), F.struct(F.col("seg_no").cast("long").alias("seg_no"), F.col("stage").alias("stage")).alias("_seg"))
    w = Window.partitionBy(key).orderBy("_at", "_side", F.col("_seg.seg_no"))
    both = one.unionByName(two)
    last = F.last("_seg", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.min("_seg").over(Window.partitionBy(key))
    out = both.withColumn("_s", F.coalesce(last, first)).filter("_side = 1")
    return out.select(key, F.col("_at").alias(at), *[F.col(f"_row.{c}").alias(c) for c in cols], F.col("_s.seg_no").alias("seg_no"), F.col("_s.stage").alias("stage"))


def containing(rows: DataFrame, segs: DataFrame, *, key: str = "session_id", at: str = "at_ms", fallback: bool = False) -> DataFrame:
    """Rows (key, at) with the first segment whose time range holds ``at``; else null, or with
    ``fallback`` the last one that started before, else the first."""
    one = [key] if isinstance(key, str) else list(key)
    out = intervals.covered_by(rows, segs, one, at, "start_ms", "end_ms", "seg_no")
    if not fallback:
        return out.select(key, at, "seg_no")
    last = asof(out.withColumnRenamed("seg_no", "_in"), segs, key=key, at=at, start="start_ms")
    return last.select(key, at, F.coalesce("_in", "seg_no").alias("seg_no"))


def stalls(turns: DataFrame, *, key: str = "session_id") -> DataFrame:
    """(key, a_ms, b_ms, kind, idx): from the first close marker after activity to the next record of a
    user or assistant (kind user or auto), or to the session's last record (kind tail)."""
    w = Window.partitionBy(key).orderBy("idx")
    active = F.col("role").isin("user", "assistant")
    rows = turns.withColumn("_g", F.sum(F.when(active, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_end", F.last("t_ms").over(Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    closes = rows.filter("role = 'close'").groupBy(key, "_g").agg(F.min_by("t_ms", "idx").alias("a_ms"), F.first("_end").alias("_end"))
    resumes = rows.filter(active).select(key, (F.col("_g") - 1).alias("_g"), F.col("t_ms").alias("b_ms"), F.col("role").alias("_role"), "idx")
    out = closes.join(resumes, [key, "_g"], "left")
    kind = F.when(F.col("_role").isNull(), "tail").when(F.col("_role") == "user", "user").otherwise("auto")
    return out.select(key, "a_ms", F.coalesce("b_ms", "_end").alias("b_ms"), kind.alias("kind"), "idx")


def time_accounts(pieces: DataFrame, segs: DataFrame, *, key: str = "session_id") -> DataFrame:
    """Duration, active and waiting milliseconds of each segment: stalls are capped at the duration,
    waiting (stalls that a user ended) at the stalls."""
    # the overlap of [s, e] with all pieces is what x -> min(max(x, s), e) adds up to over their ends, less over their starts:
    # it takes the sums over the points up to s and up to e
    point = lambda c, sign: F.struct(F.col(c).alias("t"), F.lit(sign).alias("d"))
    points = pieces.filter("b_ms > a_ms").select(key, "kind", F.inline(F.array(point("a_ms", -1), point("b_ms", 1))))
    seg = F.struct("seg_no", "stage", "start_ms", "end_ms").alias("_seg")
    ends = segs.select(key, seg, F.inline(F.array(F.struct(F.col("start_ms").alias("t"), F.lit(True).alias("_low")), F.struct(F.col("end_ms").alias("t"), F.lit(False).alias("_low")))))
    both = points.withColumn("_seg", F.lit(None).cast(ends.schema["_seg"].dataType)).withColumn("_low", F.lit(None).cast("boolean")).unionByName(ends.withColumn("kind", F.lit(None).cast("string")).withColumn("d", F.lit(0)))
    both = both.withColumn("t0", F.min("t").over(Window.partitionBy(key)))
    w = Window.partitionBy(key).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    x, user = F.col("t") - F.col("t0"), F.when(F.col("kind") == "user", F.col("d")).otherwise(0)
    sums = {"n": F.sum("d"), "s": F.sum(F.col("d") * x), "nu": F.sum(user), "su": F.sum(user * x)}
    both = both.select(key, "_seg", "_low", x.alias("x"), *[c.over(w).cast("long").alias(n) for n, c in sums.items()]).filter("_seg is not null")
    at = lambda c, low: F.max(F.when(F.col("_low") == low, F.col(c)))
    over = lambda n, s: at("x", True) * at(n, True) + at(s, False) - at(s, True) - at("x", False) * at(n, False)
    sums = both.groupBy(key, "_seg").agg(over("n", "s").alias("_stall"), over("nu", "su").alias("_wait")).select(key, "_seg.*", "_stall", "_wait")
    duration = F.col("end_ms") - F.col("start_ms")
    stall = F.least(F.col("_stall"), duration)
    return sums.select(key, "seg_no", "stage", duration.alias("duration_ms"), (duration - stall).alias("active_ms"), F.least(F.col("_wait"), stall).alias("wait_ms"))

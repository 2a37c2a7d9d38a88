"""Interval algebra by keys: union, subtraction, overlap, gaps, parallelism. Windows are
partitioned by all keys, so one job serves all sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Levels of the tree of ``covered_by``: points of one key up to 2 ** LEVELS.
LEVELS = 36


def union(df: DataFrame, keys: list[str], a: str, b: str, *, touch: int = 0) -> DataFrame:
    """Merged intervals [a, b] of each key; intervals at most ``touch`` apart merge. Empty ones (b < a) are dropped."""
    w = Window.partitionBy(*keys).orderBy(a, b)
    reach = F.max(b).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.filter(F.col(b) >= F.col(a)).select(*keys, a, b)
    rows = rows.withColumn("_new", F.when(F.col(a) <= reach + touch, 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_run").agg(F.min(a).alias(a), F.max(b).alias(b)).drop("_run")


def line_spans(df: DataFrame, keys: list[str], start: str = "start_line", n: str = "n") -> DataFrame:
    """Merged line spans (start_line, end_line) of (start, count) rows; adjacent spans touch."""
    rows = df.filter(F.col(n) > 0).select(*keys, F.col(start).alias("start_line"), (F.col(start) + F.col(n) - 1).alias("end_line"))
    return union(rows, keys, "start_line", "end_line", touch=1)


def gaps(merged: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """What lies between merged intervals: (gap_a, gap_b)."""
    w = Window.partitionBy(*keys).orderBy(a)
    return merged.select(*keys, F.col(b).alias("gap_a"), F.lead(a).over(w).alias("gap_b")).filter("gap_b > gap_a")


def counted(rows: DataFrame, points: DataFrame, keys: list[str], at: str, name: str, *, point: str = "t", below: bool = False) -> DataFrame:
    """``rows`` with ``name``: how many ``points`` of their key are at or before ``at`` (``below``: before it). One union and window."""
    cols = [c for c in rows.columns if c not in keys]
    one = rows.select(*keys, F.col(at).alias("_t"), F.lit(0 if below else 1).alias("_side"), F.struct(*cols).alias("_row"))
    two = points.select(*keys, F.col(point).alias("_t"), F.lit(1 if below else 0).alias("_side"), F.lit(None).cast(one.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = one.unionByName(two).withColumn("_n", F.count(F.when(F.col("_row").isNull(), 1)).over(w))
    return both.filter("_row is not null").select(*keys, "_row.*", F.col("_n").alias(name))


def _expanded(rows: DataFrame, first: str, last: str, name: str) -> DataFrame:
    """A row for each number from ``first`` to ``last``."""
    return rows.filter(F.col(first) <= F.col(last)).withColumn(name, F.explode(F.sequence(first, last))).drop(first, last)


def subtract(df: DataFrame, busy: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """The parts of each row's [a, b] that no interval of ``busy`` (a, b) covers; other columns stay.
    The free stretches of a key are the gaps of the merged busy set with open ends, numbered in order: those that
    a row meets are a range of numbers, so the join makes one row for each piece."""
    merged = union(busy, keys, a, b)
    w = Window.partitionBy(*keys).orderBy(a)
    low, high = F.lit(-(1 << 62)), F.lit(1 << 62)
    free = merged.select(*keys, F.row_number().over(w).cast("long").alias("_no"), F.col(b).alias("_fa"), F.coalesce(F.lead(a).over(w), high).alias("_fb"))
    head = merged.groupBy(*keys).agg(F.min(a).alias("_fb")).select(*keys, F.lit(0).cast("long").alias("_no"), low.alias("_fa"), "_fb")
    rows = counted(df.filter(F.col(b) > F.col(a)), merged, keys, a, "_first", point=a)
    rows = _expanded(counted(rows, merged, keys, b, "_last", point=b, below=True), "_first", "_last", "_no")
    rows = rows.join(free.unionByName(head), [*keys, "_no"], "left").withColumn("_fa", F.coalesce("_fa", low)).withColumn("_fb", F.coalesce("_fb", high))
    others = [c for c in df.columns if c not in (a, b)]
    cut = rows.select(*others, F.greatest(F.col(a), F.col("_fa")).alias(a), F.least(F.col(b), F.col("_fb")).alias(b))
    return cut.filter(F.col(b) > F.col(a))


def overlap(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, c: str, d: str) -> DataFrame:
    """Pairs of a key whose [a, b] and [c, d] overlap, with overlap_ms. Either the right one starts inside the left one, or
    the left one inside the right one; both are ranges of numbers of sorted starts, so only pairs that overlap are made."""
    left, right = left.filter(F.col(b) > F.col(a)), right.filter(F.col(d) > F.col(c))

    def numbered(df: DataFrame, start: str) -> DataFrame:
        return df.withColumn("_no", F.row_number().over(Window.partitionBy(*keys).orderBy(start)).cast("long"))

    # numbers from 1: starts before x are 1 .. n
    one = counted(counted(left, right, keys, a, "_first", point=c, below=True), right, keys, b, "_last", point=c, below=True)
    one = _expanded(one.withColumn("_first", F.col("_first") + 1), "_first", "_last", "_no").join(numbered(right, c), [*keys, "_no"])
    two = counted(counted(right, left, keys, c, "_first", point=a), left, keys, d, "_last", point=a, below=True)
    two = _expanded(two.withColumn("_first", F.col("_first") + 1), "_first", "_last", "_no").join(numbered(left, a), [*keys, "_no"])
    ms = F.least(F.col(b), F.col(d)) - F.greatest(F.col(a), F.col(c))
    return one.unionByName(two).drop("_no").withColumn("overlap_ms", ms)


def covered_by(rows: DataFrame, ranges: DataFrame, keys: list[str], at: str, a: str, b: str, value: str) -> DataFrame:
    """(keys, at, value): for each distinct point, the least ``value`` of the ranges [a, b] that hold it, else null. A range is
    put into at most two nodes on each level of a tree over the numbered points, and a point looks into the nodes above it: the cost
    grows with points and ranges times the levels, however many overlap."""
    points = rows.select(*keys, at).distinct()
    spots = points.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(at)).cast("long") - 1)
    r = counted(ranges.filter(F.col(b) >= F.col(a)).select(*keys, a, b, value), points, keys, a, "_low", point=at, below=True)
    r = counted(r, points, keys, b, "_high", point=at).filter("_low < _high")

    def nodes(k):
        low, high = F.shiftright(F.col("_low") + ((1 << k) - 1), k), F.shiftright("_high", k)
        open_ = low < high
        return [F.when(open_ & (low % 2 == 1), F.struct(F.lit(k).alias("level"), low.alias("node"))), F.when(open_ & (high % 2 == 1), F.struct(F.lit(k).alias("level"), (high - 1).alias("node")))]

    levels = range(LEVELS)
    own = r.select(*keys, value, F.inline(F.filter(F.array(*[n for k in levels for n in nodes(k)]), lambda x: x.isNotNull())))
    least = own.groupBy(*keys, "level", "node").agg(F.min(value).alias(value))
    depth = F.ceil(F.log2(F.count(F.lit(1)).over(Window.partitionBy(*keys)) + 1.0)).cast("int")
    above = spots.withColumn("_depth", depth).withColumn("level", F.explode(F.sequence(F.lit(0), "_depth"))).withColumn("node", F.expr("shiftright(_i, level)"))
    found = above.join(least, [*keys, "level", "node"]).groupBy(*keys, at).agg(F.min(value).alias(value))
    return points.join(found, [*keys, at], "left")


def parallelism(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Most intervals open at once, and the longest one, of each key. An end frees its place before a start takes it."""
    rows = df.select(*keys, F.inline(F.array(F.struct(F.col(a).alias("t"), F.lit(1).alias("d")), F.struct(F.col(b).alias("t"), F.lit(-1).alias("d")))))
    w = Window.partitionBy(*keys).orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
    peak = rows.withColumn("_open", F.sum("d").over(w)).groupBy(*keys).agg(F.max("_open").alias("peak"))
    longest = df.groupBy(*keys).agg(F.max(F.col(b) - F.col(a)).alias("longest_ms"))
    return peak.join(longest, keys)


def clip(spans: DataFrame, inventory: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """Spans cut to [1, n_lines] of their file, paths compared without case; unknown files drop out."""
    inv = inventory.select(F.lower(path).alias("_p"), "n_lines", "is_code")
    rows = spans.withColumn("_p", F.lower(path)).join(inv, "_p")
    rows = rows.select(*keys, path, "n_lines", "is_code", F.greatest(F.col("start_line"), F.lit(1)).alias("start_line"), F.least(F.col("end_line"), F.col("n_lines")).alias("end_line"))
    return rows.filter("end_line >= start_line")

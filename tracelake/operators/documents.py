"""Operators that work on lines and texts: numbered spans, patches, visible lines, prefixes, votes, retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.records import query_terms
from tracelake.operators import intervals

#: Characters of short outputs, with 64 more for each, that a broadcast may hold.
MAX_SHORT_CHARS = 4_000_000


def numbered_spans(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start_line, n): merged spans of the line numbers that texts carry before a tab."""
    no = F.regexp_extract("text", r"^\s{0,8}(\d+)\t", 1)
    rows = lines.filter(no != "").select(*keys, no.cast("long").alias("start_line"), F.lit(1).alias("n"))
    return intervals.line_spans(rows, keys).select(*keys, "start_line", (F.col("end_line") - F.col("start_line") + 1).alias("n"))


def patch_ops(lines: DataFrame, keys: list[str]) -> DataFrame:
    """File operations of patches given as lines (keys, line_no, text): one row for each header, with
    lines added and removed below it; the event is set for an added file, else delta."""
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = r"^\*\*\* (Add|Update|Delete) File:\s*(.+?)\s*$"
    action = F.regexp_extract("text", head, 1)
    rows = lines.select(*keys, "line_no", "text", F.when(action != "", action).alias("action"), F.regexp_extract("text", head, 2).alias("_path"))
    rows = rows.withColumn("ord", F.count("action").over(w)).filter("ord > 0")
    plus = F.col("text").startswith("+") & ~F.col("text").startswith("+++")
    minus = F.col("text").startswith("-") & ~F.col("text").startswith("---")
    out = rows.groupBy(*keys, "ord").agg(F.max("action").alias("action"), F.max(F.when(F.col("action").isNotNull(), F.col("_path"))).alias("path"), F.count_if(plus).alias("added"), F.count_if(minus).alias("removed"))
    kind = F.when(F.col("action") == "Add", "set").otherwise("delta")
    val = F.when(F.col("action") == "Add", F.col("added")).when(F.col("action") == "Delete", -F.col("removed")).otherwise(F.col("added") - F.col("removed"))
    return out.select(*keys, "ord", "action", "path", "added", "removed", kind.alias("kind"), val.alias("val"))


def resolve(named: DataFrame, bases: DataFrame, inventory: DataFrame, key: str) -> DataFrame:
    """(key, literal, path): of the bases (key, priority, base), the last first, the one below which the
    literal is in the inventory; paths with $ or % name nothing."""
    ok = named.filter(~F.col("literal").rlike("[$%]"))
    absolute = F.col("literal").startswith("/") | F.col("literal").rlike("^.:")
    full = F.when(absolute, F.col("literal")).otherwise(F.concat_ws("/", "base", F.regexp_replace("literal", r"^\./", "")))
    tried = ok.join(bases, key).withColumn("path", full)
    known = tried.join(inventory.select("path").distinct(), "path")
    return known.groupBy(key, "literal").agg(F.max_by("path", "priority").alias("path"))


def visible_full(source: DataFrame, out: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(item_id, doc_id, start_line, n) where a whole output text stands in a document's text. Candidate
    pairs come from an equal first line; pass ``pairs`` where the caller knows better."""
    if pairs is None:
        pairs = _line_pairs(source, out)
    both = pairs.join(source.select("doc_id", F.col("text").alias("d_text")), "doc_id").join(out.select("item_id", F.col("text").alias("o_text")), "item_id")
    hit = both.withColumn("at", F.expr("position(o_text, d_text)")).filter("at > 0 and length(o_text) > 0")
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return hit.select("item_id", "doc_id", lines(F.substr("d_text", F.lit(1), F.col("at") - 1)).cast("long").alias("start_line"), (lines(F.col("o_text")) + 1).cast("long").alias("n"))


def _line_pairs(source: DataFrame, out: DataFrame) -> DataFrame:
    """Pairs of which the document has one run of five inner words of the output. An output that stands
    in a document has all its inner words there, so no pair is lost. Outputs of under seven words,
    also long ones without blanks, are looked for in every document: broadcast where they have
    ``MAX_SHORT_CHARS`` or less together, else as Spark joins them."""
    g = 5
    grams = lambda df, key: df.select(key, F.split("text", r"\s+").alias("w")).select(key, F.explode(F.when(F.size("w") >= g + 2, F.transform(F.sequence(F.lit(1), F.size("w") - g - 1), lambda i: F.xxhash64(F.slice("w", i + 1, g)))).otherwise(F.array().cast("array<bigint>"))).alias("h"))
    first = grams(out, "item_id").groupBy("item_id").agg(F.min("h").alias("h"))
    pairs = grams(source, "doc_id").join(first, "h").select("item_id", "doc_id")
    short = out.filter(F.size(F.split("text", r"\s+")) < g + 2).filter(F.length("text") > 0).select("item_id", F.col("text").alias("o_text"))
    chars = short.agg(F.coalesce(F.sum(F.length("o_text") + 64), F.lit(0)).alias("n")).first()["n"]
    if chars:
        near = F.broadcast(short) if chars <= MAX_SHORT_CHARS else short
        pairs = pairs.unionByName(source.select("doc_id", "text").join(near, F.contains("text", "o_text")).select("item_id", "doc_id"))
    return pairs.distinct()


def visible_numbered(shown: DataFrame, source: DataFrame) -> DataFrame:
    """(doc_id, line_no) of output lines (doc_id, line_no, text) that show a source line: equal when
    trimmed, or ending with it."""
    real = source.select("doc_id", "line_no", F.trim("text").alias("_real"))
    both = shown.withColumn("_shown", F.trim("text")).join(real, ["doc_id", "line_no"])
    return both.filter((F.col("_shown") == F.col("_real")) | F.col("_shown").endswith(F.col("_real"))).select("doc_id", "line_no").distinct()


def carry_header(lines: DataFrame, keys: list[str], header: Column, order: str = "out_no") -> DataFrame:
    """Lines below a header, with its value as ``header``; header lines themselves drop out."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("_own", header).withColumn("header", F.last("_own", ignorenulls=True).over(w)).filter("_own is null and header is not null").drop("_own")


def visible_unique(out: DataFrame, source: DataFrame, *, min_chars: int = 8) -> DataFrame:
    """(item_id, doc_id, start_line, n): lines of ``min_chars`` or more, trimmed, that only one source line equals."""
    real = source.select("doc_id", F.col("line_no").alias("start_line"), F.trim("text").alias("t")).filter(F.length("t") >= min_chars)
    once = real.groupBy("t").agg(F.count(F.lit(1)).alias("_k"), F.min("doc_id").alias("doc_id"), F.min("start_line").alias("start_line")).filter("_k = 1")
    return out.select("item_id", F.trim("text").alias("t")).distinct().join(once, "t").select("item_id", "doc_id", "start_line", F.lit(1).cast("long").alias("n"))


def common_prefix(paths: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """The longest common directory of each key's paths, by segments without case; of one path, its directory."""
    parts = paths.select(*keys, F.col(path).alias("_p"), F.split(path, "/").alias("_s")).distinct()
    rows = parts.select(*keys, "_p", F.size("_s").alias("_n"), F.posexplode("_s").alias("pos", "seg"))
    total = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    per = rows.filter("pos < _n - 1").groupBy(*keys, "pos").agg(F.count_distinct(F.lower("seg")).alias("_d"), F.count(F.lit(1)).alias("_c"), F.min("seg").alias("seg")).join(total, keys)
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    good = per.withColumn("_ok", F.min(((F.col("_d") == 1) & (F.col("_c") == F.col("_all"))).cast("int")).over(w)).filter("_ok = 1")
    out = good.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "seg"))), lambda x: x["seg"]), "/").alias("prefix"))
    return total.select(*keys).join(out, keys, "left").select(*keys, F.coalesce("prefix", F.lit("")).alias("prefix"))


def root_vote(paths: DataFrame, markers: DataFrame, levels: int = 12) -> DataFrame:
    """(root, votes): each path votes for its nearest ancestor, at most ``levels`` up, that is a marker directory."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(levels))), lambda k: F.struct(k.alias("level"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/").alias("root")))
    rows = paths.select("path", F.inline(F.when(F.size(parts) > 1, up)))
    near = rows.join(markers.select("root").distinct(), "root").groupBy("path").agg(F.min_by("root", "level").alias("root"))
    return near.groupBy("root").agg(F.count(F.lit(1)).alias("votes"))


def retrieve(records: DataFrame, query: str, *, top: int = 28, recent: int = 24, text: str = "text", order: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """The ``top`` records by the sum over query terms of at most five occurrences each; without any hit
    the ``recent`` last ones with score 0."""
    terms = records.sparkSession.range(1).select(query_terms(F.lit(query)).alias("t")).first()["t"]
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    times = [F.least(F.lit(5), (F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / F.lit(len(t))) for t in terms]
    score = sum(times, F.lit(0)).cast("long")
    best = records.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), *order).limit(top)
    last = records.withColumn("score", F.lit(0).cast("long")).orderBy(*[F.desc(c) for c in order]).limit(recent)
    none = best.agg(F.count(F.lit(1)).alias("_n"))
    return best.unionByName(last.crossJoin(F.broadcast(none)).filter("_n = 0").drop("_n"))


def bound_conversation(turns: DataFrame, *, turns_kept: int = 20, chars: int = 12000, limit: int = 40000) -> DataFrame:
    """(conv_id, kept, chars, valid): of the last turns, those of user or assistant with text, trimmed and
    cut; valid if the last one is the user's and all fit the limit."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = turns.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= turns_kept)
    clean = F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""), 1, chars)
    ok = F.col("role").isin("user", "assistant") & (clean != "")
    out = last.groupBy("conv_id").agg(F.count_if(ok).alias("kept"), F.coalesce(F.sum(F.when(ok, F.length(clean))), F.lit(0)).cast("long").alias("chars"), F.max_by("role", F.when(ok, F.col("turn"))).alias("_last"))
    return out.select("conv_id", "kept", "chars", ((F.col("kept") > 0) & F.col("_last").eqNullSafe(F.lit("user")) & (F.col("chars") <= limit)).alias("valid"))

"""Operator 13: mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's size is its number of words. Sources in the order of their code points, null
last, weigh 5, 2, 1 in turn and share ``SHARE`` of all words by weight; no target is above
``MOST`` times its source's words, and what is cut off goes to the other sources by weight.
A target holds some complete epochs of its source; the rest is drawn: each document gets
the key -ln(u) / w, with u from a digest of seed, doc_id and text and w its quality weight
(so heavy documents come early), and a source's documents are taken in the order of their
keys while the running sum of sizes stays within the rest. The document at the edge is
taken if that brings the sum nearer, so a source misses its target by at most half of
one document.

The running sums are taken in two levels of buckets of the keys, so a source that holds
most of all rows is summed by as many tasks as any other data of its size, and no window
has more than about ``BUCKET_ROWS`` rows. Targets need the sums of the sources only; a few
numbers a round go to the driver, never a list of sources.

Cases: null or wordless text has size 0 and is never taken; a null source is a source of its
own; null and text doc_ids are allowed; rows that are repeated compete each for itself, and
equal rows get equal or interchangeable results; ties of keys go by doc_id, size and the
digest of the row; an empty table gives no rows; other columns, of any name, are carried in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.llm.store import cut, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
#: Rows in one bucket of keys, and buckets in one bucket of the level above.
BUCKET_ROWS = 400
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
LEAST_WEIGHT = 0.1


def quality_weight(text: Column) -> Column:
    """Share of distinct lines times share of characters that are no markup symbols, at least LEAST_WEIGHT."""
    lines, chars = F.split(text, "\n"), F.char_length(text)
    distinct = F.size(F.array_distinct(lines)) * F.lit(1.0) / F.size(lines)
    plain = F.lit(1.0) - (chars - F.char_length(F.translate(text, SYMBOLS, ""))) * F.lit(1.0) / F.greatest(chars, F.lit(1))
    return F.greatest(F.lit(LEAST_WEIGHT), F.coalesce(distinct * plain, F.lit(LEAST_WEIGHT)))


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``number``, the rank of its row from 0 in ``order``: ranges are ranked side by side and
    their counts, one row for each range, added up. The ranges are kept in a table, so they don't move."""
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_at", 33)
    counts = parts.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    out = parts.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.withColumn("number", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_at", "_before")


def targets(sources: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) for (source, source_size), one row for each source."""
    turn = F.col("number") % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long")
    s = cut(numbered(sources, F.col("source").asc_nulls_last()).select("source", "source_size", weight.alias("weight")), "weights")
    cap = F.col("source_size") * most
    total, heavy = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level, full = (share * total / heavy if heavy else 0.0), 0
    while True:  # each round, sources whose share is above their cap are full, and the others share what is left
        at = cap <= F.col("weight") * F.lit(level)
        n, caps, rest = s.agg(F.count_if(at), F.coalesce(F.sum(F.when(at, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~at, F.col("weight"))), F.lit(0))).first()
        if n == full or not rest:
            break
        full, level = n, (share * total - caps) / rest
    return s.select("source", "source_size", F.least(cap.cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def _before(rows: DataFrame, n_buckets: int) -> DataFrame:
    """``rows`` (source, key, ..., size) with ``before``: the sizes of the source's rows with smaller keys.
    Buckets of buckets of the keys are summed first, then the rows of each bucket."""
    order = ["key", "doc", "size", "digest"]
    spot = F.floor(F.col("key") / (F.col("key") + 1) * n_buckets).cast("long")
    rows = rows.withColumn("bucket", spot).withColumn("upper", F.floor(F.col("bucket") / BUCKET_ROWS))
    low = rows.groupBy("source", "upper", "bucket").agg(F.sum("size").alias("s"))
    high = low.groupBy("source", "upper").agg(F.sum("s").alias("s"))

    def upto(w):
        return F.sum("s").over(w) - F.col("s")

    high = high.select("source", "upper", upto(W.partitionBy("source").orderBy("upper")).alias("b2"))
    low = low.select("source", "upper", "bucket", upto(W.partitionBy("source", "upper").orderBy("bucket")).alias("b1"))
    same = [F.col("l.source").eqNullSafe(F.col("h.source")), F.col("l.upper") == F.col("h.upper")]
    start = low.alias("l").join(high.alias("h"), same).select("l.source", "l.bucket", (F.col("b1") + F.col("b2")).alias("start"))
    own = F.sum("size").over(W.partitionBy("source", "bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    rows = rows.withColumn("own", own)
    same = [F.col("r.source").eqNullSafe(F.col("s.source")), F.col("r.bucket") == F.col("s.bucket")]
    return rows.alias("r").join(start.alias("s"), same).select("r.*", (F.col("own") + F.col("start")).alias("before"))


def mix(docs: DataFrame, weight: Column | None = None, seed: str = SEED, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(row: struct of all columns but the text, size, source_size, target, taken, quality, key). ``weight``
    is a column of ``docs``, taken as 1e-9 where it is null or less; the default looks at the text."""
    others = [c for c in docs.columns if c != "text"]
    text = F.col("text").cast("string")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name, F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("long")
    u = (draw + 1).cast("double") / float(1 << 52)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"),
        F.col("source").alias("source"),
        F.col("doc_id").alias("doc"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        (quality_weight(text) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(1e-9))).alias("quality"),
        u.alias("u"),
    )
    rows = rows.withColumn("key", -F.log("u") / F.col("quality")).withColumn("digest", F.xxhash64("row")).drop("u")
    rows = cut(rows, "keys")
    sums = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sums")
    n = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    goal = targets(sums.select("source", "source_size"), share, most, weights)
    summed = _before(rows, max(1, n // BUCKET_ROWS))
    out = summed.alias("r").join(goal.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - epochs * F.col("source_size")
    drawn = 2 * (rest - F.col("before")) > F.col("size")
    taken = (F.col("size") * (epochs + F.when(drawn, 1).otherwise(0))).cast("long")
    return out.select("row", "size", "source_size", "target", taken.alias("taken"), "quality", "key")


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("row.doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, text IS NULL AS missing,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents),
k AS (
  SELECT doc_id, source, size,
    -ln((CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || t), 1, 13) AS BIGINT) + 1)::DOUBLE / 4503599627370496.0::DOUBLE)
      / CASE WHEN missing THEN 0.1::DOUBLE ELSE greatest(0.1::DOUBLE,
          (len(list_distinct(string_split(t, chr(10))))::DOUBLE / len(string_split(t, chr(10))))
          * (1.0::DOUBLE - (length(t) - length(translate(t, '#*$%&|<>', '')))::DOUBLE / greatest(length(t), 1))) END AS key
  FROM d),
s AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
c AS (
  SELECT *, coalesce(sum(2 * source_size) OVER o, 0) AS full_size, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS open_w, sum(source_size) OVER () AS total
  FROM s WINDOW o AS (ORDER BY source_size::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT *, (1.5::DOUBLE * total - full_size::DOUBLE) / open_w::DOUBLE AS level FROM c),
g AS (
  SELECT source, source_size, least((2 * source_size)::DOUBLE, w * (SELECT coalesce(min_by(level, source_size::DOUBLE / w), max(level)) FROM l WHERE 2 * source_size > w * level)) AS target
  FROM l),
b AS (
  SELECT k.doc_id, k.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS epochs,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) - k.size AS before
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (epochs + CASE WHEN 2 * (target - epochs * source_size - before) > size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM b
"""

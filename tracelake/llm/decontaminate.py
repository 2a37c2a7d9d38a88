"""Operator 7 [native]: benchmark decontamination by a broadcast hash set of n-grams.

Benchmark items become windows of ``N`` normalised words; an item of fewer words, but
not none, is one window. Every ``STEP``-th word of an item starts an anchor of
``ANCHOR`` words, so each window of ``N`` words holds the start of exactly one anchor;
an anchor keeps the words within reach of its windows. The anchors are broadcast in parts
of about ``PART_ROWS``, one scan of the documents for each part, so no broadcast grows with
the benchmark. A scan gives every word of a document a row in the same generated stage
that hashes its word triple, probes the set and cuts the words in reach out of the
document, so only hits leave the stage and a long text costs what its words cost. The
windows around a hit are compared word for word.

Cases: null text has no words and is never hit; a null or empty item has no window;
equal items are all reported; an item shorter than an anchor is found by its own
words; rows that share a doc_id are one document whose hits are pooled; null doc_ids
pool in the same way; an empty documents or benchmark table gives no rows, or no hits;
other columns, of any name, are ignored or, in the
stages, carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.store import cut, table

N = 10
ANCHOR = 3
STEP = N - ANCHOR + 1
#: Anchors of one broadcast: at most N + STEP words each.
PART_ROWS = 500_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SEED = -1


def words_of(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased."""
    # texts of ASCII alone are the faster ones
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _gram(words: Column, i: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)])


def anchors(bench: DataFrame) -> DataFrame:
    """(h, k, item_id, width, i_off, reach): the anchors of items. k words make the anchor, which is word
    ``i_off`` of ``reach``, the words of the item's windows that hold its start."""
    items = bench.select(F.col("item_id"), words_of(F.col("text").cast("string")).alias("i_words")).filter(F.size("i_words") > 0)
    size = F.size("i_words")
    at = F.when(size < N, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), size - ANCHOR), lambda i: i % STEP == 0))
    low = lambda i: F.greatest(i - (STEP - 1), F.lit(0))
    cuts = F.transform(at, lambda i: F.struct((i - low(i)).alias("i_off"), F.slice("i_words", low(i) + 1, i - low(i) + N).alias("reach")))
    rows = items.select("item_id", F.least(size, F.lit(ANCHOR)).alias("k"), F.least(size, F.lit(N)).alias("width"), F.inline(cuts))
    grams = [_gram(F.col("reach"), F.col("i_off"), k) for k in (1, 2, 3)]
    return rows.withColumn("h", F.when(F.col("k") == 1, grams[0]).when(F.col("k") == 2, grams[1]).otherwise(grams[2]))


def _starts() -> Column:
    """Starts in the document of the windows that agree word for word around a hit at ``pos``."""
    back = F.least(F.col("pos"), F.lit(STEP - 1)) - F.col("i_off")  # where reach starts in near
    own = F.sequence(F.lit(0), F.least("i_off", F.size("reach") - F.col("width")))
    same = F.filter(own, lambda j: (back + j >= 0) & (F.slice("near", F.greatest(back + j, F.lit(0)) + 1, F.col("width")) == F.slice("reach", j + 1, F.col("width"))))
    return F.transform(same, lambda j: F.col("pos") - F.col("i_off") + j)


def hits(docs: DataFrame, bench: DataFrame, *ids: str) -> DataFrame:
    """Rows (ids, n_words, item_id, start, width) of verified windows, and for each input row one with a null item."""
    spots = cut(anchors(bench), "anchors")
    sizes = {r["k"]: r["n"] for r in spots.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most three rows
    ks = sorted(sizes) or [ANCHOR]
    parts = max(1, -(-sum(sizes.values()) // PART_ROWS))
    rows = docs.select(*[F.col(f"`{c}`") for c in ids], words_of(F.col("text").cast("string")).alias("w"))
    rows = rows.withColumn("n_words", F.greatest(F.size("w"), F.lit(0)))
    # the row of each document itself passes the first join through an anchor that no text has
    seed = spots.sparkSession.range(1).select(F.lit(None).cast(spots.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("width"), F.lit(0).alias("i_off"), F.array().cast("array<string>").alias("reach"), F.lit(0).cast("long").alias("h"))
    out = None
    for part in range(parts):
        own = spots.filter(F.pmod(F.xxhash64("h", "item_id", "reach"), F.lit(parts)) == part).drop("k")
        own = own if part else own.unionByName(seed)
        found = _scan(rows, F.broadcast(own), ks, _SEED if part == 0 else 0)
        out = found if out is None else out.unionByName(found)
    return out.select(*[F.col(f"`{c}`") for c in ids], "n_words", "item_id", "width", "start")


def word_rows(rows: DataFrame, ks: list[int], first: int) -> DataFrame:
    """A row for each word and each gram width of ``ks``: ``pos``, and ``h``, the hash of the gram that starts
    there. Row numbers ``i`` begin at ``first``: at _SEED each document has one more row, of hash 0.
    ``rows`` has words ``w`` and ``n_words``; joined with a broadcast of grams, all this is one
    generated stage, in which the words of a document are never copied for each of its words."""
    m = len(ks)
    last = F.col("n_words") * m - 1
    at = F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))
    words = rows.select("*", F.explode(at).alias("i"))
    words = words.withColumn("pos", F.col("i") if m == 1 else F.floor(F.col("i") / m).cast("int"))
    h = _gram(F.col("w"), F.col("pos"), ks[-1])
    for j, k in enumerate(ks[:-1]):
        h = F.when(F.col("i") % m == j, _gram(F.col("w"), F.col("pos"), k)).otherwise(h)
    return words.withColumn("h", F.when(F.col("i") == _SEED, F.lit(0).cast("long")).otherwise(h))


def _scan(rows: DataFrame, spots: DataFrame, ks: list[int], first: int) -> DataFrame:
    """Hits of one part."""
    joined = word_rows(rows, ks, first).join(spots, "h")
    low = F.greatest(F.col("pos") - (STEP - 1), F.lit(0))
    near = joined.withColumn("near", F.slice("w", low + 1, F.greatest(F.col("pos"), F.lit(0)) - low + N)).drop("w")
    return near.withColumn("start", F.explode(F.when(F.col("i") == _SEED, F.array(F.lit(_SEED))).otherwise(_starts())))


def report(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row for each doc_id: n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(docs, bench, doc_id)
    own = F.collect_set(F.when(F.col("start") >= 0, F.struct("start", "width")))
    words = F.flatten(F.transform(own, lambda x: F.sequence(x["start"], x["start"] + x["width"] - 1)))
    per = found.groupBy(F.col(f"`{doc_id}`").alias("doc_id")).agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.size(F.array_distinct(words)).cast("long").alias("n_hit"),
        F.collect_set(F.col("item_id").cast("string")).alias("items"),
    )
    return per.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, bench: DataFrame, *, spans: bool = False) -> DataFrame:
    """Documents without a hit; with ``spans`` all documents, their hit words cut out
    (the words left are joined by blanks where words were removed)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = F.col("row.doc_id")
    if not spans:
        bad = report(docs, bench).filter("contaminated").select(F.col("doc_id").alias("bad"))
        return rows.join(bad, own.eqNullSafe(F.col("bad")), "left_anti").select("row.*")
    found = hits(docs, bench, "doc_id").filter("start >= 0")
    spot = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("width") - 1))
    gone = found.select(F.col("doc_id").alias("bad"), spot.alias("i")).distinct().groupBy("bad").agg(F.array_sort(F.collect_list("i")).alias("gone"))
    # word runs and the separators before them alternate; only the runs are counted
    alnum = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    parts = F.regexp_extract_all(F.col("row.text"), F.lit(f"([\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*(?:[A-Z]|{alnum})+|[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+$)"), F.lit(1))
    out = rows.join(gone, own.eqNullSafe(F.col("bad")), "left")
    # explode keeps the parts from being cut again for every run of words that stays
    out = out.select("row", "gone", F.explode(F.array(F.when(F.col("gone").isNotNull(), parts))).alias("parts"))
    # between the lost words g[j] and g[j + 1] (the ends are -1 and the number of parts) all parts stay
    out = out.withColumn("g", F.explode(F.array(F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("parts"))))))
    stay = F.filter(F.sequence(F.lit(0), F.size("gone")), lambda j: F.get("g", j + 1) - F.get("g", j) > 1)
    left = F.array_join(F.flatten(F.transform(stay, lambda j: F.slice("parts", F.get("g", j) + 2, F.get("g", j + 1) - F.get("g", j) - 1))), "")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(left)
    return out.select(*[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that share no window with the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), {N}) AS k, unnest(range(0, len(w) - least(len(w), {N}) + 1)) AS i, w FROM b WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1 : i + k], ' ') AS g FROM bw),
ks AS (SELECT DISTINCT k FROM bg),
dw AS (SELECT doc_id, k, unnest(range(0, len(w) - k + 1)) AS i, w FROM d, ks WHERE len(w) >= k),
dg AS (SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS g FROM dw),
h AS (SELECT doc_id, item_id, i, dg.k FROM dg JOIN bg ON dg.g = bg.g AND dg.k = bg.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.l, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""

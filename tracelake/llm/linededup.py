"""Operator 6: line dedup by winnowing over line hashes.

The lines of a document that hold a word are its sequence. In every window of ``W``
consecutive lines the smallest hash is a fingerprint, so any run of ``RUN`` = W lines
that occurs twice has a fingerprint at the same place in both. Positions of repeated
fingerprints are joined; around each, the match is extended both ways as far as runs
of ``RUN`` lines are equal to an earlier run (smaller doc_id, then smaller line). The
lines of these later runs are deleted. That is the same as deleting every line inside
a run of ``RUN`` lines that has an earlier copy.

With ``long_words``, a line of at least so many words is a run by itself: it is its own
fingerprint, and its later copies are deleted whatever lines stand around them. The stage
of the pipeline takes ``LONG_WORDS``; the query's contract is runs of ``RUN`` lines only.

Only hashes of lines travel (two of each run, 122 bits in all, as equal hashes delete lines), each fingerprint with the runs that it lies in, so the rows of
a document grow with its lines. Equal runs meet in an aggregate with map-side combine, and
the few values that stand for more than a ``HOT``-th of all rows reach their rows by a
broadcast of at most ``HOT`` of them; the join of the rest has no hot key.

Cases: null text has no lines and stays null; blank lines are never compared, and go
only when they lie inside a deleted run; a document of fewer than ``RUN`` lines keeps
them, if they are not long; rows that share a doc_id have their lines compared as one
document's and each lose the same lines; documents with a null doc_id are left as they are;
an empty table gives no rows; other columns, of any name, are carried along.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm import kernels as K
from tracelake.llm.quality import lines
from tracelake.llm.store import cut, table

_U = np.uint64

W = 2
RUN = W
LONG_WORDS = 50
#: Values that are more than a HOT-th of all rows are broadcast, at most HOT of them.
HOT = 10_000


def runs_of(buf: np.ndarray, off: np.ndarray, long_words: int | None = None) -> list[tuple[np.ndarray, ...]]:
    """For each text, arrays of one length over the runs of lines around its fingerprints: hash of the
    fingerprint, 1 for one row of each of its places (else 0), index of the run's first filled line, two hashes of the run, first and last line number."""
    out = []
    for i, j, b, o in K.chunks(buf, off):
        s, e, doc = lines(b, o)
        ws = K.words(b, o, K.SPACED)[0]
        n_words = np.searchsorted(ws, e) - np.searchsorted(ws, s)
        filled = n_words > 0
        number = np.arange(len(s)) - np.searchsorted(doc, np.arange(j - i))[doc]
        s, e, doc, number = s[filled], e[filled], doc[filled], number[filled]
        h = K.slice_hash(K.prefix(b, K.RAW_CODES), s, e)
        other = K.slice_hash(K.prefix(b, K.RAW_CODES, 1), s, e)
        at, run = K.window_hash(h, doc, RUN)
        _, run2 = K.window_hash(other, doc, RUN)
        marked = np.zeros(len(h), dtype=bool)
        low = at.copy()
        for k in range(1, W):
            low = np.where(h[at + k] < h[low], at + k, low)
        marked[low] = True  # each window's least line
        parts = []
        for k in range(RUN):  # extended by k lines to the left, and by the rest to the right
            m = np.flatnonzero(marked[at + k])
            parts.append((at[m] + k, at[m], run[m], run2[m], at[m] + RUN - 1))
        if long_words:
            m = np.flatnonzero(n_words[filled] >= long_words)
            parts.append((m, m, K.mix(h[m] + _U(1)), K.mix(other[m] + _U(1)), m))
        mark, first, run, run2, last = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(first, kind="stable")
        mark, first, run, run2, last = mark[order], first[order], run[order], run2[order], last[order]
        lead = np.zeros(len(mark), dtype=np.int64)
        lead[np.unique(mark, return_index=True)[1]] = 1
        begin = np.searchsorted(doc, np.arange(j - i + 1))
        bounds = np.searchsorted(first, begin)
        for k in range(j - i):
            x = slice(bounds[k], bounds[k + 1])
            out.append((h[mark[x]].view(np.int64), lead[x], first[x] - begin[k], run[x].view(np.int64), run2[x].view(np.int64), number[first[x]], number[last[x]]))
    return out


_RUN = ("mark", "lead", "start", "run", "run2", "low", "high")


def _runs(long_words: int | None):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = runs_of(*K.texts(batch.column(1)), long_words)
            own = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
            cols = [np.concatenate(x) for x in zip(*rows, strict=True)]
            for a in range(0, len(own), 1 << 18):
                z = slice(a, a + (1 << 18))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own[z])), *[pa.array(c[z], pa.int64()) for c in cols]], names=["d", *_RUN])

    return run


def _joined(rows: DataFrame, values: DataFrame, key: list[str], n: int) -> DataFrame:
    """``rows`` with the matching row of ``values`` (one for each ``key``, with ``k``, how many of the ``n``
    rows have it). Keys of more than n / HOT rows, at most HOT, are broadcast; no other is hot."""
    hot = F.col("k") > n / HOT
    names = [c for c in values.columns if c not in (*key, "k")]
    near = rows.join(F.broadcast(values.filter(hot).select(*key, F.struct("k", *names).alias("v"))), key, "left")
    direct = near.filter("v is not null").select(*rows.columns, "v.*")
    rest = near.filter("v is null").drop("v").join(values.filter(~hot), key)
    return direct.unionByName(rest)


def later_runs(docs: DataFrame, long_words: int | None = None) -> DataFrame:
    """(d, low, high): lines low .. high of d are a run that equals an earlier one."""
    src = docs.filter("doc_id is not null").select(F.col("doc_id").alias("d"), F.col("text").cast("string").alias("t"))
    spots = cut(src.mapInArrow(_runs(long_words), T.StructType([src.schema["d"], *[T.StructField(c, T.LongType()) for c in _RUN]])), "lines")
    n = spots.count()
    again = cut(spots.groupBy("mark").agg(F.count(F.lit(1)).alias("k"), F.sum("lead").alias("places")).filter("places > 1").select("mark", "k"), "marks")
    near = cut(_joined(spots, again, ["mark"], n).select("d", "start", "run", "run2", "low", "high").distinct(), "runs")
    n = near.count()
    firsts = near.groupBy("run", "run2").agg(F.min(F.struct("d", "start")).alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    firsts = cut(firsts, "firsts")
    return _joined(near, firsts, ["run", "run2"], n).filter(F.struct("d", "start") > F.col("first")).select("d", "low", "high")


def removed_lines(docs: DataFrame, long_words: int | None = None) -> DataFrame:
    """(d, gone array<long> of 0-based line numbers, in order), for documents that lose lines."""
    per = later_runs(docs, long_words).groupBy("d").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    lost = F.flatten(F.transform("spans", lambda s: F.sequence(s["low"], s["high"])))
    return per.select("d", F.array_sort(F.array_distinct(lost)).alias("gone"))


@F.pandas_udf(T.StringType())
def _kept(text: pd.Series, gone: pd.Series) -> pd.Series:
    def left(t, lost):
        if t is None:
            return None
        keep = np.array(t.split("\n"), dtype=object)
        mask = np.ones(len(keep), dtype=bool)
        lost = np.asarray(lost, dtype=np.int64)
        mask[lost[lost < len(keep)]] = False  # another row of the same doc_id may be longer
        return "\n".join(keep[mask])

    return pd.Series([left(t, g) if g is not None else None for t, g in zip(text, gone, strict=True)], dtype=object)


def dedup_lines(docs: DataFrame, long_words: int | None = None) -> DataFrame:
    """(row: the columns of ``docs`` as they were, text: without later repeated runs, n_gone: lines that went)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = rows.join(removed_lines(docs, long_words), F.col("row.doc_id") == F.col("d"), "left")
    whole = F.col("row.text").cast("string")
    # only texts that lose lines go to Python
    left = _kept(F.when(F.col("gone").isNotNull(), whole), F.col("gone"))
    return out.select("row", F.when(F.col("gone").isNull(), whole).otherwise(left).alias("text"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_gone"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("text", F.lit(""))
    return out.select("row.doc_id", F.col("n_gone").alias("n_removed"), F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without later repeated runs and long lines; those of which nothing is left go, n_chars follows the text."""
    out = dedup_lines(docs, LONG_WORDS)
    out = out.filter((F.col("n_gone") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    told = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*[F.when(F.col("n_gone") > 0, told[c]).otherwise(F.col("row").getField(c)).alias(c) if c in told else F.col("row").getField(c).alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, n, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
r AS (SELECT doc_id, i, n AS a, lead(n) OVER w AS b, line AS x, lead(line) OVER w AS y FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY x, y ORDER BY doc_id, i) AS k FROM r WHERE b IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS n FROM k WHERE k > 1),
t AS (SELECT l.doc_id, count(g.n) AS n_removed, coalesce(string_agg(CASE WHEN g.n IS NULL THEN l.line END, chr(10) ORDER BY l.n), '') AS kept
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.n = g.n GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(t.n_removed, 0) AS BIGINT) AS n_removed, CAST(length(coalesce(t.kept, '')) AS BIGINT) AS kept_chars, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id
"""

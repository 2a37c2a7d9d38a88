"""Operator 2: quality rules by robust multivariate outliers.

Every text gives a vector of transformed statistics: log mean word length, log share of
marks (ASCII signs that are neither letter nor digit), log share of words that repeat
one of the ``NEAR`` words before. Counts are smoothed by pseudo-counts worth ``PRIOR``
words, so that short texts don't scatter more than long ones.

Per (lang, source) a minimum covariance determinant estimate is fitted on all distinct
vectors. It starts from ``STARTS`` small subsets drawn by hash, and from all rows. A
concentration step is one aggregation: rows are binned by their Mahalanobis distance
under the present estimate, and the moments of the bins that hold the closest ``SHARE``
of the rows (of the last bin the part that is missing) give the next. After
``FIRST_STEPS`` steps the ``BEST`` starts with the least determinants go on until no
determinant moves by ``SETTLED``; the least one wins. Distances are scaled to the median
of chi-square; a row is rejected when its squared distance exceeds the chi-square
quantile of ``CONFIDENCE``, or when it fails a base rule. ``RIDGE`` on the diagonal only
keeps a covariance of equal rows invertible.

Cases: null or empty text has zero statistics and fails the base rule; null lang or
source is a group like any other; groups under ``MIN_GROUP`` rows use the estimate of
their language, then that of all rows, and if these are under ``MIN_GROUP`` too, only
the base rules decide; repeated rows count once in the estimate and are judged alike;
an empty table gives an empty result; other columns, of any name, are carried along.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm import kernels as K
from tracelake.llm.store import cut, table

SHARE = 0.75
STARTS = 6
#: Rows of a starting subset, about.
START_ROWS = 30
FIRST_STEPS = 2
BEST = 2
MAX_STEPS = 30
#: Change of a log determinant under which a start has converged.
SETTLED = 1e-3
#: Rows of a group with an estimate of its own: 20 for each feature.
MIN_GROUP = 60
CONFIDENCE = 0.9999
#: Added to each variance; those of real texts are 1e-3 and more.
RIDGE = 1e-6
#: Groups up to which estimates are broadcast (some hundred bytes each); beyond, Spark splits the joins of large groups.
MAX_GROUPS = 20_000
#: Pseudo-counts of the features: words, and what a word is taken to have of each.
PRIOR = 100
FEATURES = ("f_len", "f_mark", "f_near")
BINS_PER_OCTAVE = 24
WINDOW = 8
NEAR = 50

_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_near")


def text_stats(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The statistics of each text, as int64 arrays in the order of ``_STATS``."""
    n = len(off) - 1
    out = [np.zeros(n, dtype=np.int64) for _ in _STATS]
    symbol = np.zeros(256, dtype=bool)
    symbol[list(b"#*$%&|<>")] = True
    mark = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])
    for i, j, b, o in K.chunks(buf, off):
        m = j - i
        s, e, doc = K.words(b, o, K.SPACED)
        if not len(b):
            continue
        inside = np.zeros(len(b) + 1, dtype=np.int64)
        np.cumsum((b & 0xC0) != 0x80, out=inside[1:])
        h = K.slice_hash(K.prefix(b, K.RAW_CODES), s, e)
        at, wh = K.window_hash(h, doc, WINDOW)
        again, _ = K.repeated(doc[at], wh)
        rep = K.covered(at[again], WINDOW, len(h))
        own = K.mix(h + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(own, kind="stable")
        close = (own[order[1:]] == own[order[:-1]]) & (np.diff(order) <= NEAR)
        # lines: split at \n and at text ends
        ls, le, ldoc = lines(b, o)
        filled = np.searchsorted(s, le, side="left") > np.searchsorted(s, ls, side="left")
        ls, le, ldoc = ls[filled], le[filled], ldoc[filled]
        _, dup = K.repeated(ldoc, K.slice_hash(K.prefix(b, K.RAW_CODES), ls, le))
        spot = np.flatnonzero(symbol[b])
        vals = (
            K.per_doc(doc, m),
            K.per_doc(doc, m, inside[e] - inside[s]),
            K.per_doc(np.searchsorted(o, spot, side="right") - 1, m),
            K.per_doc(ldoc[dup], m),
            K.per_doc(doc[rep], m),
            K.per_doc(np.searchsorted(o, np.flatnonzero(mark[b]), side="right") - 1, m),
            K.per_doc(doc[order[1:][close]], m),
        )
        for a, v in zip(out, vals, strict=True):
            a[i:j] = v
    return out


def lines(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each \\n-separated line; a text of no bytes has one empty line."""
    nl = np.flatnonzero(b == 10)
    s = np.sort(np.concatenate([o[:-1], nl + 1]))
    e = np.sort(np.concatenate([o[1:], nl]))
    d = np.sort(np.concatenate([np.arange(len(o) - 1), np.searchsorted(o, nl, side="right") - 1]))
    return s, e, d


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in _STATS]))
def _stats(text: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(x) for x in text_stats(*K.texts(text))], names=list(_STATS))


def with_stats(docs: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """The ``keep`` columns and the statistics of column ``text``, one row for each row. Only texts go to Python."""
    out = docs.select(*[c.alias(n) for n, c in keep.items()], _stats(F.col("text").cast("string")).alias("stats"))
    return out.select(*keep, "stats.*")


def features() -> list[Column]:
    def share(count: str, prior: float, of: str, per: float) -> Column:
        return F.log((F.col(count) + prior * PRIOR) / (F.col(of) + per * PRIOR))

    return [share("word_chars", 5.0, "n_words", 1.0).alias("f_len"), share("n_marks", 0.3, "word_chars", 10.0).alias("f_mark"), share("n_near", 0.26, "n_words", 2.0).alias("f_near")]


_P = len(FEATURES)
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]
_SUMS = [*[f"s{i}" for i in range(_P)], *[f"p{i}{j}" for i, j in _PAIRS]]
_PARAM = "group_key string, start int, centre array<double>, inverse array<double>, log_det double"


def chi_square_quantile(p: float, k: int) -> float:
    """Quantile of chi-square with ``k`` degrees of freedom, from the series of its distribution."""

    def cdf(x: float) -> float:
        term = total = 1.0 / (k / 2)
        i = 1
        while term > 1e-16 * total:
            term *= x / 2 / (k / 2 + i)
            total += term
            i += 1
        return total * math.exp(-x / 2 + k / 2 * math.log(x / 2) - math.lgamma(k / 2))

    low, high = 1e-9, 10.0 * k + 100.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return low


CUTOFF = chi_square_quantile(CONFIDENCE, _P)


def _estimates(batches):
    """Moments of each group and start to centre, inverse covariance and log determinant."""
    for b in batches:
        t = b.to_pydict()
        out = []
        for i, n in enumerate(t["n"]):
            mu = np.array([t[f"s{k}"][i] for k in range(_P)]) / n
            cov = np.diag(np.full(_P, RIDGE))
            for k, j in _PAIRS:
                v = t[f"p{k}{j}"][i] / n - mu[k] * mu[j]
                cov[k, j] += v
                cov[j, k] += v if k != j else 0.0
            w, q = np.linalg.eigh(cov)
            w = np.maximum(w, RIDGE)  # rounding can leave less
            out.append((t["group_key"][i], t["start"][i], mu.tolist(), ((q / w) @ q.T).ravel().tolist(), float(np.log(w).sum())))
        kinds = (pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["group_key", "start", "centre", "inverse", "log_det"])


def _distance() -> Column:
    d = [F.col(f) - F.col("centre")[i] for i, f in enumerate(FEATURES)]
    out = F.lit(0.0)
    for i, j in _PAIRS:
        out = out + d[i] * d[j] * F.col("inverse")[i * _P + j] * (1.0 if i == j else 2.0)
    return F.greatest(out, F.lit(0.0))


def _moments() -> list[Column]:
    return [F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)], *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}{j}") for i, j in _PAIRS]]


def _few(df: DataFrame, groups: int) -> DataFrame:
    """``df``, which has some rows for each group, to be joined without moving the rows of a large group into one task."""
    return F.broadcast(df) if groups <= MAX_GROUPS else df


def _bins(rows: DataFrame, params: DataFrame, groups: int) -> DataFrame:
    """Moments by group, start and bin of distance, with the rows before each bin and in all."""
    bins = rows.join(_few(params, groups), "group_key").withColumn("bin", F.floor(F.log2(_distance() + 1e-9) * BINS_PER_OCTAVE)).groupBy("group_key", "start", "bin").agg(*_moments())
    run = Window.partitionBy("group_key", "start").orderBy("bin")
    before = F.coalesce(F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return bins.withColumn("before", before).withColumn("total", F.sum("n").over(Window.partitionBy("group_key", "start")))


def concentrate(rows: DataFrame, params: DataFrame, groups: int) -> DataFrame:
    """One concentration step of every group and start."""
    take = F.least(F.lit(1.0), (SHARE * F.col("total") - F.col("before")) / F.col("n"))
    closest = _bins(rows, params, groups).withColumn("take", take).filter("take > 0")
    return cut(closest.groupBy("group_key", "start").agg(*[F.sum(F.col(c) * F.col("take")).alias(c) for c in ("n", *_SUMS)]).mapInArrow(_estimates, _PARAM), "mcd")


def _starts(rows: DataFrame, sizes: DataFrame, groups: int) -> DataFrame:
    """Estimates of the starting subsets (0 .. STARTS - 1) and of all rows (STARTS)."""
    every = F.greatest(F.floor(F.col("rows") / START_ROWS), F.lit(1))
    drawn = F.filter(F.sequence(F.lit(0), F.lit(STARTS)), lambda s: (s == STARTS) | (F.pmod(F.xxhash64(s, *FEATURES), every) == 0))
    return cut(rows.join(_few(sizes, groups), "group_key").select("group_key", *FEATURES, F.explode(drawn).alias("start")).groupBy("group_key", "start").agg(*_moments()).mapInArrow(_estimates, _PARAM), "mcd")


def _least(params: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("group_key").orderBy("log_det", "start")
    return cut(params.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place"), "mcd")


def fit(rows: DataFrame) -> DataFrame:
    """(group_key, centre, inverse, scale): the estimates of all groups. ``rows`` has group_key and the
    features, each vector once, and should be a cut table. Groups under MIN_GROUP rows have none."""
    sizes = cut(rows.groupBy("group_key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= MIN_GROUP), "mcd_sizes")
    groups = sizes.count()
    params = _starts(rows, sizes, groups)
    for _ in range(FIRST_STEPS):
        params = concentrate(rows, params, groups)
    params = _least(params, BEST)
    for _ in range(MAX_STEPS):
        new = concentrate(rows, params, groups)
        old = params.select("group_key", "start", F.col("log_det").alias("was"))
        moved = new.join(old, ["group_key", "start"]).filter(F.abs(F.col("log_det") - F.col("was")) > SETTLED)
        params = new
        if moved.isEmpty():
            break
    best = _least(params, 1)
    half = F.col("total") / 2
    middle = _bins(rows, best, groups).filter((F.col("before") <= half) & (F.col("before") + F.col("n") > half))
    # the median inside its bin, by the share of the bin's rows that lie below it
    median = F.pow(F.lit(2.0), (F.col("bin") + (half - F.col("before")) / F.col("n")) / BINS_PER_OCTAVE)
    scale = middle.select("group_key", (F.lit(chi_square_quantile(0.5, _P)) / median).alias("scale"))
    return cut(best.join(scale, "group_key").select("group_key", "centre", "inverse", "scale"), "mcd")


def _judgeable(docs: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """k_ columns, group keys, statistics, features and base_failed."""
    base = with_stats(docs, {**{f"k_{n}": c for n, c in keep.items()}, "g_lang": F.col("lang").cast("string"), "g_source": F.col("source").cast("string")})
    return base.select("*", *features(), ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"))


def _keys() -> dict[str, Column]:
    lang = F.coalesce(F.concat(F.lit("="), "g_lang"), F.lit("-"))
    return {"own": F.concat(lang, F.lit("\x00"), F.coalesce(F.concat(F.lit("="), "g_source"), F.lit("-"))), "lang": lang, "all": F.lit("*")}


def estimates(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(own_key, level) of each group, and the estimates by group_key; ``base`` should be a cut table."""
    keys = _keys()
    good = base.filter(~F.col("base_failed"))
    vectors = cut(good.select(keys["own"].alias("own_key"), keys["lang"].alias("lang_key"), *FEATURES).distinct(), "vectors")
    sizes = vectors.groupBy("own_key", "lang_key").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("n_lang", F.sum("n").over(Window.partitionBy("lang_key")))
    level = F.when(F.col("n") >= MIN_GROUP, F.lit("own")).when(F.col("n_lang") >= MIN_GROUP, F.lit("lang")).otherwise(F.lit("all"))
    sizes = cut(sizes.select("own_key", "lang_key", level.alias("level")), "groups")
    groups = sizes.count()
    # copies across the groups that are pooled count once as well
    lang = vectors.join(_few(sizes.filter("level = 'lang'").select("lang_key").distinct(), groups), "lang_key", "left_semi").select(F.col("lang_key").alias("group_key"), *FEATURES).distinct()
    every = vectors.select(F.lit("*").alias("group_key"), *FEATURES).distinct()
    if sizes.filter("level = 'all'").isEmpty():
        every = every.limit(0)
    own = vectors.join(_few(sizes.filter("level = 'own'").select("own_key"), groups), "own_key", "left_semi").select(F.col("own_key").alias("group_key"), *FEATURES)
    rows = cut(own.unionByName(lang).unionByName(every), "mcd_rows")
    return sizes, fit(rows)


def judge(docs: DataFrame, keep: dict[str, Column], *, heavy: bool = False) -> DataFrame:
    """``keep`` columns with statistics, base_failed, distance and kept. With ``heavy`` columns the
    statistics are computed again for the verdict, so that no table with them is written."""
    base = cut(_judgeable(docs, {} if heavy else keep), "stats")
    sizes, params = estimates(base)
    groups = sizes.count()
    rows = _judgeable(docs, keep) if heavy else base
    keys = _keys()
    tagged = rows.withColumn("own_key", keys["own"]).join(_few(sizes.select("own_key", "level"), groups), "own_key", "left").withColumn("group_key", F.when(F.col("level") == "own", keys["own"]).when(F.col("level") == "lang", keys["lang"]).otherwise(keys["all"]))
    out = tagged.join(_few(params, groups), "group_key", "left").withColumn("distance", _distance() * F.col("scale"))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF)
    return out.select(*[F.col(f"`k_{n}`").alias(n) for n in keep], *[F.col(c).alias(f"q_{c}") for c in _STATS], F.col("base_failed").alias("q_base_failed"), F.col("distance").alias("q_distance"), kept.alias("q_kept"))


def op2_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), {"doc_id": F.col("doc_id")})
    return out.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in (*_STATS[:5], "base_failed", "kept", "distance")])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass, with the columns of ``docs``."""
    out = judge(docs, {"row": F.struct(*[F.col(f"`{c}`") for c in docs.columns])}, heavy=True)
    return out.filter("q_kept").select("row.*")

"""Tokens: settling streamed usage, billing, cost, output split, context, cumulative counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("inp", "cread", "cw5", "cw1h", "out_tok")
#: Price per million tokens by model: input, output (fixed values); others pay the last row.
PRICES = [("m0", 5.0, 25.0), ("m1", 2.0, 10.0), (None, 5.0, 25.0)]


def settle(rows: DataFrame, *, key: str = "session_id", msg: str = "msg_id") -> DataFrame:
    """One row for each streamed message: usage of its last record, idx, time and model of its first,
    characters summed; synthetic models (starting with ``<``) drop out."""
    last = [F.max_by(c, "idx").alias(c) for c in KINDS]
    out = rows.groupBy(key, msg).agg(F.min("idx").alias("idx"), F.min_by("t_ms", "idx").alias("t_ms"), F.min_by("model", "idx").alias("model"), *last, *[F.sum(c).alias(c) for c in ("ch_think", "ch_text", "ch_tool")])
    return out.filter(~F.col("model").startswith("<"))


def billing(settled: DataFrame, *, key: str = "session_id") -> DataFrame:
    return settled.groupBy(key, "model").agg(F.count(F.lit(1)).alias("req"), *[F.sum(c).alias(c) for c in KINDS])


def priced(bill: DataFrame) -> DataFrame:
    """Billing rows with USD by bucket: cache reads at a tenth of the input price, five-minute cache
    writes at 1.25, one-hour writes at 2 times."""
    spark = bill.sparkSession
    table = F.broadcast(spark.createDataFrame([p for p in PRICES if p[0]], "model string, p_in double, p_out double"))
    rest = next(p for p in PRICES if not p[0])
    rows = bill.join(table, "model", "left").withColumn("p_in", F.coalesce("p_in", F.lit(rest[1]))).withColumn("p_out", F.coalesce("p_out", F.lit(rest[2])))
    m = F.lit(1e6)
    return rows.select(
        *bill.columns,
        (F.col("inp") * F.col("p_in") / m).alias("usd_in"),
        (F.col("cread") * F.col("p_in") * 0.1 / m).alias("usd_read"),
        ((F.col("cw5") * F.col("p_in") * 1.25 + F.col("cw1h") * F.col("p_in") * 2.0) / m).alias("usd_write"),
        (F.col("out_tok") * F.col("p_out") / m).alias("usd_out"),
    )


def output_split(settled: DataFrame, keys: list[str]) -> DataFrame:
    """Output tokens shared out by characters of thinking, text and tools; without characters all is
    text. Rounded half-even once at the end."""
    total = F.col("ch_think") + F.col("ch_text") + F.col("ch_tool")
    share = lambda c: F.when(total > 0, F.col("out_tok") * F.col(c) / total).otherwise(F.col("out_tok") if c == "ch_text" else F.lit(0)).cast("double")
    return settled.groupBy(*keys).agg(*[F.bround(F.sum(share(c)), 0).cast("long").alias(n) for c, n in (("ch_think", "out_thinking"), ("ch_text", "out_text"), ("ch_tool", "out_tool"))])


def context_timeline(settled: DataFrame, *, key: str = "session_id") -> DataFrame:
    """(key, idx, ctx, peak): tokens in the context at each request, and the session's greatest."""
    ctx = F.col("inp") + F.col("cread") + F.col("cw5") + F.col("cw1h")
    return settled.select(key, "idx", ctx.alias("ctx")).withColumn("peak", F.max("ctx").over(Window.partitionBy(key)))


def deltas(counter: DataFrame, *, key: str = "session_id") -> DataFrame:
    """Growth of a cumulative counter; after a reset the value itself; rows without growth drop out."""
    before = F.coalesce(F.lag("total").over(Window.partitionBy(key).orderBy("idx")), F.lit(0))
    step = F.when(F.col("total") < before, F.col("total")).otherwise(F.col("total") - before)
    return counter.withColumn("delta", step).filter("delta > 0").select(key, "idx", "delta")


def inherited(counter: DataFrame, fork: DataFrame, *, key: str = "session_id") -> DataFrame:
    """Totals after the fork (key, fork_idx) less the last one before it, at least 0."""
    base = counter.join(fork, key).filter("idx < fork_idx").groupBy(key).agg(F.max_by("total", "idx").alias("base"))
    own = counter.join(fork, key).filter("idx >= fork_idx").join(base, key, "left")
    return own.select(key, "idx", F.greatest(F.lit(0), F.col("total") - F.coalesce("base", F.lit(0))).alias("own_total"))

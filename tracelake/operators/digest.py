"""A digest of each lineage as JSON text that keeps to a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAMES, OUTPUTS, DOCUMENTS, UNREAD, UNREAD_FEW = 12, 40, 50, 80, 30
LEAST_BUDGET = 4000
#: No item of a list is shorter, so a budget holds a bounded number of them.
LEAST_ITEM = 10
TAIL = "\n… [cut]\n"


def short_list(values: Column, most: int, n: Column | None = None) -> Column:
    """The first ``most`` of an array of strings, and how many more there are (of ``n``, if the array is already cut)."""
    n = F.size(values) if n is None else n
    more = F.when(n > most, F.array(F.concat(F.lit("… "), (n - most).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.slice(values, 1, most), more)


def _listed(df: DataFrame, key: str, item: Column, order: list[Column], most: int) -> DataFrame:
    """(key, n, chars, items): JSON texts of the first ``most`` rows in order, how many rows there are, and what all take with
    commas. Only the first rows come together; the rest is a count and a sum."""
    rows = df.select(key, item.alias("_json"), *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    sums = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("_json") + 1).alias("chars"))
    w = Window.partitionBy(key).orderBy(*[F.col(f"_o{i}") for i in range(len(order))])
    first = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    lists = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_json"))), lambda x: x["_json"]).alias("items"))
    return sums.join(lists, key)


def bounded(counts: DataFrame, outputs: DataFrame, documents: DataFrame, unread: DataFrame, *, key: str = "lineage", budget: Column | int = 32000, most_budget: int = 32000) -> DataFrame:
    """(key, digest, truncated) for each row of ``counts``. Counts come first and stay; of outputs (key, path, final_lines, ...), the
    longest first, of documents (key, path, ...) and of unread paths (key, path), the lists are cut in turn until the text fits:
    outputs to OUTPUTS and unread paths to UNREAD_FEW, then documents to DOCUMENTS, at last the text. ``budget`` may differ by
    row, but not exceed ``most_budget``; arrays of names are cut to NAMES."""
    budget = F.greatest(F.lit(LEAST_BUDGET), budget if isinstance(budget, Column) else F.lit(budget))
    most = most_budget // LEAST_ITEM
    cut = lambda df: F.to_json(F.struct(*[short_list(F.col(f.name), NAMES).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema if f.name != key]))
    o = _listed(outputs, key, cut(outputs), [(-F.col("final_lines")), F.col("path")], most).toDF(key, "on", "oc", "o")
    s = _listed(documents, key, cut(documents), [F.col("path")], most).toDF(key, "sn", "sc", "s")
    u = _listed(unread, key, F.col("path"), [F.col("path")], UNREAD).toDF(key, "un", "uc", "u")
    facts = counts.select(key, budget.alias("budget"), F.to_json(F.struct(*[c for c in counts.columns if c != key])).alias("facts"))
    rows = facts.join(o, key, "left").join(s, key, "left").join(u, key, "left")
    none = F.array().cast("array<string>")
    few = lambda c, n: F.array_join(F.slice(F.coalesce(c, none), 1, n), ",")
    paths = lambda n: F.to_json(short_list(F.coalesce("u", none), n, F.coalesce("un", F.lit(0))))

    def text(outs: Column, docs: Column, names: Column, end: str) -> Column:
        return F.concat(F.lit('{"counts":'), "facts", F.lit(',"produced_files":['), outs, F.lit('],"documents":['), docs, F.lit('],"unread_sample":'), names, F.lit(end + "}"))

    # a list whose items alone exceed the budget can't be in a text that fits
    whole = lambda c, n: F.coalesce(F.col(n), F.lit(0)) <= F.col("budget")
    flag = ',"context_truncated":true'
    one = F.when(whole("o", "oc") & whole("s", "sc"), text(few("o", most), few("s", most), paths(UNREAD), ""))
    two = F.when(whole("s", "sc"), text(few("o", OUTPUTS), few("s", most), paths(UNREAD_FEW), flag))
    three = text(few("o", OUTPUTS), few("s", DOCUMENTS), paths(UNREAD_FEW), flag)
    rows = rows.select(key, "budget", one.alias("one"), two.alias("two"), three.alias("three"))
    fits = lambda c: F.coalesce(F.length(c) <= F.col("budget"), F.lit(False))
    last = F.concat(F.substring("three", F.lit(1), F.col("budget") - len(TAIL)), F.lit(TAIL))
    digest = F.when(fits("one"), F.col("one")).when(fits("two"), F.col("two")).when(fits("three"), F.col("three")).otherwise(last)
    return rows.select(key, digest.alias("digest"), (~fits("one")).alias("truncated"))

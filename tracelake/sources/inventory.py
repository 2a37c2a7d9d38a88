"""Inventory of source files: which files count, how many lines they have, totals within bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.paths import SOURCE_SUFFIXES, is_code

MAX_FILES = 20_000
#: Directories that hold no sources (fixed values).
SKIPPED = ["/build/", "/.gradle/", "/.git/", "/test/", "/androidtest/", "/node_modules/", "/.idea/", "/generated/"]


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, line_no, text) of the source files below ``root`` that lie under src/main; lines from 1."""
    text = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(root)
    path = F.col("_metadata.file_path")
    low = F.lower(path)
    ok = low.rlike(r"\.(" + "|".join(SOURCE_SUFFIXES) + ")$") & low.contains("/src/main/")
    for part in SKIPPED:
        ok = ok & ~low.contains(part)
    return text.filter(ok).select(path.alias("path"), F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("n", "text")).select("path", (F.col("n") + 1).cast("long").alias("line_no"), "text")


def inventory(lines: DataFrame) -> DataFrame:
    return lines.groupBy("path").agg(F.count(F.lit(1)).alias("n_lines")).withColumn("is_code", is_code(F.col("path")))


def totals(files: DataFrame, most: int = MAX_FILES) -> DataFrame:
    """One row: files, lines, code_files, code_lines; nulls without files or with too many, where the root is likely wrong."""
    a = files.agg(F.count(F.lit(1)).alias("f"), F.sum("n_lines").alias("l"), F.count_if("is_code").alias("cf"), F.coalesce(F.sum(F.when(F.col("is_code"), F.col("n_lines"))), F.lit(0)).alias("cl"))
    ok = F.col("f").between(1, most)
    return a.select(*[F.when(ok, F.col(c)).alias(n) for c, n in (("f", "files"), ("l", "lines"), ("cf", "code_files"), ("cl", "code_lines"))])

"""Files below a folder, listed and read by Spark tasks: many small ones a task, without their names in the driver."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.streaming import landing

#: A file of up to so many bytes is one row.
WHOLE = 1 << 22
#: Bytes that a task gives at once, and that it is dealt.
GIVEN, DEALT = 1 << 22, 1 << 25
#: Endings that Spark's text reader unpacks.
PACKED = r"\.(gz|bz2|zst|zstd|lz4|snappy|deflate)$"
#: Characters that Spark writes as %XX in the path of a file.
ESCAPED = "%" + "".join(map(chr, range(33))) + '"#<>?[\\]^`{|}\x7f'


def found(spark: SparkSession, root: str) -> DataFrame | None:
    """(path, name, size, mtime) of the files below ``root`` that Spark's readers take, ``name`` being their _metadata.file_path; None
    where ``root`` is a pattern or no folder, or not of the mounted file system: there Spark's readers know more than pyarrow."""
    folder = re.sub("^file:(//(?=/))?", "", root).rstrip("/")
    default = spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:"
    if any(c in root for c in "*?[]{}\\") or not folder.startswith("/") or not (root.startswith("file:") or default.startswith("file:")) or not os.path.isdir(folder):
        return None
    below = F.substr("path", F.lit(len(folder) + 1))
    hidden = below.rlike(r"/(\.|_[^/=]*(/|$))") | below.rlike(r"\._COPYING_$")
    rows = landing.listing(spark, folder, ".").filter(~hidden & (F.col("size") > 0))
    name = F.concat(F.lit("file:"), "path")
    for c in ESCAPED:
        name = F.replace(name, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return rows.select("path", name.alias("name"), "size", "mtime")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out: list[tuple] = []
    held = 0
    for batch in batches:
        for path, name in zip(batch["path"], batch["name"], strict=True):
            with open(path, "rb") as f:
                data = f.read()
            out.append((name, [x.decode("utf-8", "replace") for x in data.removeprefix(b"\xef\xbb\xbf").splitlines()]))
            held += len(data)
            if held > GIVEN or len(out) >= landing.ROWS:
                yield pd.DataFrame(out, columns=["path", "lines"])
                out, held = [], 0
    if out:
        yield pd.DataFrame(out, columns=["path", "lines"])


def split(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, list[str]]:
    """(path, lines) of the small files of ``found``, a row each, and patterns of the others, which Spark reads in blocks: they are
    large, or packed. Lines end as in Spark's text reader."""
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    small = (F.col("size") <= min(WHOLE, most)) & ~F.col("path").rlike(PACKED)
    n, size = files.filter(small).agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, size // DEALT)))
    rows = files.filter(small).select("path", "name").repartition(tasks, "path").mapInPandas(_read, "path string, lines array<string>")
    return rows, ["".join(f"\\{c}" if c in "*?[]{}\\" else c for c in r.path) for r in files.filter(~small).select("path").collect()]

"""Following growing files with Spark jobs: new lines land in a table that a stream reads.

A poll lists the folder by Spark tasks, level by level, joins what they find with the
offsets table (path, generation, byte, ...) and reads, in tasks again, the bytes that are new. Neither paths
nor offsets pass through the driver, which sees a few counts; so its memory does not grow with the number of files.

* Lines are delivered once, in whole. A last line without its line feed waits, unless it is a
  whole JSON object already; then it is taken at once, and the line feed that follows is no line.
* A file that shrank, or whose first ``HEAD`` bytes are no longer those read before, gets the
  next generation and is read from its start.
* ``max_bytes`` bounds a poll: each changed file gives an equal share, and at least one line.
* Files are opened through ``pyarrow.fs`` (local paths, file://, s3://, gs://, hdfs://).

Poll n writes ``landed/poll=n``, then version n of the offsets. If it dies in between, the next one is
poll n again and overwrites what it left.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.tables import cut

HEAD = 128
#: Bytes read at once.
PIECE = 1 << 20
LEVEL = "path string, folder boolean, size long, mtime double"
OFFSET = "path string, generation int, byte long, size long, mtime double, head string, head_n long"
LANDED = "is_line boolean, path string, generation int, byte long, line string, size long, mtime double, head string, head_n long"


def opened(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


#: Rows that a task gives at once, as many folders and files have but a few.
ROWS = 4096


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    out: list[tuple] = []
    for batch in batches:
        for root in batch["path"]:
            system, inner = opened(root)
            found = system.get_file_info(fs.FileSelector(inner, recursive=False, allow_not_found=True))
            head = root[: len(root) - len(inner)] if root.endswith(inner) else ""
            out += [(posixpath.join(head + inner, x.base_name), x.type == fs.FileType.Directory, x.size or 0, float(x.mtime_ns or 0) / 1e9) for x in found]
            if len(out) >= ROWS:
                yield pd.DataFrame(out, columns=["path", "folder", "size", "mtime"])
                out = []
    if out:
        yield pd.DataFrame(out, columns=["path", "folder", "size", "mtime"])


def listing(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, size, mtime) of the files below ``root`` whose path matches ``pattern``: one job for each level of folders."""
    level, found = spark.createDataFrame([(root.rstrip("/"),)], "path string"), None
    while True:
        level = cut(level.mapInPandas(_entries, LEVEL), "listed")
        files = level.filter(~F.col("folder") & F.col("path").rlike(pattern)).select("path", "size", "mtime")
        found = files if found is None else found.unionByName(files)
        level = level.filter("folder").select("path")
        n = level.count()
        if not n:
            return found
        level = level.repartition(min(n, 4 * spark.sparkContext.defaultParallelism), "path")


def _is_record(line: bytes) -> bool:
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


def _lines(f, start: int, most: int) -> Iterator[tuple[int, bytes]]:
    """(byte, line) from ``start`` on, until ``most`` bytes are passed; the last line only if it is whole."""
    at, rest = start, b""
    f.seek(start)
    while at - start < most:
        piece = f.read(PIECE)
        if not piece:
            if rest.strip() and _is_record(rest):
                yield at, rest
                at += len(rest)
            break
        *whole, rest = (rest + piece).split(b"\n")
        for line in whole:
            yield at, line
            at += len(line) + 1
            if at - start >= most:
                return


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The new lines of each file and one row with its new offset, from rows (path, size, mtime, generation, byte, head, head_n, most)."""
    out: list[tuple] = []
    held = 0
    for batch in batches:
        for r in batch.itertuples(index=False):
            system, inner = opened(r.path)
            own = len(out)
            try:
                with system.open_input_file(inner) as f:
                    generation, byte, head_n = int(r.generation), int(r.byte), int(r.head_n)
                    if f.size() < byte or (head_n and hashlib.sha1(f.read(head_n)).hexdigest() != r.head):
                        generation, byte = generation + 1, 0
                    end = byte
                    for at, line in _lines(f, byte, int(r.most)):
                        end = min(at + len(line) + 1, f.size())
                        out.append((True, r.path, generation, at, line.rstrip(b"\r").decode("utf-8", "replace"), None, None, None, None))
                        held += len(line)
                        if held > PIECE or len(out) >= ROWS:
                            yield pd.DataFrame(out, columns=_COLUMNS)
                            out, held, own = [], 0, 0
                    n = min(HEAD, end)
                    f.seek(0)
                    out.append((False, r.path, generation, end, None, r.size, r.mtime if end >= r.size else 0.0, hashlib.sha1(f.read(n)).hexdigest(), n))
            except OSError:
                del out[own:]  # gone since it was listed: nothing is known of it until it is listed again
    if out:
        yield pd.DataFrame(out, columns=_COLUMNS)


_COLUMNS = [c.split()[0] for c in LANDED.split(", ")]


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole files with their times, from rows (path, mtime)."""
    out: list[tuple] = []
    held = 0
    for batch in batches:
        for path, mtime in zip(batch["path"], batch["mtime"], strict=True):
            system, inner = opened(path)
            try:
                with system.open_input_file(inner) as f:
                    out.append((path, mtime, f.read().decode("utf-8", "replace")))
            except OSError:
                continue  # gone since it was listed
            held += len(out[-1][2])
            if held > PIECE or len(out) >= ROWS:
                yield pd.DataFrame(out, columns=["path", "mtime", "value"])
                out, held = [], 0
    if out:
        yield pd.DataFrame(out, columns=["path", "mtime", "value"])


def texts(files: DataFrame, n: int) -> DataFrame:
    """(path, mtime, value) of ``n`` files (path, mtime), each read whole by the tasks."""
    tasks = min(n, 8 * files.sparkSession.sparkContext.defaultParallelism)
    return files.select("path", "mtime").repartition(tasks, "path").mapInPandas(_texts, "path string, mtime double, value string")


def offsets(spark: SparkSession, folder: str) -> tuple[int, DataFrame]:
    """The number of the last poll (-1: none) and its offsets."""
    none = spark.createDataFrame([], OFFSET)
    versions = last_version(spark, f"{folder}/offsets")
    return (versions, spark.read.schema(OFFSET).parquet(f"{folder}/offsets/version={versions}")) if versions >= 0 else (-1, none)


def last_version(spark: SparkSession, folder: str) -> int:
    """The highest n of the sub-folders named version=n that hold a finished table; -1 if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return -1
    names = [s.getPath() for s in fs.listStatus(path)]
    done = [int(p.getName().split("=")[1]) for p in names if p.getName().startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(done, default=-1)


def poll(spark: SparkSession, root: str, folder: str, *, pattern: str = r"\.jsonl$", max_bytes: int | None = None, found: DataFrame | None = None) -> int:
    """Lands what is new below ``root`` in ``folder``/landed; the number of files that gave something. ``found`` is a listing that
    the caller has already, also of other files."""
    last, known = offsets(spark, folder)
    n = last + 1
    now = listing(spark, root, pattern) if found is None else found.filter(F.col("path").rlike(pattern))
    old = known.select("path", "generation", "byte", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), "head", "head_n")
    changed = now.join(old, "path", "left").filter("_size is null or _size <> size or _mtime <> mtime or byte < size")
    changed = changed.select("path", "size", "mtime", F.coalesce("generation", F.lit(0)).alias("generation"), F.coalesce("byte", F.lit(0)).alias("byte"), "head", F.coalesce("head_n", F.lit(0)).alias("head_n"))
    changed = cut(changed, "changed")
    files = changed.count()
    if not files:
        return 0
    most = max(1, max_bytes // files) if max_bytes else (1 << 62)
    tasks = min(files, 8 * spark.sparkContext.defaultParallelism)
    got = changed.withColumn("most", F.lit(most).cast("long")).repartition(tasks, "path").mapInPandas(_read, LANDED)
    got.write.mode("overwrite").parquet(f"{folder}/landed/poll={n}")
    landed = spark.read.schema(LANDED).parquet(f"{folder}/landed/poll={n}")
    new = landed.filter("not is_line").select(*[c.split()[0] for c in OFFSET.split(", ")])
    moved = new.join(known.select("path", F.col("generation").alias("_g"), F.col("byte").alias("_b")), "path", "left").filter("_b is null or _g <> generation or _b <> byte").count()
    known.join(new.select("path"), "path", "left_anti").unionByName(new).write.mode("overwrite").parquet(f"{folder}/offsets/version={n}")
    return moved


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of landed lines (path, generation, byte, line)."""
    rows = spark.readStream.schema(LANDED).parquet(f"{folder}/landed/*")
    return rows.filter("is_line").select("path", "generation", "byte", "line")

"""Files that tasks list and read whole give what Spark's readers give, in one pass."""

import gzip

import pytest
from pyspark.sql import functions as F

from tracelake.sources import files, transcripts

ODD = {
    "a.jsonl": b'\xef\xbb\xbf{"i":0}\r\n\n  {"i":1}\r{"i":2}\n{broken\n[1]\n"text"\n\t{"i":3}\nnull\n {}',
    "p/b c%20[1]{x}#?^`|.jsonl": b'{"i":4}\n\xff\n{"s":"\xc3\xa9\xe2\x80\xa8 \x0c\x1c"}\n{"s":"\xc3\xa9\xe2\x80\xa8"}\n',
    "p/é.txt": b'\n{"i":5}\n\n',
    "s=s1/_c=1/d.txt": b'{"i":6}',
    "empty.txt": b"",
    "p/_hidden/x.txt": b'{"i":7}',
    "p/.y.txt": b'{"i":8}',
    "_z.txt": b'{"i":9}',
    "e.txt.gz": gzip.compress(b'\n{"i":10}\n'),
    "large.txt": b'{"i":11}\nx\n' * 3000,
}


@pytest.fixture
def root(tmp_path):
    for name, data in ODD.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    return str(tmp_path / "in")


def _rows(df):
    return sorted(map(tuple, df.select("path", "line_no", "idx", "value", F.to_json("rec")).collect()))


@pytest.mark.parametrize("form", ["file://{}", "{}/"])
def test_small_and_other_files_as_spark_reads_them(spark, root, form):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = _rows(transcripts.scan(spark, form.format(root), raw=True))
        want = _rows(transcripts._of_blocks(spark.read.option("recursiveFileLookup", "true").text(root), True))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == want and len(got) == 3010


def test_listing_as_spark_lists(spark, root):
    want = spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(root).select("_metadata.file_path", "length", "modificationTime")
    assert sorted(map(tuple, transcripts._listed(spark, root, files.found(spark, root)).collect())) == sorted(map(tuple, want.collect()))


def test_roots_that_only_spark_opens(spark, root):
    assert files.found(spark, f"{root}/*.jsonl") is None and files.found(spark, f"{root}/a.jsonl") is None and files.found(spark, "in") is None
    assert transcripts.scan(spark, f"{root}/a.jsonl").count() == 5


def test_small_files_are_numbered_without_a_shuffle(spark, root, capsys):
    (df := transcripts.scan(spark, f"{root}/p")).explain()
    plan = capsys.readouterr().out
    assert df.count() == 3 and "Window" not in plan and plan.count("Exchange") <= 1


def test_a_catalog_lists_once(spark, root, monkeypatch):
    calls, found = [], files.found
    monkeypatch.setattr(files, "found", lambda *a: calls.append(a) or found(*a))
    got = transcripts.catalog(spark, f"{root}/p").collect()
    assert len(calls) == 1 and got == []

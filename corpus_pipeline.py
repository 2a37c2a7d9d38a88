"""The training-data pipeline: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the documents of the next. All but the last keep the columns
of documents; the last has token ids in place of the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm.bpe import encode_stage
from tracelake.llm.decontaminate import decontaminate_stage
from tracelake.llm.jaccard import jaccard_stage
from tracelake.llm.linededup import line_stage
from tracelake.llm.quality import quality_stage
from tracelake.llm.store import cut, table

STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("benchmark_decontamination", decontaminate_stage),
    ("byte_level_bpe", encode_stage),
]

#: Robust estimates and BPE merges are not expressible in SQL; tests/llm/test_pipeline.py has plain loops for the stages after the first.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs

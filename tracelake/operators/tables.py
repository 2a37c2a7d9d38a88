"""Tables in the shared folder that cut the lineage of rounds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tracelake.streaming.shared import shared_folder


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df``, written and read again: later jobs neither recompute it nor lose it with an executor.
    The files stay until the owner of the folder removes them."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

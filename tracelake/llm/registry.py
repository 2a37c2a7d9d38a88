"""Queries and SQL of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import align, bpe, chat, decontaminate, edit_counts, jaccard, licenses, linededup, lm, mixing, quality, runs, suffix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": lm.op1_lm_score,
    "op2_quality_mcd": quality.op2_quality_mcd,
    "op3_chat_format": chat.op3_chat_format,
    "op4_suffix_dedup": suffix.op4_suffix_dedup,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_line_dedup": linededup.op6_line_dedup,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_edit_counts": edit_counts.op9_edit_counts,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_token_align": align.op12_token_align,
    "op13_source_mix": mixing.op13_source_mix,
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": chat.ORACLE_SQL,
    "op5_license_scan": licenses.ORACLE_SQL,
    "op6_line_dedup": linededup.ORACLE_SQL,
    "op7_decontaminate": decontaminate.ORACLE_SQL,
    "op10_jaccard_join": jaccard.ORACLE_SQL,
    "op13_source_mix": mixing.ORACLE_SQL,
}

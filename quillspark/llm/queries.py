"""The queries of the llm operators, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, line_dedup, mixing, ngram_join, quality_fm, quality_rules, rabitq, secrets, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_rabitq": rabitq.op2_rabitq,
    "op3_quality_fm": quality_fm.op3_quality_fm,
    "op4_bpe": bpe.op4_bpe,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_mixing": mixing.op6_mixing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_secrets": secrets.op10_secrets,
}
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": ngram_join.ORACLE,
    "op5_quality_rules": quality_rules.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op9_suffix_dedup": suffix_dedup.ORACLE,
    "op6_mixing": mixing.ORACLE,
}

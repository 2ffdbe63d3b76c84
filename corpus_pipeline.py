"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, line_dedup, mixing, ngram_join, quality_rules
from quillspark.llm._spark import cut, load

#: Each function takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
STAGES = [
    ("quality_rules", quality_rules.stage),
    ("line_dedup", line_dedup.stage),
    ("near_duplicates", ngram_join.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]
#: Similarity joins over whole texts and BPE have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what each but the last returns is written to the shared folder as a Parquet table, which goes when nothing refers to it.

    Result: doc_id, n_tokens, ids_sha256, decoded_sha256, a row for each time that the mix takes a document. Null and
    empty texts fail the quality rules; documents that line dedup empties go; rows that repeat another in all columns
    are one; null doc_ids count as documents of their own. Extra columns with any names pass up to the last stage. An
    empty table gives no rows.
    """
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else cut(out)
    return docs

"""Quality rules as a ledger of failure bits.

Each text is read once. Every rule is evaluated, whatever the others say; the
ledger keeps a document's measurements and one integer whose bit r is set when
rule r fails. A policy is a named, versioned mask of rules: a document is kept
when no bit of the mask is set. What a rule alone rejects (its ablation) comes
from counting the distinct bit patterns, without touching the texts again.

Defined results: a null text is an empty one; an empty text has 0 in all
measurements and fails `few_words` alone. Repeated rows are judged one by one.
Columns besides the text pass through; one that has the name of a measurement
is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import _text as tx
from quillspark.llm._spark import Hidden, load, text_of, trimmed

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters"]
#: Rule, and when it fails. Whole numbers only, so that every engine agrees.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 20 * n_words AND n_words >= 10"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("upper_case", "100 * n_upper > 60 * n_letters AND n_words >= 10"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Versioned policies: masks over the ledger's bits.
POLICIES = {
    "base.v1": BIT["few_words"] | BIT["repeated_words"],
    "strict.v1": sum(BIT.values()),
}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True


def measure(d: np.ndarray, o: np.ndarray) -> list[np.ndarray]:
    """The measurements of each text, in the order of MEASURES."""
    s, e, lo = tx.words(d, o)
    n_words = np.diff(lo)
    chars = tx.sums(tx.IS_WORD[d] & ((d & 0xC0) != 0x80), o)
    # Lines: cut at every \n and at the ends of texts.
    starts, ends, llo = tx.line_bounds(d, o)
    text = tx.owners(llo)
    with_word = np.searchsorted(s, ends, "left") > np.searchsorted(s, starts, "left")
    key = tx.mix(tx.span_hash(d, starts[with_word], ends[with_word]) + tx.mix(text[with_word].astype(np.uint64) + tx.U(1)))
    owner = text[with_word]
    n_lines = np.bincount(owner, minlength=len(n_words))
    n_dup = n_lines - np.bincount(owner[np.unique(key, return_index=True)[1]], minlength=len(n_words))
    # Words inside a window of 5 that the text has twice or more.
    g, glo = tx.grams(tx.span_hash(d, s, e), lo, 5)
    first = tx.owners(glo)
    at = np.arange(len(g)) - glo[first] + lo[first]
    g = tx.mix(g + tx.mix(first.astype(np.uint64) + tx.U(1)))
    order = np.argsort(g)
    same = g[order][1:] == g[order][:-1]
    twice = np.zeros(len(g), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(s) + 6, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + 5, -1)
    n_repeat = tx.sums(np.cumsum(edge)[: len(s)] > 0, lo)
    return [n_words, chars, tx.sums(_SYMBOL[d], o), n_dup, n_repeat, n_lines, tx.sums(_UPPER[d], o), tx.sums(_LETTER[d], o)]


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (the columns `keep`, or all) with the measurements and `fail_bits`. One narrow pass, no shuffle."""
    own = Hidden(docs, [*MEASURES, "fail_bits"], keep)
    source = own.df.select(*own.kept, text_of(own.of(text)).alias("t"))
    schema, kept = source.drop("t").schema, own.kept
    for m in MEASURES:
        schema = schema.add(m, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, o = tx.text_buffer(b.column("t"))
            parts = [measure(x, y) for _, _, x, y in tx.chunks(d, o)]
            cols = [np.concatenate([p[i] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *map(pa.array, cols)], names=[*kept, *MEASURES])

    bits = sum((F.when(F.expr(when), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")) for name, when in RULES), F.lit(0).cast("long"))
    return own.back(source.mapInArrow(trimmed(run), schema).withColumn("fail_bits", bits))


def passes(policy: str, bits: Column | None = None) -> Column:
    """Whether a document is kept under the policy."""
    return (F.col("fail_bits") if bits is None else bits).bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablations(led: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that it alone rejects. Counts of bit patterns, so at most 2^rules rows are shuffled by a task."""
    mask = POLICIES[policy]
    patterns = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in BIT.items() if b & mask))
    at = patterns.withColumn("r", F.explode(rules))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return at.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents with the verdict of strict.v1."""
    led = ledger(load(spark, sf_dir, "documents"), keep=["doc_id"])
    return led.select("doc_id", *MEASURES[:5], (~passes("base.v1")).alias("base_failed"), passes("strict.v1").alias("kept"), "fail_bits")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that strict.v1 keeps, with their columns as they were, whatever their names. Null and empty texts fail few_words; an empty table gives no rows."""
    own = Hidden(docs)
    led = ledger(own.df, own.of("text")).filter(passes("strict.v1"))
    return own.back(led)


_W = r"[^\x20\x09-\x0D]+"
_M = f"""
  SELECT doc_id, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters
  FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_W}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_W}')) AS l FROM documents)"""
_BITS = " + ".join(f"CASE WHEN {when} THEN {BIT[name]} ELSE 0 END" for name, when in RULES)
ORACLE = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(len(w) - 4)) AS i, w FROM w WHERE len(w) >= 5),
k AS (SELECT doc_id, i, w[i + 1:i + 5] AS k FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM k),
p AS (SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n_repeat_words FROM r, range(5) x(j) WHERE c >= 2 GROUP BY doc_id),
m AS ({_M}),
b AS (SELECT m.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN p USING (doc_id)),
f AS (SELECT *, ({_BITS})::BIGINT AS fail_bits FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & {POLICIES["base.v1"]}) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM f"""
#: The pipeline's stage as SQL over a view documents.
KEPT_SQL = f"SELECT d.* FROM documents d JOIN (SELECT doc_id FROM ({ORACLE}) WHERE kept) USING (doc_id)"

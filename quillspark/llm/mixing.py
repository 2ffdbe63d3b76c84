"""Mixing sources to target weights with hash-threshold histograms.

Sources weigh 1, 2, 3 and so on in turn and share all words; a source's target
stops at `most` times its size and the excess goes to the others by weight
until none is above. A source takes its documents floor(target / size) times
and, for the rest of its target, those documents whose hash lies below a
threshold. The threshold is found from histograms: words are summed by source
and the leading bits of the hash, the bucket in which the budget ends is
refined by the next bits, and so on to the last. Only bucket sums are shuffled,
and documents are filtered by comparing a hash, never sorted.

Thresholds nest: a smaller budget takes a subset of what a larger one takes.
Defined results: a null text has size 0; a null source is a source of its own,
after all others; an empty table gives no rows; a total of 0 words gives
targets of 0. Documents with the same id share a hash, so they are taken
together. Reruns agree, since the hash depends on the doc_id alone. Columns may have
any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm._spark import Hidden, cut, load

WEIGHTS, MOST = (1, 2, 3), 3
#: Bits of the hash that each round of histograms splits by; 60 in all.
LEVELS = (12, 16, 16, 16)


def size_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def unit_hash(doc_id: Column) -> Column:
    """60 bits of the md5 of the doc_id's decimal digits (of 'null' for a null)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def targets(totals: DataFrame) -> DataFrame:
    """source_size per source, with weight and target. One row per source, so one small task orders them.

    Sources reach their limits in the order of limit / weight. With those before it at their limits,
    a source gets (total - their limits) * weight / (weights from it on), unless that is above its own.
    """
    byname = W.orderBy(F.col("__source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(byname) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("long")
    t = totals.withColumn("weight", weight).withColumn("__cap", MOST * F.col("source_size"))
    by = W.orderBy((F.col("__cap") / F.col("weight")).asc(), F.col("__source").asc_nulls_last())
    before = F.coalesce(F.sum("__cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing))
    level = (F.sum("source_size").over(W.partitionBy()) - before) / after
    t = t.withColumn("__level", level).withColumn("__full", level * F.col("weight") >= F.col("__cap"))
    # The first source that isn't full sets the level of all that follow.
    t = t.withColumn("__at", F.min(F.when(~F.col("__full"), F.struct(F.col("__cap") / F.col("weight"), F.col("__level")))).over(W.partitionBy())["__level"])
    target = F.when(F.col("__at").isNull(), F.col("__cap").cast("double")).otherwise(F.least(F.col("__at") * F.col("weight"), F.col("__cap").cast("double")))
    return t.select("__source", "source_size", "weight", target.alias("target"))


def _boundary(hist: DataFrame, budget: DataFrame) -> DataFrame:
    """The bucket in which each source's budget ends, and what is left of the budget at its start. At most 2^16 buckets a source are ordered."""
    by = W.partitionBy("__source").orderBy("__b")
    h = hist.withColumn("__cum", F.sum("n").over(by)).alias("h").join(budget.alias("g"), F.col("h.__source").eqNullSafe(F.col("g.__source")))
    over = h.filter(F.col("__cum") > F.col("__left")).select(F.col("h.__source").alias("__source"), "__b", (F.col("__left") - F.col("__cum") + F.col("n")).alias("__rest"))
    return over.groupBy("__source").agg(F.min(F.struct("__b", "__rest")).alias("m")).select("__source", "m.__b", F.col("m.__rest").alias("__left"))


def plan_mix(slim: DataFrame) -> DataFrame:
    """From (__source, size, __h) per document: per source its size, weight, target, whole copies and the hash below which a document is taken once more."""
    shift = 60 - LEVELS[0]
    hist = slim.groupBy("__source", F.shiftright("__h", shift).alias("__b")).agg(F.sum("size").alias("n"))
    plan = cut(targets(hist.groupBy("__source").agg(F.sum("n").alias("source_size"))))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("whole", whole)
    left = F.greatest(F.floor(F.col("target") - F.col("whole") * F.col("source_size")), F.lit(0)).cast("long")
    state = cut(_boundary(hist, plan.select("__source", left.alias("__left"))))
    for bits in LEVELS[1:]:
        near = slim.alias("d").join(state.alias("s"), F.col("d.__source").eqNullSafe(F.col("s.__source")) & (F.shiftright(F.col("d.__h"), shift) == F.col("s.__b")))
        shift -= bits
        level = near.groupBy(F.col("d.__source").alias("__source"), F.shiftright(F.col("d.__h"), shift).alias("__b")).agg(F.sum("size").alias("n"))
        state = cut(_boundary(level, state.select("__source", "__left")))
    lo = state.select(F.col("__source").alias("__k"), F.col("__b").alias("__lo"))
    return plan.join(lo, F.col("__source").eqNullSafe(F.col("__k")), "left").select(F.col("__source").alias("__k"), "source_size", "weight", "target", "whole", F.coalesce("__lo", F.lit(0).cast("long")).alias("__lo"))


def copies(docs: DataFrame, plan: DataFrame, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """docs joined with the plan: its columns in the struct `row`, the plan's, and `copies`, how often the mix takes the document."""
    base = docs.select(F.struct("*").alias("row"), docs[source].alias("__source"), unit_hash(docs[doc_id]).alias("__h"))
    out = base.join(plan, F.col("__source").eqNullSafe(F.col("__k")))
    return out.select("row", "source_size", "target", (F.col("whole") + (F.col("__h") < F.col("__lo")).cast("long")).alias("copies"))


def slim_of(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """What the plan needs of each document: id, source, size and hash."""
    own = Hidden(docs)
    id_ = F.col(own.of(doc_id))
    return own.df.select(id_.alias("doc_id"), F.col(own.of(source)).alias("__source"), size_of(F.col(own.of(text))).alias("size"), unit_hash(id_).alias("__h"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: each one's size, its source's size and target, and the words of it that are taken."""
    slim = cut(slim_of(load(spark, sf_dir, "documents")))
    out = copies(slim, plan_mix(slim), source="__source")
    return out.select("row.doc_id", "row.size", "source_size", "target", (F.col("copies") * F.col("row.size")).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, 0 to 3 times. Null texts have size 0, a null source is one of its own, documents with one doc_id (or none) are taken together; columns may have any names and an empty table gives no rows."""
    plan = plan_mix(cut(slim_of(docs).drop("doc_id")))
    own = Hidden(docs)
    out = copies(own.df, plan, own.of("source"), own.of("doc_id")).filter("copies > 0")
    return own.back(out.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || md5(coalesce(doc_id::VARCHAR, 'null'))[1:15])::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
c AS (SELECT *, 3 * source_size AS cap, 3 * source_size / w AS r FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / (sum(w) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM c),
f AS (SELECT level FROM l WHERE level * w < cap ORDER BY r, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, coalesce(least((SELECT level FROM f) * w, cap::DOUBLE), cap::DOUBLE) AS target FROM l),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
k AS (SELECT *, greatest(floor(target - whole * source_size), 0)::BIGINT AS rest FROM u),
h AS (SELECT source, h, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS cum FROM d GROUP BY source, h),
b AS (SELECT k.source, min(h.h) AS lo FROM k JOIN h ON h.source IS NOT DISTINCT FROM k.source AND h.cum > k.rest GROUP BY k.source)
SELECT d.doc_id, d.size, k.source_size, k.target, (k.whole + CASE WHEN d.h < coalesce(b.lo, 0) THEN 1 ELSE 0 END) * d.size AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source LEFT JOIN b ON b.source IS NOT DISTINCT FROM k.source"""

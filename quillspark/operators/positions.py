"""Columns with positions: rows (pos, s), pos counting from 0 without gaps."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one, which goes when the driver ends, if it has none and is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            at = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, at, True)
        sc.setCheckpointDir(at)
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df, computed once into the checkpoint folder of the session."""
    folder(df.sparkSession)
    return df.checkpoint()


def dense(df: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """df with the row's place in that order. A range sort; only one count a partition is brought together."""
    t = settled(df.orderBy(*order).select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__i")))
    sizes = t.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__p", (F.sum("n").over(W.orderBy("__p")) - F.col("n")).alias("__before"))
    return t.join(F.broadcast(before), "__p").withColumn(name, F.col("__before") + F.col("__i")).drop("__p", "__i", "__before")


def from_strings(*frames: DataFrame) -> DataFrame:
    """The rows of all frames, one after another. Each frame is measured once, to one row."""
    out, before = frames[0].select("pos", "s"), None
    for last, f in zip(frames, frames[1:], strict=False):
        own = last.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("__n"))
        before = own if before is None else before.crossJoin(own.withColumnRenamed("__n", "__m")).select((F.col("__n") + F.col("__m")).alias("__n"))
        out = out.unionByName(f.crossJoin(F.broadcast(before)).select((F.col("pos") + F.col("__n")).alias("pos"), "s"))
    return out


add_strings = from_strings


def order(frame: DataFrame, by_length: bool = False, by_name: bool = True, ascending: bool = True, nulls_first: bool = True) -> list[Column]:
    """Sort keys: bytes, name or both; where nulls go doesn't depend on the direction; pos breaks ties."""
    nulls = F.col("s").isNull()
    keys = [nulls.desc() if nulls_first else nulls.asc()]
    for use, key in ((by_length, F.octet_length("s")), (by_name, F.col("s"))):
        if use:
            keys.append(key.asc() if ascending else key.desc())
    return [*keys, F.col("pos").asc()]


def sort(frame: DataFrame, **how: bool) -> DataFrame:
    """Sorted, with new positions."""
    return dense(frame.withColumnRenamed("pos", "__old").select(F.col("__old").alias("old"), "s"), *[k for k in order(frame.select("pos", "s"), **how)[:-1]], F.col("old").asc()).select("pos", "s")


def argsort(frame: DataFrame, **how: bool) -> DataFrame:
    """(pos, index): the old position that comes at each place."""
    t = frame.select(F.col("pos").alias("index"), "s")
    return dense(t, *order(frame, **how)[:-1], F.col("index").asc()).select("pos", "index")


def gather(frame: DataFrame, indexes: DataFrame) -> DataFrame:
    """Rows at (pos, index); an index that isn't there raises."""
    t = indexes.join(frame.select(F.col("pos").alias("index"), "s", F.lit(True).alias("__there")), "index", "left")
    return t.select("pos", F.when(F.col("__there").isNull(), F.raise_error(F.lit("index out of range")).cast("string")).otherwise(F.col("s")).alias("s"))


sublist = gather


def gather_mask(frame: DataFrame, mask: Column) -> DataFrame:
    """Rows for which mask holds, with new positions."""
    return dense(frame.filter(mask).select(F.col("pos").alias("__old"), "s"), "__old").select("pos", "s")


def scatter(frame: DataFrame, other: DataFrame) -> DataFrame:
    """Rows with those of other (index, s) in their places; of repeated places the last in byte order counts."""
    o = other.groupBy("index").agg(F.max(F.struct(F.lit(True).alias("there"), "s")).alias("__o"))
    return frame.join(o, F.col("pos") == F.col("index"), "left").select("pos", F.when(F.col("__o").isNotNull(), F.col("__o.s")).otherwise(F.col("s")).alias("s"))


def scalar_scatter(frame: DataFrame, value: str | None, indexes: list[int]) -> DataFrame:
    """One text at the places; places that aren't there are ignored."""
    return frame.withColumn("s", F.when(F.col("pos").isin(indexes), F.lit(value)).otherwise(F.col("s")))


def remove_strings(frame: DataFrame, indexes: DataFrame) -> DataFrame:
    """Rows but those at (index), with new positions."""
    t = frame.join(indexes.select(F.col("index").alias("pos")).distinct(), "pos", "left_anti")
    return dense(t.select(F.col("pos").alias("__old"), "s"), "__old").select("pos", "s")


def slice_rows(frame: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows by a Python slice; a negative step goes backwards."""
    if step == 0:
        raise ValueError("step is 0")
    n = frame.count() if (start or 0) < 0 or (stop or 0) < 0 or step < 0 else 0
    if step < 0:
        at = range(*slice(start, stop, step).indices(n))
        t = frame.filter((F.col("pos") <= at.start) & (F.col("pos") > at.stop) & ((at.start - F.col("pos")) % -step == 0))
        return t.select(((F.lit(at.start) - F.col("pos")) / -step).cast("long").alias("pos"), "s")
    start, stop = (start or 0) + (n if (start or 0) < 0 else 0), (stop + n if stop is not None and stop < 0 else stop)
    t = frame.filter((F.col("pos") >= start) & ((F.col("pos") - start) % step == 0))
    t = t if stop is None else t.filter(F.col("pos") < stop)
    return t.select(((F.col("pos") - start) / step).cast("long").alias("pos"), "s")


def cat(frame: DataFrame, *others: DataFrame, sep: str = "", na_rep: str | None = None) -> DataFrame:
    """Row by row with other frames."""
    from quillspark.functions import strings

    out, names = frame.withColumnRenamed("s", "s0"), ["s0"]
    for i, o in enumerate(others, 1):
        out = out.join(o.withColumnRenamed("s", f"s{i}"), "pos")
        names.append(f"s{i}")
    return out.select("pos", strings.cat([F.col(n) for n in names], sep, na_rep).alias("s"))


def join(frame: DataFrame, sep: str = "") -> DataFrame:
    """All rows as one text, in order, nulls left out. Its result is one row, so one task holds it."""
    return frame.filter("s IS NOT NULL").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), sep).alias("s"))


def ngrams(tokens: DataFrame, n: int = 2, sep: str = "_") -> DataFrame:
    """Windows of n tokens (pos, s) over the whole column, nulls and empties left out; all in one if there are no more than n. Joins on the place, so no task holds all rows."""
    t = dense(tokens.filter("s <> ''").select(F.col("pos").alias("__old"), "s"), "__old").select("pos", "s")
    total = t.count()
    if total <= n:
        return join(t, sep).filter("s <> ''").select(F.lit(0).cast("long").alias("pos"), "s")
    out = t.select("pos", F.col("s").alias("s0"))
    for k in range(1, n):
        out = out.join(t.select((F.col("pos") - k).alias("pos"), F.col("s").alias(f"s{k}")), "pos")
    return out.select("pos", F.concat_ws(sep, *(f"s{k}" for k in range(n))).alias("s"))


def scatter_count(frame: DataFrame, counts: Column) -> DataFrame:
    """Each row as often as its count says (null: never), with new positions."""
    t = frame.select("pos", "s", F.explode(F.sequence(F.lit(1), F.greatest(F.coalesce(counts, F.lit(0)), F.lit(1)))).alias("__k"), F.coalesce(counts, F.lit(0)).alias("__c")).filter("__c > 0")
    return dense(t.select(F.col("pos").alias("__old"), "__k", "s"), "__old", "__k").select("pos", "s")


def info(frame: DataFrame) -> DataFrame:
    """One row of statistics; minima leave empty strings out. Distinct texts are counted by 128 bits of hash, so no text is shuffled."""
    s, chars, size = F.col("s"), F.char_length("s"), F.octet_length("s")
    some = s.isNotNull() & (s != "")
    n = lambda p: F.coalesce(F.sum(F.regexp_count(s, F.lit(p))), F.lit(0)).cast("long")
    return frame.agg(
        F.count(F.lit(1)).alias("total_strings"), F.count_if(s.isNull()).alias("null_strings"), F.count_if(s == "").alias("empty_strings"),
        (F.count_distinct(F.xxhash64(s), F.when(s.isNotNull(), F.xxhash64(F.lit(1), s))) + F.max(s.isNull().cast("int"))).cast("long").alias("unique_strings"), F.sum(size).cast("long").alias("total_bytes"), F.sum(chars).cast("long").alias("total_chars"),
        F.max(size).alias("bytes_max"), F.min(F.when(some, size)).alias("bytes_min"), F.max(chars).alias("chars_max"), F.min(F.when(some, chars)).alias("chars_min"),
        F.floor(F.sum(size) / F.count(s)).cast("long").alias("bytes_avg"), F.floor(F.sum(chars) / F.count(s)).cast("long").alias("chars_avg"),
        n(r"[\x09-\x0d\x20]").alias("whitespace_count"), n("[0-9]").alias("digits_count"), n(r"\p{Lu}").alias("uppercase_count"), n(r"\p{Ll}").alias("lowercase_count"),
    )


def bytes_total(frame: DataFrame) -> DataFrame:
    """One row: n, the UTF-8 bytes of all rows."""
    return frame.agg(F.coalesce(F.sum(F.octet_length("s")), F.lit(0)).cast("long").alias("n"))


def memory(frame: DataFrame) -> DataFrame:
    """One row: n, the bytes of all rows in a layout of a pointer each and, for those that aren't null, a header of 8 bytes and the text, to a multiple of 8."""
    own = F.ceil((F.octet_length("s") + 8) / 8) * 8
    return frame.agg(F.coalesce(F.sum(8 + F.coalesce(own, F.lit(0))), F.lit(0)).cast("long").alias("n"))


def nulls(frame: DataFrame, empty_is_null: bool = False) -> DataFrame:
    """(pos) of the rows that are null, or empty if that counts."""
    from quillspark.functions import strings

    return frame.filter(strings.is_null(F.col("s"), empty_is_null)).select("pos")


def null_bitmask(frame: DataFrame) -> DataFrame:
    """(byte, mask): bit k of byte i is set when row 8 i + k isn't null."""
    bit = F.when(F.col("s").isNotNull(), F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (F.col("pos") % 8 + 1).cast("int"))).otherwise(F.lit(0))
    return frame.groupBy(F.floor(F.col("pos") / 8).alias("byte")).agg(F.sum(bit).cast("int").alias("mask"))


def unique_tokens(frame: DataFrame, delimiter: str | None = None) -> DataFrame:
    """(pos, s): the distinct tokens of all rows, sorted."""
    from quillspark.functions import text

    return dense(frame.select(F.explode(text.tokens(F.col("s"), delimiter)).alias("s")).distinct(), "s").select("pos", "s")


def histogram(frame: DataFrame) -> DataFrame:
    """(char, n): how often each character occurs."""
    return frame.select(F.explode(F.split("s", "")).alias("char")).filter("char <> ''").groupBy("char").agg(F.count(F.lit(1)).alias("n"))

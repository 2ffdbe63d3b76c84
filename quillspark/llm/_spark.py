"""Session helpers of the llm operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A Bloom filter's bits a row, and the least and most bits of one, as powers of 2 (32 MB at most).
BLOOM_ROW, BLOOM_LEAST, BLOOM_MOST = 16, 20, 28

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables, as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one of its own where that is unset and the master is local."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, at, True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written as a Parquet table to the folder that all executors share; its lineage ends there, so a lost executor costs nothing.

    The table lies in the folder of an empty checkpoint that the result's plan refers to. So Spark's cleaner deletes
    it with that checkpoint when no plan refers to it any more, if spark.cleaner.referenceTracking.cleanCheckpoints is
    set; at the latest it goes when the driver ends.
    """
    spark = df.sparkSession
    shared_folder(spark)
    mark = spark.createDataFrame([], "x int").checkpoint()  # no partitions, so no task and no file
    at = mark._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
    if not _MADE:
        atexit.register(_remove, spark)
    _MADE.append(at)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # the shuffle files behind the table go as soon as it is written
    try:
        df.write.parquet(f"{at}/table")
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    none = mark.filter(F.lit(False)).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema))
    return spark.read.schema(df.schema).parquet(f"{at}/table").union(none)  # the optimiser drops the empty part


_MADE: list[str] = []


def _remove(spark: SparkSession) -> None:
    """Deletes the tables that are left while the session still runs."""
    sc = spark.sparkContext
    if sc._jsc is not None:
        for at in _MADE:
            path = sc._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def bloom_of(df: DataFrame, hashed: Column) -> np.ndarray:
    """A Bloom filter with two bits a row, from a column of well mixed hashes; its size follows the number of rows, up to 2^BLOOM_MOST bits. It only saves sending rows that a join drops later, so a full one is slow and never wrong."""
    rows = max(df.count(), 1)
    size = min(max((rows * BLOOM_ROW - 1).bit_length(), BLOOM_LEAST), BLOOM_MOST)
    both = F.explode(F.array(*(F.shiftright(hashed, k).bitwiseAND(F.lit((1 << size) - 1)) for k in (0, 32))))
    bit = F.col("bit")
    b = df.select(both.alias("bit")).select(F.shiftright(bit, 6).cast("int").alias("w"), bit.bitwiseAND(63).cast("int").alias("s"))
    words = b.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, s)")).alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), np.int64)
    out[np.asarray(words["w"])] = np.asarray(words["bits"])
    return out.view(np.uint64)


def in_bloom(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter."""
    out = np.ones(len(hashes), bool)
    for k in (0, 32):
        bit = (hashes >> k) & (len(bloom) * 64 - 1)
        out &= ((bloom[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
    return out


class Hidden:
    """docs with its columns under names of our own, so that no name of the user's can clash with an operator's or needs quoting.

    df has the columns c0, c1 and so on; `kept` are those that pass, all or those named in `keep`, without any that an
    output of the operator replaces (compared without case). back() gives a result with the kept columns, then the
    outputs, their names again.
    """

    def __init__(self, docs: DataFrame, outputs: list[str] | tuple[str, ...] = (), keep: list[str] | None = None):
        self.names, self.outputs = docs.columns, list(outputs)
        self.df = docs.toDF(*(f"c{i}" for i in range(len(self.names))))
        gone = {x.lower() for x in outputs}
        wanted = None if keep is None else {self.of(k) for k in keep}
        self.kept = [f"c{i}" for i, n in enumerate(self.names) if n.lower() not in gone and (wanted is None or f"c{i}" in wanted)]

    def of(self, name: str) -> str:
        """Our name for the user's column: the one so spelled, else the first that differs in case alone."""
        for test in (lambda n: n == name, lambda n: n.lower() == name.lower()):
            for i, n in enumerate(self.names):
                if test(n):
                    return f"c{i}"
        raise KeyError(f"no column {name} among {self.names}")

    def back(self, out: DataFrame) -> DataFrame:
        """out, which has the kept columns and then the outputs, under the user's names."""
        return out.select(*self.kept, *self.outputs).toDF(*(self.names[int(c[1:])] for c in self.kept), *self.outputs)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; when a task ends, its worker, which waits for others, gives the system back what it has freed. Idle workers count against an executor's memory."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
            if trim is not None:
                trim(0)

    return each


def text_of(column: str) -> Column:
    """A column as text."""
    return F.col(column).cast("string")

"""Sources and sinks of string columns (pos, s)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.positions import dense


def to_frame(spark: SparkSession, values: list[str | None]) -> DataFrame:
    """A list of texts."""
    return spark.createDataFrame(list(enumerate(values)), "pos long, s string")


def to_host(frame: DataFrame) -> list[str | None]:
    """All rows as a list, in order."""
    return [r.s for r in frame.orderBy("pos").collect()]


def from_csv(spark: SparkSession, path: str, column: int, lines: int = 0, sort_length: bool = False, sort_name: bool = False, keep_empty: bool = False) -> DataFrame:
    """One column (from 0) of a CSV file with a header, in the file's order; at most `lines` rows, empty fields null unless kept."""
    raw = spark.read.option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "\x00").csv(path)
    s = F.col(f"`{raw.columns[column]}`").cast("string")
    s = F.coalesce(s, F.lit("")) if keep_empty else F.nullif(s, F.lit(""))
    # Places in the folder: files by name, blocks by place, rows in the order of the scan.
    t = raw.select(F.struct(F.input_file_name(), F.input_file_block_start(), F.monotonically_increasing_id()).alias("__at"), s.alias("s"))
    t = t.orderBy("__at").limit(lines) if lines else t
    keys = [F.octet_length("s").asc_nulls_first()] * sort_length + [F.col("s").asc_nulls_first()] * sort_name
    return dense(t, *keys, F.col("__at")).select("pos", "s")


def from_offsets(spark: SparkSession, data: bytes, offsets: list[int], validity: bytes | None = None) -> DataFrame:
    """Arrow buffers: UTF-8 bytes, n + 1 offsets, and a bitmap with 0 for null."""
    a = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(pa.array(offsets, pa.int32()).buffers()[1]), pa.py_buffer(data), pa.py_buffer(validity) if validity else None)
    return spark.createDataFrame(pa.table({"pos": pa.array(range(len(a)), pa.int64()), "s": a}))


def to_offsets(frame: DataFrame) -> tuple[bytes, list[int], bytes]:
    """The same buffers of a frame, in order."""
    a = frame.orderBy("pos").select("s").toArrow().column(0).combine_chunks()
    size = pc.fill_null(pc.binary_length(a), 0)
    bits = np.packbits(np.asarray(a.is_valid()), bitorder="little").tobytes()
    return b"".join(pc.fill_null(a, "").cast(pa.binary()).to_pylist()), [0, *np.cumsum(np.asarray(size)).tolist()], bits

"""Positions, categories and sources against golden values."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import positions as P
from quillspark.operators.category import Category
from quillspark.sources import columns

A = ["eee", "aaa", "eee", "ddd", "ccc", "ccc", "ccc", "eee", "aaa"]
B = ["ggg", "fff", "hhh", "aaa", "fff", "fff", "ggg", "hhh", "bbb"]


def codes(c):
    return [r.code for r in c.codes.orderBy("pos").collect()]


def keys(c):
    return [r.key for r in c.keys.orderBy("code").collect()]


def test_positions(spark):
    f = columns.to_frame(spark, ["b", None, "a", "ccc", ""])
    assert columns.to_host(P.sort(f)) == [None, "", "a", "b", "ccc"]
    assert [r["index"] for r in P.argsort(f, nulls_first=False, ascending=False).orderBy("pos").collect()] == [3, 0, 2, 4, 1]
    idx = spark.createDataFrame([(0, 3), (1, 3), (2, 1)], "pos long, index long")
    assert columns.to_host(P.gather(f, idx)) == ["ccc", "ccc", None]
    with pytest.raises(Exception, match="out of range"):
        P.gather(f, idx.withColumn("index", F.lit(9).cast("long"))).collect()
    assert columns.to_host(P.remove_strings(f, idx)) == ["b", "a", ""]
    assert columns.to_host(P.scatter(f, spark.createDataFrame([(1, None), (0, "z")], "index long, s string"))) == ["z", None, "a", "ccc", ""]
    assert columns.to_host(P.from_strings(f, f)) == ["b", None, "a", "ccc", ""] * 2
    assert columns.to_host(P.slice_rows(f, -3, None, 2)) == ["a", ""]
    assert columns.to_host(P.slice_rows(f, None, None, -2)) == ["", "a", "b"]
    assert columns.to_host(P.slice_rows(f, 3, 0, -1)) == ["ccc", "a", None] and columns.to_host(P.slice_rows(f, 0, 3, -1)) == []
    assert columns.to_host(P.from_strings(f, f.limit(0), f, f)) == ["b", None, "a", "ccc", ""] * 3
    assert (P.bytes_total(f).first().n, P.memory(f).first().n) == (5, 8 * 5 + 3 * 16 + 8)
    assert [r.pos for r in P.nulls(f, True).orderBy("pos").collect()] == [1, 4] and P.null_bitmask(f).first().mask == 0b11101
    assert columns.to_host(P.unique_tokens(columns.to_frame(spark, ["b a", None, "c a", ""]))) == ["a", "b", "c"]
    assert P.join(f, "-").first().s == "b-a-ccc-"
    assert columns.to_host(P.ngrams(columns.to_frame(spark, ["this", "is", None, "my", "book"]))) == ["this_is", "is_my", "my_book"]
    assert columns.to_host(P.ngrams(columns.to_frame(spark, ["a", "b"]), 3)) == ["a_b"]
    assert columns.to_host(P.scatter_count(f, F.col("pos") % 3)) == [None, "a", "a", ""]
    assert columns.to_host(P.cat(f, f, sep="+", na_rep="?")) == ["b+b", "?+?", "a+a", "ccc+ccc", "+"]
    assert P.info(f).first().unique_strings == 5


def test_category(spark):
    a, b = (Category.encode(columns.to_frame(spark, x)) for x in (A, B))
    m = a.merge(b)
    assert keys(m) == ["aaa", "ccc", "ddd", "eee", "bbb", "fff", "ggg", "hhh"]
    assert codes(m) == [3, 0, 3, 2, 1, 1, 1, 3, 0, 6, 5, 7, 0, 5, 5, 6, 7, 4]
    r = a.merge_and_remap(b)
    assert codes(r) == [4, 0, 4, 3, 2, 2, 2, 4, 0, 6, 5, 7, 0, 5, 5, 6, 7, 1]
    n = Category.encode(spark.createDataFrame(list(enumerate([4, 1, 2, 3, 2, 1, 4, 1, 1])), "pos long, s int"))
    gone = n.remove_keys(spark.createDataFrame([(3,), (0,)], "key int"))
    assert keys(gone) == [1, 2, 4] and codes(gone) == [2, 0, 1, -1, 1, 0, 2, 0, 0]
    assert a.bounds("bbb") == (0, 1) and a.bounds("ccc") == (1, 1) and a.value("zzz") == -1
    assert [x.pos for x in a.indexes_for_key("aaa").orderBy("pos").collect()] == [1, 8]


def test_sources(spark, tmp_path):
    data = columns.to_offsets(columns.to_frame(spark, ["é", None, "", "x"]))
    assert data == ("éx".encode(), [0, 2, 2, 2, 3], b"\x0d")
    assert columns.to_host(columns.from_offsets(spark, *data)) == ["é", None, "", "x"]
    (tmp_path / "a.csv").write_text('h1,h2\n1,"a ""b"""\n2,\n3,c\n')
    assert columns.to_host(columns.from_csv(spark, str(tmp_path / "a.csv"), 1)) == ['a "b"', None, "c"]
    assert columns.to_host(columns.from_csv(spark, str(tmp_path / "a.csv"), 1, lines=2, keep_empty=True)) == ['a "b"', ""]

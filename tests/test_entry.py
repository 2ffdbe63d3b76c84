"""The driver contract: every query of the reference's operators equals its SQL."""

import os
from glob import glob

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.plans import catalog

SF = "/root/testdata/sf0.001"


def test_contract(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, SF).toArrow()
    if name not in catalog.ORACLE_SQL:
        assert got.num_rows
        return
    con = duckdb.connect()
    for p in glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.execute(catalog.ORACLE_SQL[name]).to_arrow_table()
    cols = sorted(got.column_names)
    assert cols == sorted(want.column_names)
    assert sorted(map(str, got.select(cols).to_pylist())) == sorted(map(str, want.select(cols).to_pylist()))


def test_findall_long_keeps_all_matches(spark):
    got = catalog.QUERIES["q_findall"](spark, SF).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    texts = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id").text
    want = texts.str.count("th[a-z]")
    assert got.max() > 2 and got.to_dict() == want[want > 0].to_dict()


@pytest.mark.parametrize("name", ["isalnum", "isalpha", "isdigit", "isdecimal", "isnumeric", "isspace"])
def test_predicates_read_whole_texts(spark, tmp_path, name):
    yes = {"isalnum": "a1", "isalpha": "ab", "isspace": " \t    "}.get(name, "12")
    rows = [(1, yes), (2, yes * 40_000), (3, yes * 40_000 + "!"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.v0 for r in catalog.QUERIES[f"q_{name}"](spark, str(tmp_path)).collect()}
    assert got == {1: True, 2: True, 3: False, 4: None}

"""Every registered query of the type engine against DuckDB, and the driver's contract."""

import pytest

import __spark_entry__ as e
from oracle import compared
from railframe import catalogue

from conftest import SF


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_rows_are_those_of_sql(spark, name):
    assert compared(spark, SF, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name]) is None


def test_rows_without_sql(spark):
    rows = catalogue.QUERIES["generated_ids"](spark, SF).collect()
    names = {r["p_partkey"]: r["p_name"] for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    assert len(rows) == len(names) == len({r["id"] for r in rows})
    assert all(r["initials"] == "".join(w[0] for w in names[r["p_partkey"]].split()) for r in rows)


def test_whole_texts_are_split(spark, tmp_path):
    rows = [(1, "a. b. " + "c. " * 500), (2, "x" * 300 + ". y"), (3, ". . "), (4, ""), (5, "a. . b. "), (6, "z" * 198 + ". tail. end")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["parts"] for r in catalogue.QUERIES["split_text"](spark, str(tmp_path)).collect()}
    assert got == {1: 502, 2: 2, 3: 0, 4: 0, 5: 3, 6: 3}


@pytest.mark.parametrize("name", ["stream_valid", "stream_invalid"])
def test_streams_are_written_to_files(spark, name):
    out = catalogue.QUERIES[name](spark, SF)
    assert out.inputFiles() and all(f.endswith(".parquet") for f in out.inputFiles())


def test_contract(spark):
    assert e.entry(spark).columns == ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "ok", "errors"]
    assert e.entry(spark).where("ok").count() == 139
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalogue.QUERIES) <= set(e.queries())


def test_filters_reach_the_scan(spark, capsys):
    catalogue.QUERIES["meet_ranges"](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan and "LessThanOrEqual(l_quantity,40.0)" in plan and "100.0" not in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in plan
    catalogue.QUERIES["never_empty"](spark, SF).explain()
    assert "FileScan" not in capsys.readouterr().out

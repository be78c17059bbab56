"""The driver's contract, SQL beside queries on the smallest tables, and the streaming reader."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import types as T

import __spark_entry__ as entry
from tessera import queries
from tessera.streaming.bronze import deduplicated, ingest_available, stream_source

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return str(float(v)) if not isinstance(v, str | bool) and hasattr(v, "__float__") else str(v)


@pytest.mark.parametrize("name", ["customer_features", "fk_cascade", "line_items_fk", "clean_date_mixed", "edges_similar_to", "q_vendor_influence", "quality_summary", "dedup_keep_first", "place_csv", "place_json_lines", "place_parquet", "first_row_over_files", "scan_json_list", "scan_json_first_list", "scan_json_empty", "flatten_by_record", "silver_from_files", "quarantine_array", "graph_load_errors", "q_reliable_vendor_products", "nodes_first_row", "agents_last_row", "edges_first_row", "clean_phone_varied", "graph_degree_summary"])
def test_queries_equal_their_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda found, names: sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in found)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL) <= set(entry.queries())


def test_stream_reads_each_file_once(spark, tmp_path):
    schema = T.StructType().add("k", "string").add("at", "timestamp")
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    write = lambda *keys: spark.createDataFrame([(k,) for k in keys], "k string").selectExpr("k", "timestamp'2024-01-01 00:00:00' as at").coalesce(1).write.mode("append").parquet(source)
    for new, total in ((("a", "b"), 2), (("c",), 3)):
        write(*new)
        ingest_available(stream_source(spark, source, schema), table, str(tmp_path / "check")).awaitTermination()
        assert spark.read.parquet(table).count() == total
    assert set(spark.read.parquet(table).columns) == {"k", "at", "_source_file", "_loaded_at"}
    write("a", "a")
    ingest_available(deduplicated(stream_source(spark, source, schema), ["k"], "at"), str(tmp_path / "once"), str(tmp_path / "check2")).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "once")).collect()) == ["a", "b", "c"]

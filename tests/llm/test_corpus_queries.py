import os

import duckdb
import pytest

from emberflow.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n != "pipeline"])
def test_query_returns_all_rows(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = Q.QUERIES[name](spark, SF).count()
    assert rows >= n if name == "op5_packing" else rows == n if name not in ("op9_nearest", "op12_divergence", "near_duplicates") else rows > 0


@pytest.mark.parametrize("name", Q.ORACLE_SQL)
def test_query_equals_its_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = db.execute(Q.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = Q.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.fetchall()))

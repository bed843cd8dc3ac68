"""Registered queries: against their SQL, and the plans of the native ones."""

import duckdb
import pytest

from shiftlog.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    at = sorted(range(len(columns)), key=lambda i: want.description[i][0])
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(
        tuple(r[i] for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", ["op5_license_scan", "op9_bottom_k"])
def test_native_plans_have_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    for node in ("Python", "Pandas", "Arrow", "ExternalRDD", "CartesianProduct"):
        assert node not in plan

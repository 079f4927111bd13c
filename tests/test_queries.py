"""Each query against its SQL twin in DuckDB."""

import math
import os

import duckdb
import pytest


from tidemark.plans import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6) if v != int(v) else int(v)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    relation = db.sql(ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    want = [dict(zip(relation.columns, r, strict=True)) for r in relation.fetchall()]
    order = lambda r: [(x is None, str(x)) for x in r]
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=order)
    assert got == sorted(([plain(r[c]) for c in columns] for r in want), key=order)


@pytest.mark.parametrize("copies", [0, 650])
def test_stored_statistics_of_other_sizes(spark, tmp_path, copies):
    """More suppliers than a sample holds, and none."""
    con, name = duckdb.connect(), "stored_statistics"
    con.sql(f"COPY (SELECT * REPLACE (CAST(s_suppkey + 10 * i AS BIGINT) AS s_suppkey) FROM '{DATA}/supplier.parquet', range({copies}) AS t(i)) TO '{tmp_path}/supplier.parquet'")
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'")
    want = sorted(con.sql(ORACLE_SQL[name]).fetchall())
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == want and len(want) == 6


def test_plans_push_down_and_prune(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = QUERIES["store_scan"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan(l_quantity,40.0)" in plan and "l_shipdate" not in plan
    assert "Exchange" not in QUERIES["type_filter_scan"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Every query of the engine against its SQL on DuckDB, over the smallest tables."""

import duckdb
import pytest

from keelson import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem", "events", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    frame = queries.queries()[name](spark, SF)
    want = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(frame.columns) == sorted(columns)
    got = sorted(tuple(r[c] for c in columns) for r in frame.collect())
    assert got == sorted(want.fetchall())


@pytest.mark.parametrize("write", ["upsert", "insert_if_absent", "update_if_present", "delete_keys"])
def test_writes_by_key_run_on_a_table_that_grows(duck, write):
    assert "orders" in queries.oracle_sql()[f"dml_{write}_orders"]
    rows, present = duck.execute("select count(*), count(*) filter (where o_orderkey * 3 in (select o_orderkey from orders)) from orders").fetchone()
    assert rows > 1000 and 0 < present < rows

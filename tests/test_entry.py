"""The driver's contract, whether or not the training-data operators are there."""

import importlib.util

import __spark_entry__
from keelson import queries


def test_queries_and_sql():
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(queries.queries()) <= set(found) and set(sql) <= set(found)
    assert set(queries.queries()) == set(queries.oracle_sql())
    if importlib.util.find_spec("keelson.llm") is None:
        assert set(found) == set(queries.queries())
    else:
        assert {n.split("_")[0] for n in found if n.startswith("op")} == {f"op{n}" for n in range(1, 11)}


def test_entry(spark):
    got = __spark_entry__.entry(spark)
    assert got.columns == ["o_orderkey", "col2", "col3"] and got.count() > 0

"""Every registered query of the engine against DuckDB, over the smallest given tables."""

import datetime
import math
import os

import duckdb
import pytest

from tessera.plans import inventory

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in inventory.TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def engine(spark):
    return inventory.engine(spark, SF)


def plain(rows):
    def value(v):
        if isinstance(v, datetime.datetime):
            v = v.date()
        return (v is None, "" if v is None else f"{float(v):.6e}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))

    return sorted(tuple(map(value, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(inventory.SQL))
def test_query(engine, con, name):
    df = engine.query(inventory.SQL[name])
    c = con.execute(inventory.ORACLES[name])
    assert [d[0] for d in c.description] == df.columns
    assert plain(df.collect()) == plain(c.fetchall())


@pytest.mark.parametrize("name", sorted(inventory.STATEMENTS))
def test_statement(spark, con, name):
    f, sql = inventory.STATEMENTS[name]
    rows = f(spark, SF).collect()
    assert rows and (sql is None or plain(rows) == plain(con.execute(sql).fetchall()))


def test_filters_and_columns_reach_the_scan(engine):
    plan = engine.query("EXPLAIN SELECT sum(l_quantity) AS s FROM lineitem WHERE l_shipdate < DATE '1997-01-01' AND l_discount > 0.05").first().explain_value
    assert "PushedFilters: [IsNotNull(l_shipdate), IsNotNull(l_discount), LessThan(l_shipdate," in plan
    assert "ReadSchema: struct<l_quantity:double,l_discount:double,l_shipdate:timestamp_ntz>" in plan


@pytest.mark.parametrize("offset", [1, 100, 5_000, 1_000_000])
def test_rows_after_an_offset_are_sorted_in_many_tasks(engine, con, offset):
    """Null keys, ties and an invisible key; no exchange brings all rows into one partition."""
    sql = f"SELECT l_orderkey, CASE WHEN l_linenumber > 1 THEN l_quantity END AS x FROM lineitem ORDER BY x DESC NULLS FIRST, l_orderkey, l_linenumber OFFSET {offset}"
    df = engine.query(sql)
    assert [tuple(r) for r in df.collect()] == con.execute(sql).fetchall()
    assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


def test_nothing_of_the_engine_needs_the_text_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['tessera.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'tpch_q01' in e.queries() and not any(n.startswith('op') for n in e.queries()); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_rounding_is_half_away_from_zero(engine):
    assert math.isclose(engine.query("SELECT round(2.675, 2) AS x").first().x, 2.68)

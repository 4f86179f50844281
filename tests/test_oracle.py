"""Every registered query against its DuckDB oracle on the smallest scale."""
import pytest

import __spark_entry__ as E
from bodega.plans.q_order_log import EDIT_WALK
from bodega.plans.registry import ORACLE, QUERIES, load_all
from check_oracle import TABLES, digest

load_all()
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "name", "sku", "total_quantity", "total_revenue", "order_count"]
    assert df.count() > 0


def test_every_query_has_oracle_or_is_listed():
    row_only = set(QUERIES) - set(ORACLE)
    assert row_only == {"order_document", *EDIT_WALK}


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in df.collect()]
    sql = E.oracle_sql().get(name) or EDIT_WALK.get(name)
    if sql is None:
        assert len(df.columns) > 0
        return
    rel = duck.sql(sql)
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(rel.columns, drows)[0]

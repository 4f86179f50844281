"""Plan shape of every registered query: no cross products, no row-at-a-time
Python, and the report window pushed into the scan."""
import contextlib
import io

import pytest

import __spark_entry__ as E

SMALL = "/root/testdata/sf0.001"


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_cross_products_or_row_udfs(spark, name):
    plan = _plan(E.queries()[name](spark, SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, f"{name}: {bad}"


def test_report_window_reaches_the_scan(spark):
    plan = _plan(E.queries()["top_products"](spark, SMALL))
    assert "GreaterThanOrEqual(o_orderdate,2001-07-02T00:00)" in plan
    line_schema = [ln for ln in plan.splitlines() if "ReadSchema: struct<l_orderkey" in ln][0]
    assert "l_shipdate" not in line_schema and "l_comment" not in line_schema
    assert "partial_sum" in plan            # map-side combining before the shuffle


def test_window_bounds_reach_the_line_scan(spark, tmp_path):
    """Lines laid out by order id: a report reads the row groups of its window only."""
    import datetime as dt

    from bodega.operators import reports
    orders = spark.range(40_000).selectExpr("id AS ID_TomaPedido", "timestamp_ntz'2001-01-01 00:00:00' + make_dt_interval(0, id) AS Fecha")
    path = str(tmp_path / "lines")
    spark.range(40_000).selectExpr("id AS ID_TomaPedido", "id % 7 AS ID_Producto").repartitionByRange(16, "ID_TomaPedido").write.parquet(path)
    lines = spark.read.parquet(path)
    recent = reports.orders_in_window(orders, dt.datetime(2001, 1, 1) + dt.timedelta(hours=40_000), 30).select("ID_TomaPedido")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # its plan node hides the scan's metrics
    try:
        df = reports.lines_near(lines, recent)
        assert len(df.collect()) == 720
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        scan = next(leaves.apply(i) for i in range(leaves.size()) if "parquet" in leaves.apply(i).toString())
        assert "Subquery" in scan.toString().split("DataFilters")[1].split("Format")[0]
        read = scan.longMetric("numOutputRows").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert 720 <= read < 8000  # of 40,000: the other files' statistics rule them out

"""Reports from daily totals for several windows, after appends, a correction and a fold."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from bodega.operators import daily, reports
from bodega.plans.q_reports import daily_store


@pytest.fixture(scope="module")
def stores(spark, fx, tmp_path_factory):
    root = daily_store(fx)
    folded = str(tmp_path_factory.mktemp("daily") / "folded")
    daily.compact(spark, root, folded, 2)
    return root, folded


@pytest.mark.parametrize("as_of,days", [(dt.datetime(2001, 8, 1), 30), (dt.datetime(1998, 3, 4, 15, 30), 400), (dt.datetime(2001, 8, 1, 7), 0.5), (dt.datetime(2030, 1, 1), 1)])
def test_any_window(fx, stores, as_of, days):
    d = fx.tables("pedidos", "detalle", "productos", "clientes", "proveedores")
    want = [reports.top_products(d, as_of, days), reports.top_providers(d, as_of, days), reports.top_clients(d, as_of, days),
            reports.top_clients_exact(d, as_of, days), reports.client_products(d, None, as_of, days)]
    for root in stores:
        got = [daily.top_products(root, d, as_of, days), daily.top_providers(root, d, as_of, days), daily.top_clients(root, d, as_of, days),
               daily.top_clients(root, d, as_of, days, exact=True), daily.client_products(root, d, None, as_of, days)]
        for g, w in zip(got, want):
            assert g.columns == w.columns
            assert g.collect() == w.collect()


def test_window_cuts_a_day_and_orders_vanish(spark, tmp_path):
    orders = spark.createDataFrame([(i, i % 2, dt.datetime(2020, 1, 1, i)) for i in range(6)] + [(9, 1, None)],
                                   "ID_TomaPedido long, ID_Cliente long, Fecha timestamp_ntz").withColumn("Total", F.lit(3).cast("decimal(18,2)"))
    lines = spark.createDataFrame([(i, 7, 1 + i) for i in (0, 1, 2, 3, 4, 5, 9)], "ID_TomaPedido long, ID_Producto long, Cantidad int").select(
        "ID_TomaPedido", "ID_Producto", F.col("Cantidad").cast("decimal(18,2)").alias("Cantidad"), F.lit(2).cast("decimal(18,2)").alias("PrecioUnitario"))
    root, d = str(tmp_path / "s"), {"pedidos": orders, "detalle": lines}
    daily.append_days(root, 1, (orders, lines))
    rows = lambda moment: [(r.ID_Producto, int(r.q), r.orders) for r in daily.window_totals(root, "product_day", d, moment, 1).collect()]
    assert rows(dt.datetime(2020, 1, 2)) == [(7, 21, 6)]
    assert rows(dt.datetime(2020, 1, 2, 4)) == [(7, 11, 2)]
    assert rows(dt.datetime(2020, 1, 3)) == []
    daily.append_days(root, 2, (orders.limit(0), lines), (orders, lines))
    daily.append_days(root, 2, (orders.limit(0), lines), (orders, lines))
    assert rows(dt.datetime(2020, 1, 2)) == []


def test_a_batch_is_joined_once_and_dealt_by_its_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(daily, "TASK_ROWS", 4)
    calls, per_order = [], daily._per_order
    monkeypatch.setattr(daily, "_per_order", lambda *a: calls.append(a) or per_order(*a))
    orders = spark.range(80).selectExpr("id AS ID_TomaPedido", "id AS ID_Cliente", "TIMESTAMP_NTZ'2020-01-01 00:00:00' AS Fecha", "CAST(3 AS DECIMAL(18,2)) AS Total")
    lines = spark.range(80).selectExpr("id AS ID_TomaPedido", "id AS ID_Producto", "CAST(1 AS DECIMAL(18,2)) AS Cantidad", "CAST(2 AS DECIMAL(18,2)) AS PrecioUnitario")
    daily.append_days(str(tmp_path / "s"), 1, (orders, lines))
    assert len(calls) == 1
    for name in daily.KEYS:
        assert len(list((tmp_path / "s" / name / "batch=1").glob("*.parquet"))) > int(spark.conf.get("spark.sql.shuffle.partitions"))

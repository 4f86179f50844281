"""Sales reports over a moving window.

Plan shape, at any scale: the date predicate goes to the order scan (it
reaches Parquet as a pushed filter), the window's smallest and largest order id
go to the line scan the same way, lines are semi-joined to the orders of
the window, aggregated per key with map-side partial aggregation (so a hot
product or client is combined before the shuffle), and only then joined to
the dimension for its names: one row per key crosses that join, not one
per line. Join strategies are left to the planner: AQE turns a join into a
broadcast only when the side it measured at run time is under the
broadcast threshold.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bodega.functions.exprs import DEFAULT_REPORT_DAYS, full_name, out_double, shift_days


def orders_in_window(pedidos: DataFrame, as_of: dt.datetime, days: int = DEFAULT_REPORT_DAYS) -> DataFrame:
    """``Fecha >= as_of - days``, inclusive, no upper bound (future orders count)."""
    return pedidos.where(F.col("Fecha") >= shift_days(as_of, -days))


def lines_near(detalle: DataFrame, recent: DataFrame) -> DataFrame:
    """The lines whose order id lies between the smallest and largest of ``recent``: two
    scalar subqueries, whose values reach the line scan as pushed filters. Where ids
    rise with time, as identities do, a window reads its own files and row groups only;
    the exact join to ``recent`` still follows.

    Written as sorted limits: Spark would merge a minimum and a maximum into one
    subquery of two fields, and a field of a subquery is not pushed."""
    key, ids = F.col("ID_TomaPedido"), recent.select("ID_TomaPedido")
    return detalle.where((key >= ids.orderBy("ID_TomaPedido").limit(1).scalar()) & (key <= ids.orderBy(F.desc("ID_TomaPedido")).limit(1).scalar()))


def _lines_in_window(d: dict, as_of, days) -> DataFrame:
    recent = orders_in_window(d["pedidos"], as_of, days).select("ID_TomaPedido")
    return lines_near(d["detalle"], recent).join(recent, "ID_TomaPedido", "left_semi")


def _top(df: DataFrame, by: str, key: str, n: int | None) -> DataFrame:
    ordered = df.orderBy(F.col(by).desc(), F.col(key))
    return ordered.limit(n) if n else ordered


def top_products(d: dict, as_of, days: int = DEFAULT_REPORT_DAYS, n: int | None = None) -> DataFrame:
    """Per product, quantity, revenue and distinct orders in the window."""
    lines = _lines_in_window(d, as_of, days)
    per_order = (lines.groupBy("ID_Producto", "ID_TomaPedido")
                 .agg(F.sum("Cantidad").alias("q"), F.sum(F.col("Cantidad") * F.col("PrecioUnitario")).alias("a")))
    per_product = per_order.groupBy("ID_Producto").agg(
        F.sum("q").alias("q"), F.sum("a").alias("a"), F.count(F.lit(1)).alias("order_count"))
    return named_products(per_product, d, n)


def named_products(per_product: DataFrame, d: dict, n: int | None) -> DataFrame:
    """R1's rows from its totals (ID_Producto, q, a, order_count)."""
    prod = d["productos"].select("ID_Producto", "Descripcion", "Pr_Ean13")
    out = per_product.join(prod, "ID_Producto").select(
        F.col("ID_Producto").alias("id"),
        F.col("Descripcion").alias("name"),
        F.col("Pr_Ean13").alias("sku"),
        out_double(F.col("q")).alias("total_quantity"),
        out_double(F.col("a")).alias("total_revenue"),
        F.col("order_count"),
    )
    return _top(out, "total_quantity", "id", n)


def top_providers(d: dict, as_of, days: int = DEFAULT_REPORT_DAYS, n: int | None = None) -> DataFrame:
    """R2: per provider, distinct products sold, amount and quantity.

    The reference groups by a column name that does not exist; this builds
    the evident intent, grouping by the selected provider columns."""
    lines = _lines_in_window(d, as_of, days)
    per_product = lines.groupBy("ID_Producto").agg(
        F.sum(F.col("Cantidad") * F.col("PrecioUnitario")).alias("a"), F.sum("Cantidad").alias("q"))
    return named_providers(per_product, d, n)


def named_providers(per_product: DataFrame, d: dict, n: int | None) -> DataFrame:
    """R2's rows from totals per product (ID_Producto, q, a)."""
    prod = d["productos"].select("ID_Producto", "ID_Proveedor")
    per_provider = per_product.join(prod, "ID_Producto").groupBy("ID_Proveedor").agg(
        F.count(F.lit(1)).alias("product_count"), F.sum("a").alias("a"), F.sum("q").alias("q"))
    prov = d["proveedores"].select("ID_Proveedor", "RazonSocial", "Contacto", "Telefono")
    out = per_provider.join(prov, "ID_Proveedor").select(
        F.col("ID_Proveedor").alias("id"),
        F.col("RazonSocial").alias("name"),
        F.col("Contacto").alias("contact"),
        F.col("Telefono").alias("phone"),
        F.col("product_count"),
        out_double(F.col("a")).alias("total_amount"),
        out_double(F.col("q")).alias("total_items"),
    )
    return _top(out, "total_amount", "id", n)


def _client_report(d: dict, as_of, days, n, exact: bool) -> DataFrame:
    recent = orders_in_window(d["pedidos"], as_of, days).select("ID_TomaPedido", "ID_Cliente", "Total")
    lines = lines_near(d["detalle"], recent).join(recent.select("ID_TomaPedido"), "ID_TomaPedido", "left_semi")
    per_order_lines = lines.groupBy("ID_TomaPedido").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("Cantidad").alias("q"))
    # inner join: orders without lines drop out, as in the reference
    per_order = recent.join(per_order_lines, "ID_TomaPedido")
    total = F.col("Total") if exact else F.col("Total") * F.col("n_lines")
    per_client = per_order.groupBy("ID_Cliente").agg(
        F.count(F.lit(1)).alias("order_count"), F.sum(total).alias("t"), F.sum("q").alias("q"))
    return named_clients(per_client, d, n)


def named_clients(per_client: DataFrame, d: dict, n: int | None) -> DataFrame:
    """R3's rows from its totals (ID_Cliente, order_count, t, q)."""
    cli = d["clientes"].select("ID_Cliente", "Nombre", "Apellido", "Telefono", "correo")
    out = per_client.join(cli, "ID_Cliente").select(
        F.col("ID_Cliente").alias("id"),
        full_name(F.col("Nombre"), F.col("Apellido")).alias("name"),
        F.col("Telefono").alias("phone"),
        F.col("correo").alias("email"),
        F.col("order_count"),
        out_double(F.col("t")).alias("total_amount"),
        out_double(F.col("q")).alias("total_items"),
    )
    return _top(out, "total_amount", "id", n)


def top_clients(d: dict, as_of, days: int = DEFAULT_REPORT_DAYS, n: int | None = None) -> DataFrame:
    """Per client, as the reference computes it: each order's header total
    counts once per line of the order (the join fans it out)."""
    return _client_report(d, as_of, days, n, exact=False)


def top_clients_exact(d: dict, as_of, days: int = DEFAULT_REPORT_DAYS, n: int | None = None) -> DataFrame:
    """The same report with each order's total counted once."""
    return _client_report(d, as_of, days, n, exact=True)


def client_products(d: dict, client_ids: DataFrame | None, as_of, days: int = DEFAULT_REPORT_DAYS) -> DataFrame:
    """Products bought in the window, per client of ``client_ids``
    (a one-column DataFrame of ``ID_Cliente``; None means every client)."""
    recent = orders_in_window(d["pedidos"], as_of, days).select("ID_TomaPedido", "ID_Cliente")
    if client_ids is not None:
        recent = recent.join(client_ids.select("ID_Cliente"), "ID_Cliente", "left_semi")
    lines = lines_near(d["detalle"], recent).join(recent, "ID_TomaPedido")
    per = lines.groupBy("ID_Cliente", "ID_Producto").agg(
        F.sum("Cantidad").alias("q"), F.sum(F.col("Cantidad") * F.col("PrecioUnitario")).alias("a"))
    return named_client_products(per, d)


def named_client_products(per: DataFrame, d: dict) -> DataFrame:
    """R4's rows from its totals (ID_Cliente, ID_Producto, q, a)."""
    prod = d["productos"].select("ID_Producto", "Descripcion", "Pr_Ean13")
    out = per.join(prod, "ID_Producto").select(
        F.col("ID_Cliente").alias("client_id"),
        F.col("ID_Producto").alias("id"),
        F.col("Descripcion").alias("name"),
        F.col("Pr_Ean13").alias("sku"),
        out_double(F.col("q")).alias("total_quantity"),
        out_double(F.col("a")).alias("total_spent"),
    )
    return out.orderBy("client_id", F.col("total_quantity").desc(), "id")

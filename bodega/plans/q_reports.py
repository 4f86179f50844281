"""Registered report queries."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bodega.operators import daily, reports
from bodega.plans import oracle_reports as S
from bodega.plans.registry import register
from bodega.session import ensure_checkpoint_dir

REPORT_TABLES = ("pedidos", "detalle", "productos", "proveedores", "clientes")


def _d(fx, *names):
    return fx.tables(*names)


@register("top_products", S.TOP_PRODUCTS)
def top_products(fx):
    return reports.top_products(_d(fx, "pedidos", "detalle", "productos"), fx.as_of)


@register("top_providers", S.TOP_PROVIDERS)
def top_providers(fx):
    return reports.top_providers(_d(fx, "pedidos", "detalle", "productos", "proveedores"), fx.as_of)


@register("top_clients", S.TOP_CLIENTS)
def top_clients(fx):
    return reports.top_clients(_d(fx, "pedidos", "detalle", "clientes"), fx.as_of)


@register("top_clients_exact", S.TOP_CLIENTS_EXACT)
def top_clients_exact(fx):
    return reports.top_clients_exact(_d(fx, "pedidos", "detalle", "clientes"), fx.as_of)


@register("client_products", S.CLIENT_PRODUCTS)
def client_products(fx):
    d = _d(fx, "pedidos", "detalle", "productos", "clientes")
    return reports.client_products(d, d["clientes"].select("ID_Cliente"), fx.as_of)


@register("top_products_top10", S.TOP_PRODUCTS.replace("ORDER BY total_quantity DESC, id",
                                                        "ORDER BY total_quantity DESC, id LIMIT 10"))
def top_products_top10(fx):
    """R1 with a row limit: the ten best sellers (ties broken by id)."""
    return reports.top_products(_d(fx, "pedidos", "detalle", "productos"), fx.as_of, n=10)


@register("top_clients_top10", S.TOP_CLIENTS.replace("ORDER BY total_amount DESC, id",
                                                      "ORDER BY total_amount DESC, id LIMIT 10"))
def top_clients_top10(fx):
    return reports.top_clients(_d(fx, "pedidos", "detalle", "clientes"), fx.as_of, n=10)


# ---- the same reports from daily totals -------------------------------------------
def daily_store(fx) -> str:
    """A store of daily totals that orders reached in three batches (each with orders of
    every day, so the later ones are back-dated); those of the first came with doubled
    quantities and are put right by a fourth."""
    root = f"{ensure_checkpoint_dir(fx.spark).rstrip('/')}/bodega-daily/{uuid.uuid4().hex}"
    for batch in range(3):
        mine = F.col("ID_TomaPedido") % 3 == batch
        lines = fx.detalle.where(mine)
        if batch == 0:
            lines = lines.withColumn("Cantidad", F.col("Cantidad") * 2)
        daily.append_days(root, batch + 1, (fx.pedidos.where(mine), lines))
    wrong = F.col("ID_TomaPedido") % 3 == 0
    orders, lines = fx.pedidos.where(wrong), fx.detalle.where(wrong)
    daily.append_days(root, 4, (orders, lines), (orders, lines.withColumn("Cantidad", F.col("Cantidad") * 2)))
    return root


@register("top_products_daily", S.TOP_PRODUCTS)
def top_products_daily(fx):
    return daily.top_products(daily_store(fx), _d(fx, "pedidos", "detalle", "productos"), fx.as_of)


@register("top_providers_daily", S.TOP_PROVIDERS)
def top_providers_daily(fx):
    return daily.top_providers(daily_store(fx), _d(fx, "pedidos", "detalle", "productos", "proveedores"), fx.as_of)


@register("top_clients_daily", S.TOP_CLIENTS)
def top_clients_daily(fx):
    return daily.top_clients(daily_store(fx), _d(fx, "pedidos", "detalle", "clientes"), fx.as_of)


@register("top_clients_exact_daily", S.TOP_CLIENTS_EXACT)
def top_clients_exact_daily(fx):
    return daily.top_clients(daily_store(fx), _d(fx, "pedidos", "detalle", "clientes"), fx.as_of, exact=True)


@register("client_products_daily", S.CLIENT_PRODUCTS)
def client_products_daily(fx):
    d = _d(fx, "pedidos", "detalle", "productos", "clientes")
    return daily.client_products(daily_store(fx), d, d["clientes"].select("ID_Cliente"), fx.as_of)

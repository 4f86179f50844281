"""DuckDB oracle text for the reports: the orders of the window first, their lines
summed per key next, names last."""
from __future__ import annotations

from bodega.plans.fixture_sql import AS_OF_SQL, with_tables

RECENT = ("recent", f"""SELECT ID_TomaPedido AS order_id, ID_Cliente AS client, Total AS order_total
FROM pedidos WHERE Fecha >= {AS_OF_SQL} - INTERVAL 30 DAY""")

SOLD = ("sold", """SELECT recent.order_id, recent.client, ID_Producto AS product, Cantidad AS qty,
  Cantidad * PrecioUnitario AS amount
FROM recent JOIN detalle ON detalle.ID_TomaPedido = recent.order_id""")

PER_PRODUCT = ("per_product", """SELECT product, sum(qty) AS qty, sum(amount) AS amount,
  count(DISTINCT order_id) AS orders
FROM sold GROUP BY product""")

PER_PROVIDER = ("per_provider", """SELECT ID_Proveedor AS provider, count(*) AS products, sum(amount) AS amount, sum(qty) AS qty
FROM per_product JOIN productos ON ID_Producto = product GROUP BY provider""")

# An order's total counts once per line of it in top_clients, once in top_clients_exact.
PER_ORDER = ("per_order", """SELECT client, order_total, qty, n_lines
FROM recent JOIN (SELECT order_id, sum(qty) AS qty, count(*) AS n_lines FROM sold GROUP BY order_id) USING (order_id)""")


def _client_report(order_amount: str) -> str:
    per_client = ("per_client", f"""SELECT client, count(*) AS orders, sum({order_amount}) AS amount, sum(qty) AS qty
FROM per_order GROUP BY client""")
    return with_tables("""
SELECT client AS id, Nombre || ' ' || coalesce(Apellido, '') AS name, Telefono AS phone, correo AS email, orders AS order_count,
  CAST(amount AS DOUBLE) AS total_amount, CAST(qty AS DOUBLE) AS total_items
FROM per_client JOIN clientes ON clientes.ID_Cliente = client
ORDER BY total_amount DESC, id""", "clientes", "pedidos", "detalle", extra=[RECENT, SOLD, PER_ORDER, per_client])


TOP_PRODUCTS = with_tables("""
SELECT product AS id, Descripcion AS name, Pr_Ean13 AS sku, CAST(qty AS DOUBLE) AS total_quantity,
  CAST(amount AS DOUBLE) AS total_revenue, orders AS order_count
FROM per_product JOIN productos ON ID_Producto = product
ORDER BY total_quantity DESC, id""", "productos", "detalle", "pedidos", extra=[RECENT, SOLD, PER_PRODUCT])

TOP_PROVIDERS = with_tables("""
SELECT provider AS id, RazonSocial AS name, Contacto AS contact, Telefono AS phone, products AS product_count,
  CAST(amount AS DOUBLE) AS total_amount, CAST(qty AS DOUBLE) AS total_items
FROM per_provider JOIN proveedores ON proveedores.ID_Proveedor = provider
ORDER BY total_amount DESC, id""", "proveedores", "productos", "detalle", "pedidos",
                           extra=[RECENT, SOLD, PER_PRODUCT, PER_PROVIDER])

TOP_CLIENTS = _client_report("order_total * n_lines")
TOP_CLIENTS_EXACT = _client_report("order_total")

CLIENT_PRODUCTS = with_tables("""
SELECT client AS client_id, product AS id, Descripcion AS name, Pr_Ean13 AS sku, CAST(qty AS DOUBLE) AS total_quantity,
  CAST(amount AS DOUBLE) AS total_spent
FROM bought JOIN productos ON ID_Producto = product SEMI JOIN clientes ON clientes.ID_Cliente = client
ORDER BY client_id, total_quantity DESC, id""", "productos", "detalle", "pedidos", "clientes",
                             extra=[RECENT, SOLD, ("bought", """SELECT client, product, sum(qty) AS qty, sum(amount) AS amount
FROM sold GROUP BY client, product""")])

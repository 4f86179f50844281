"""Registered order-posting queries (P1-P8) over the derived order requests."""
from __future__ import annotations

from pyspark.sql import functions as F

from bodega.operators import posting as P
from bodega.operators.stock import walk_stock
from bodega.operators.listings import decimals_to_double
from bodega.plans.fixture_sql import AS_OF_SQL, with_tables
from bodega.plans.registry import register

REQ = ("request_headers", "request_items", "productos", "clientes", "repartidores")

# The validation / pricing / decision chain in DuckDB (opening stock, per line).
CHAIN = [
    ("cnt", "SELECT request_id, count(*) AS n_items FROM request_items GROUP BY request_id"),
    ("v", """SELECT h.*, coalesce(c.n_items, 0) AS n_items,
  CASE WHEN count(*) OVER (PARTITION BY h.request_id) > 1 THEN 'duplicate_request'
       WHEN h.client_id IS NULL OR h.client_id = 0 OR coalesce(c.n_items, 0) = 0 THEN 'missing_data'
       WHEN h.delivery_type = 'por reparto' AND (h.repartidor_id IS NULL OR h.repartidor_id = 0) THEN 'missing_driver'
       WHEN coalesce(c.n_items, 0) > 99 THEN 'too_many_items' END AS reject_reason,
  CASE WHEN h.client_id NOT IN (SELECT ID_Cliente FROM clientes) THEN 'unknown_client'
       WHEN h.repartidor_id <> 0 AND h.repartidor_id NOT IN (SELECT ID_Repartidor FROM repartidores) THEN 'unknown_driver'
  END AS late_reason
FROM request_headers h LEFT JOIN cnt c ON h.request_id = c.request_id"""),
    ("pl", """SELECT i.request_id, i.pos, i.product_id, i.quantity,
  CASE WHEN i.unit_price IS NULL OR i.unit_price = 0 THEN CAST(p.PrecioFinalUni AS DECIMAL(18,2))
       ELSE i.unit_price END AS unit_price,
  p.Stock AS stock_open, p.ID_Producto IS NOT NULL AS found
FROM request_items i LEFT JOIN productos p ON i.product_id = p.ID_Producto"""),
    ("lines", """SELECT *, CAST(unit_price * quantity AS DECIMAL(18,4)) AS amount,
  CAST(unit_price * quantity AS DECIMAL(18,4)) * 0.21 AS vat, printf('%02d', pos) AS Item,
  (quantity IS NULL OR unit_price IS NULL) AS bad_number, quantity AS need FROM pl"""),
    ("fails", """SELECT *, CASE WHEN NOT found THEN 'unknown_product' WHEN coalesce(stock_open, 0) < need THEN 'insufficient_stock' END
  AS fail FROM lines"""),
    ("per", """SELECT request_id, arg_min(fail, pos) FILTER (WHERE fail IS NOT NULL) AS line_reason,
  max(CAST(bad_number AS INTEGER)) AS bad, sum(amount) AS total FROM fails GROUP BY request_id"""),
    ("dec", """SELECT v.*, per.total,
  coalesce(v.reject_reason, per.line_reason, v.late_reason, CASE WHEN per.bad = 1 THEN 'bad_number' END) AS reason
FROM v LEFT JOIN per ON v.request_id = per.request_id"""),
    ("acc", "SELECT * FROM dec WHERE reason IS NULL"),
    ("ids", """SELECT (SELECT max(ID_TomaPedido) FROM pedidos) + row_number() OVER (ORDER BY request_id) AS ID_TomaPedido,
  * FROM acc"""),
    ("moves", """SELECT product_id, sum(ceil(quantity)) AS t FROM lines
WHERE request_id IN (SELECT request_id FROM acc) GROUP BY product_id"""),
]


def _chain_sql(body: str, upto: str, *tables: str) -> str:
    names = [n for n, _ in CHAIN]
    extra = CHAIN[:names.index(upto) + 1]
    return with_tables(body, *REQ, *tables, extra=extra)


def _parties(fx):
    return fx.tables("clientes", "repartidores")


def _fx_tables(fx):
    return fx.tables("productos", "pedidos", "detalle", "clientes", "repartidores")


@register("validate_requests", _chain_sql("SELECT request_id, n_items, reject_reason FROM v", "v"))
def validate_requests(fx):
    v = P.validate_requests(fx.request_headers, fx.request_items)
    return v.select("request_id", "n_items", "reject_reason")


@register("price_lines", _chain_sql("""
SELECT request_id, pos, product_id, CAST(quantity AS DOUBLE) AS quantity, CAST(unit_price AS DOUBLE) AS unit_price,
  CAST(amount AS DOUBLE) AS amount, CAST(vat AS DOUBLE) AS vat, Item, found, bad_number FROM lines""", "lines"))
def price_lines(fx):
    return decimals_to_double(P.price_lines(fx.request_items, fx.productos).drop("stock_open"))


@register("check_stock", _chain_sql(
    "SELECT request_id, reason IS NULL AS accepted, reason FROM dec", "dec"))
def check_stock(fx):
    dec = P.check_stock(fx.request_headers, fx.request_items, fx.productos, parties=_parties(fx))
    return dec.select("request_id", "accepted", "reason")


@register("order_totals", _chain_sql(
    "SELECT request_id, CAST(sum(amount) AS DOUBLE) AS total FROM lines GROUP BY request_id", "lines"))
def order_totals(fx):
    return decimals_to_double(P.order_totals(P.price_lines(fx.request_items, fx.productos)))


@register("stock_movements", _chain_sql(
    "SELECT product_id, CAST(-t AS BIGINT) AS delta FROM moves", "moves", "pedidos"))
def stock_movements(fx):
    dec = P.check_stock(fx.request_headers, fx.request_items, fx.productos, parties=_parties(fx))
    acc = dec.where(F.col("accepted")).select("request_id")
    lines = P.price_lines(fx.request_items, fx.productos).join(acc, "request_id", "left_semi")
    return P.stock_movements(lines)


# ---- P6 (opening stock: SQL oracle) -----------------------------------------
ORDERS_OUT = f"""SELECT ID_TomaPedido, request_id, 'A' AS Letra, 1 AS ID_Comprobante, client_id AS ID_Cliente,
  {AS_OF_SQL} AS Fecha, coalesce(delivery_date, {AS_OF_SQL} + INTERVAL 7 DAY) AS FechaEntrega,
  CAST(0 AS DOUBLE) AS Dto, CAST(total AS DOUBLE) AS Total, CAST(total AS DOUBLE) AS Apagar,
  CAST(0 AS DOUBLE) AS CtaCte, 'Pendiente' AS Estado,
  CAST(CASE WHEN delivery_type = 'deposito' THEN 1 ELSE 0 END AS SMALLINT) AS bDeposito,
  CASE WHEN repartidor_id IS NULL OR repartidor_id = 0 THEN NULL ELSE repartidor_id END AS ID_Repartidor
FROM ids"""

LINES_OUT = """SELECT ids.ID_TomaPedido, l.request_id, l.product_id AS ID_Producto, CAST(l.vat AS DOUBLE) AS IVA,
  CAST(l.unit_price AS DOUBLE) AS PrecioUnitario, CAST(l.quantity AS DOUBLE) AS Cantidad,
  CAST(0 AS DOUBLE) AS RestoIVA, CAST(0 AS DOUBLE) AS Dto, CAST(l.amount AS DOUBLE) AS ImporteconDto, l.Item
FROM lines l JOIN ids ON l.request_id = ids.request_id"""

STOCK_OUT = """SELECT p.ID_Producto, CAST(p.Stock - coalesce(m.t, 0) AS INTEGER) AS Stock
FROM productos p LEFT JOIN moves m ON p.ID_Producto = m.product_id"""


def _post(fx, mode):
    return P.post_orders(_fx_tables(fx), fx.request_headers, fx.request_items, fx.as_of, mode=mode)


@register("post_orders", _chain_sql(ORDERS_OUT, "ids", "pedidos"))
def post_orders(fx):
    return decimals_to_double(_post(fx, "opening_stock")["orders"])


@register("post_orders_lines", _chain_sql(LINES_OUT, "ids", "pedidos"))
def post_orders_lines(fx):
    return decimals_to_double(_post(fx, "opening_stock")["lines"])


@register("post_orders_stock", _chain_sql(STOCK_OUT, "moves", "pedidos"))
def post_orders_stock(fx):
    return _post(fx, "opening_stock")["products"].select("ID_Producto", "Stock")


@register("post_orders_rejects", _chain_sql("SELECT request_id, reason FROM dec WHERE reason IS NOT NULL", "dec"))
def post_orders_rejects(fx):
    return _post(fx, "opening_stock")["rejects"]


# ---- P6 sequential -------------------------------------------------------------
# The oracle walks the requests one by one in a recursive query, carrying a map
# product -> stock taken so far: the reference's own order of events, written
# independently of the Spark rounds (one step per request, so it suits the
# small check scales; the Spark side is also tested against a Python walk).
SEQ_CHAIN = CHAIN[:4] + [
    ("sl", """SELECT request_id,
  list({'pos': pos, 'product_id': product_id, 'found': found, 'q': quantity, 'stock_open': stock_open}
       ORDER BY pos) AS lines,
  bool_or(bad_number) AS bad, sum(amount) AS total
FROM lines GROUP BY request_id"""),
    ("sp", """SELECT request_id, list({'product_id': product_id, 'take': take}) AS per
FROM (SELECT request_id, product_id, CAST(sum(ceil(quantity)) AS BIGINT) AS take FROM lines
      WHERE found AND quantity IS NOT NULL GROUP BY request_id, product_id)
GROUP BY request_id"""),
    ("seqreq", """SELECT row_number() OVER (ORDER BY v.request_id) AS i, v.request_id, v.reject_reason, v.late_reason,
  sl.lines, sl.bad, sl.total, sp.per
FROM v LEFT JOIN sl ON v.request_id = sl.request_id LEFT JOIN sp ON v.request_id = sp.request_id"""),
    ("walk", """SELECT 0 AS i, MAP {}::MAP(BIGINT, BIGINT) AS m, CAST(NULL AS BIGINT) AS request_id,
  CAST(NULL AS VARCHAR) AS reason
UNION ALL
SELECT x.i,
  CASE WHEN x.reason IS NULL THEN map_concat(x.m, map_from_entries(list_transform(x.per,
         lambda e: {'key': e.product_id, 'value': coalesce(x.m[e.product_id], 0) + e.take})))
       ELSE x.m END,
  x.request_id, x.reason
FROM (
  SELECT s.i, w.m, s.request_id, s.per,
    coalesce(s.reject_reason,
      CASE WHEN NOT list_filter(s.lines, lambda l: NOT l.found OR
                  (l.q IS NOT NULL AND coalesce(l.stock_open, 0) - coalesce(w.m[l.product_id], 0) < l.q))[1].found
           THEN 'unknown_product'
           WHEN list_filter(s.lines, lambda l: NOT l.found OR
                  (l.q IS NOT NULL AND coalesce(l.stock_open, 0) - coalesce(w.m[l.product_id], 0) < l.q))[1].found
           THEN 'insufficient_stock' END,
      s.late_reason, CASE WHEN s.bad THEN 'bad_number' END) AS reason
  FROM walk w JOIN seqreq s ON s.i = w.i + 1
) x"""),
    ("acc", """SELECT v.*, s.total FROM v JOIN walk w ON v.request_id = w.request_id AND w.reason IS NULL
JOIN seqreq s ON v.request_id = s.request_id"""),
    ("ids", """SELECT (SELECT max(ID_TomaPedido) FROM pedidos) + row_number() OVER (ORDER BY request_id) AS ID_TomaPedido,
  * FROM acc"""),
    # (walk is read through a join: filtering it directly is much slower in DuckDB)
    ("taken", "SELECT w.m FROM walk w JOIN (SELECT max(i) AS i FROM seqreq) z ON w.i = z.i"),
]


def _seq_sql(body: str) -> str:
    return "WITH RECURSIVE" + with_tables(body, *REQ, "pedidos", extra=SEQ_CHAIN)[len("WITH"):]


@register("post_orders_sequential", _seq_sql(ORDERS_OUT))
def post_orders_sequential(fx):
    return decimals_to_double(_post(fx, "sequential")["orders"])


@register("post_orders_sequential_stock", _seq_sql("""
SELECT p.ID_Producto, CAST(p.Stock - coalesce((SELECT m FROM taken)[p.ID_Producto], 0) AS INTEGER) AS Stock
FROM productos p"""))
def post_orders_sequential_stock(fx):
    return _post(fx, "sequential")["products"].select("ID_Producto", "Stock")


@register("post_orders_sequential_rejects", _seq_sql(
    "SELECT w.request_id, w.reason FROM walk w JOIN seqreq s ON w.i = s.i "
    "AND w.reason IS NOT NULL"))
def post_orders_sequential_rejects(fx):
    return _post(fx, "sequential")["rejects"]


# ---- P7 ----------------------------------------------------------------------
EDIT_CHAIN = [
    ("latest", "SELECT order_id, max(request_id) AS request_id FROM edit_headers WHERE order_id IS NOT NULL "
               "GROUP BY order_id"),
    ("eh", "SELECT h.* FROM edit_headers h JOIN latest l ON h.order_id = l.order_id AND h.request_id = l.request_id"),
    ("ei", "SELECT * FROM edit_items WHERE request_id IN (SELECT request_id FROM eh)"),
    ("cnt", "SELECT request_id, count(*) AS n_items FROM ei GROUP BY request_id"),
    ("v", """SELECT h.*, coalesce(c.n_items, 0) AS n_items,
  CASE WHEN count(*) OVER (PARTITION BY h.request_id) > 1 THEN 'duplicate_request'
       WHEN h.client_id IS NULL OR h.client_id = 0 OR coalesce(c.n_items, 0) = 0 THEN 'missing_data'
       WHEN h.delivery_type = 'por reparto' AND (h.repartidor_id IS NULL OR h.repartidor_id = 0) THEN 'missing_driver'
       WHEN coalesce(c.n_items, 0) > 99 THEN 'too_many_items' END AS reject_reason,
  CASE WHEN h.order_id NOT IN (SELECT ID_TomaPedido FROM pedidos) THEN 'not_found'
       WHEN h.client_id NOT IN (SELECT ID_Cliente FROM clientes) THEN 'unknown_client'
       WHEN h.repartidor_id <> 0 AND h.repartidor_id NOT IN (SELECT ID_Repartidor FROM repartidores) THEN 'unknown_driver'
  END AS late_reason
FROM eh h LEFT JOIN cnt c ON h.request_id = c.request_id"""),
    ("back", """SELECT h.request_id, d.ID_Producto AS product_id, sum(floor(d.Cantidad)) AS back
FROM detalle d JOIN eh h ON d.ID_TomaPedido = h.order_id GROUP BY h.request_id, d.ID_Producto"""),
    ("pl", """SELECT i.request_id, i.pos, i.product_id, i.quantity,
  CASE WHEN i.unit_price IS NULL OR i.unit_price = 0 THEN CAST(p.PrecioFinalUni AS DECIMAL(18,2))
       ELSE i.unit_price END AS unit_price,
  p.Stock AS stock_open, p.ID_Producto IS NOT NULL AS found
FROM ei i LEFT JOIN productos p ON i.product_id = p.ID_Producto"""),
    ("lines", """SELECT pl.*, CAST(unit_price * quantity AS DECIMAL(18,4)) AS amount, quantity AS need,
  (quantity IS NULL OR unit_price IS NULL) AS bad_number, coalesce(b.back, 0) AS back
FROM pl LEFT JOIN back b ON pl.request_id = b.request_id AND pl.product_id = b.product_id"""),
    ("fails", """SELECT *, CASE WHEN NOT found THEN 'unknown_product'
  WHEN coalesce(stock_open, 0) + back < need THEN 'insufficient_stock' END AS fail FROM lines"""),
    ("per", """SELECT request_id, arg_min(fail, pos) FILTER (WHERE fail IS NOT NULL) AS line_reason,
  max(CAST(bad_number AS INTEGER)) AS bad, sum(amount) AS total FROM fails GROUP BY request_id"""),
    ("dec", """SELECT v.*, per.total,
  coalesce(v.reject_reason, per.line_reason, v.late_reason, CASE WHEN per.bad = 1 THEN 'bad_number' END) AS reason
FROM v LEFT JOIN per ON v.request_id = per.request_id"""),
    ("acc", "SELECT * FROM dec WHERE reason IS NULL"),
    ("gave", "SELECT product_id, sum(back) AS b FROM back WHERE request_id IN (SELECT request_id FROM acc) "
             "GROUP BY product_id"),
    ("took", "SELECT product_id, sum(ceil(quantity)) AS t FROM lines WHERE request_id IN (SELECT request_id FROM acc) "
             "GROUP BY product_id"),
]
EDIT_TABLES = ("edit_headers", "edit_items", "productos", "pedidos", "detalle", "clientes", "repartidores")


def _edit(fx):
    return P.replace_orders(_fx_tables(fx), fx.edit_headers, fx.edit_items, fx.as_of, mode="opening_stock")


@register("replace_orders", with_tables(f"""
SELECT o.ID_TomaPedido,
  CASE WHEN a.order_id IS NOT NULL THEN a.client_id ELSE o.ID_Cliente END AS ID_Cliente,
  o.Fecha,
  CASE WHEN a.order_id IS NOT NULL THEN coalesce(a.delivery_date, {AS_OF_SQL} + INTERVAL 7 DAY)
       ELSE o.FechaEntrega END AS FechaEntrega,
  o.ID_Condicion,
  CAST(CASE WHEN a.order_id IS NOT NULL THEN CAST(a.total AS DECIMAL(18,2)) ELSE o.Total END AS DOUBLE) AS Total,
  CAST(CASE WHEN a.order_id IS NOT NULL THEN CAST(a.total AS DECIMAL(18,2)) ELSE o.Apagar END AS DOUBLE) AS Apagar,
  CAST(o.Dto AS DOUBLE) AS Dto, CAST(o.CtaCte AS DOUBLE) AS CtaCte, o.Estado, o.Observaciones,
  CASE WHEN a.order_id IS NOT NULL THEN CAST(CASE WHEN a.delivery_type = 'deposito' THEN 1 ELSE 0 END AS SMALLINT)
       ELSE o.bDeposito END AS bDeposito,
  CASE WHEN a.order_id IS NOT NULL THEN
         CASE WHEN a.repartidor_id IS NULL OR a.repartidor_id = 0 THEN NULL ELSE a.repartidor_id END
       ELSE o.ID_Repartidor END AS ID_Repartidor,
  o.Letra, o.ID_Comprobante, o.ID_Empleado, o.PorcentajeDto
FROM pedidos o LEFT JOIN acc a ON o.ID_TomaPedido = a.order_id""", *EDIT_TABLES, extra=EDIT_CHAIN))
def replace_orders(fx):
    return decimals_to_double(_edit(fx)["orders"])


@register("replace_orders_stock", with_tables("""
SELECT p.ID_Producto, CAST(p.Stock + coalesce(g.b, 0) - coalesce(t.t, 0) AS INTEGER) AS Stock
FROM productos p LEFT JOIN gave g ON p.ID_Producto = g.product_id LEFT JOIN took t ON p.ID_Producto = t.product_id""",
    *EDIT_TABLES, extra=EDIT_CHAIN))
def replace_orders_stock(fx):
    return _edit(fx)["products"].select("ID_Producto", "Stock")


@register("replace_orders_lines", with_tables("""
SELECT ID_TomaPedido, ID_Producto, CAST(Cantidad AS DOUBLE) AS Cantidad, CAST(PrecioUnitario AS DOUBLE) AS PrecioUnitario,
  CAST(ImporteconDto AS DOUBLE) AS ImporteconDto, CAST(IVA AS DOUBLE) AS IVA, false AS added
FROM detalle ANTI JOIN (SELECT order_id AS ID_TomaPedido FROM acc) USING (ID_TomaPedido)
UNION ALL
SELECT order_id, product_id, CAST(quantity AS DOUBLE), CAST(unit_price AS DOUBLE), CAST(amount AS DOUBLE),
  CAST(amount * 0.21 AS DOUBLE), true
FROM lines JOIN acc USING (request_id)""", *EDIT_TABLES, extra=EDIT_CHAIN))
def replace_orders_lines(fx):
    """The lines kept and the lines the accepted edits put in their place."""
    out, cols = _edit(fx), ["ID_TomaPedido", "ID_Producto", "Cantidad", "PrecioUnitario", "ImporteconDto", "IVA"]
    kept = decimals_to_double(out["kept_lines"].select(*cols)).withColumn("added", F.lit(False))
    return kept.unionByName(decimals_to_double(out["added_lines"].select(*cols)).withColumn("added", F.lit(True)))


@register("replace_orders_rejects", with_tables(
    """SELECT request_id, order_id, reason FROM dec WHERE reason IS NOT NULL
UNION ALL
SELECT request_id, order_id, CASE WHEN order_id IS NULL THEN 'not_found' ELSE 'superseded' END
FROM edit_headers ANTI JOIN latest USING (order_id, request_id)""", *EDIT_TABLES, extra=EDIT_CHAIN))
def replace_orders_rejects(fx):
    return _edit(fx)["rejects"]


# ---- P8 ----------------------------------------------------------------------
STATUS_CHANGES_SQL = """
SELECT ID_TomaPedido AS order_id, 'Entregado' AS status, ID_TomaPedido * 10 + 2 AS change_seq
FROM pedidos WHERE Estado IN ('O', 'P')
UNION ALL
SELECT ID_TomaPedido, 'En camino', ID_TomaPedido * 10 + 1 FROM pedidos WHERE Estado = 'P'"""


def status_changes(pedidos):
    k = F.col("ID_TomaPedido")
    done = pedidos.where(F.col("Estado").isin("O", "P")).select(
        k.alias("order_id"), F.lit("Entregado").alias("status"), (k * 10 + 2).alias("change_seq"))
    moving = pedidos.where(F.col("Estado") == "P").select(
        k.alias("order_id"), F.lit("En camino").alias("status"), (k * 10 + 1).alias("change_seq"))
    return done.unionByName(moving)


@register("set_order_status", with_tables("""
SELECT o.ID_TomaPedido, o.ID_Cliente, o.Fecha, o.FechaEntrega, o.ID_Condicion, CAST(o.Total AS DOUBLE) AS Total,
  CAST(o.Apagar AS DOUBLE) AS Apagar, CAST(o.Dto AS DOUBLE) AS Dto, CAST(o.CtaCte AS DOUBLE) AS CtaCte,
  coalesce(l.status, o.Estado) AS Estado, o.Observaciones, o.bDeposito, o.ID_Repartidor, o.Letra, o.ID_Comprobante,
  o.ID_Empleado, o.PorcentajeDto
FROM pedidos o LEFT JOIN (SELECT order_id, arg_max(status, change_seq) AS status FROM ch GROUP BY order_id) l
  ON o.ID_TomaPedido = l.order_id""", "pedidos", extra=[("ch", STATUS_CHANGES_SQL)]))
def set_order_status(fx):
    snap, _ = P.set_order_status(fx.pedidos, status_changes(fx.pedidos))
    return decimals_to_double(snap)


# ---- exact stock check: an order's lines of one product checked together ------
PER_PRODUCT_CHAIN = [(n, b.replace("quantity AS need FROM pl",
                                   "sum(quantity) OVER (PARTITION BY request_id, product_id) AS need FROM pl"))
                     for n, b in CHAIN]


@register("check_stock_per_product", with_tables(
    "SELECT request_id, reason IS NULL AS accepted, reason FROM dec", *REQ,
    extra=PER_PRODUCT_CHAIN[:[n for n, _ in PER_PRODUCT_CHAIN].index("dec") + 1]))
def check_stock_per_product(fx):
    dec = P.check_stock(fx.request_headers, fx.request_items, fx.productos, parties=_parties(fx), check="per_product")
    return dec.select("request_id", "accepted", "reason")


# ---- P5 exact below zero -------------------------------------------------------
@register("stock_walk", with_tables("""
SELECT p.ID_Producto, CAST(coalesce(w.after, p.Stock) AS INTEGER) AS Stock FROM productos p LEFT JOIN (
  SELECT ID_Producto, list_reduce(list_prepend(CAST(Stock AS DOUBLE), qs), lambda s, q: trunc(s - q)) AS after
  FROM productos JOIN (SELECT ID_Producto, list(CAST(Cantidad AS DOUBLE) ORDER BY ID_TomaPedido, Hoja, Cantidad) AS qs
                       FROM detalle_frac GROUP BY ID_Producto) USING (ID_Producto)
  WHERE Stock IS NOT NULL) w ON w.ID_Producto = p.ID_Producto""", "productos", "detalle_frac"))
def stock_walk(fx):
    """P5 line by line: every order line, many fractional, taken from the opening stock."""
    lines = fx.detalle_frac.select(F.col("ID_Producto").alias("product_id"), F.col("Cantidad").alias("quantity"), "ID_TomaPedido", "Hoja")
    return walk_stock(fx.productos, lines, ["ID_TomaPedido", "Hoja"]).select("ID_Producto", "Stock")

"""Registered maintenance queries (W1-W13) over the derived change tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from bodega.operators import changes as W
from bodega.operators.listings import decimals_to_double
from bodega.plans.fixture_sql import AS_OF_SQL, with_tables
from bodega.plans.registry import register
from bodega.sources import schemas as S
from bodega.sources.change_fixtures import change_table, driver_roster

MONEY = {"PrecioFinalUni", "Costo", "CostoUnit", "margen", "PrecioFinalPack", "PrecioNetoPack",
         "PrecioNetoUni", "MontoIVA", "Total", "Apagar", "Dto", "CtaCte", "Cantidad", "PrecioUnitario",
         "ImporteconDto", "IVA", "RestoIVA", "Monto", "Pr_UnidMinVenta"}


def _cols(table):
    return [c.split(" ")[0] for c in S.DDL[table].split(", ")]


def _out(c, expr):
    return f"CAST({expr} AS DOUBLE) AS {c}" if c in MONEY else f"{expr} AS {c}"


def _update_sql(table, key, fields, latest, stamp=None):
    stamp = stamp or {}
    sel = []
    for c in _cols(table):
        if c in fields:
            sel.append(_out(c, f"CASE WHEN l.{key} IS NOT NULL THEN l.{c} ELSE b.{c} END"))
        elif c in stamp:
            sel.append(_out(c, f"CASE WHEN l.{key} IS NOT NULL THEN {stamp[c]} ELSE b.{c} END"))
        else:
            sel.append(_out(c, f"b.{c}"))
    return (f"SELECT {', '.join(sel)} FROM {table} b LEFT JOIN "
            f"(SELECT * FROM {latest} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY change_seq DESC) = 1) l "
            f"ON b.{key} = l.{key}")


def _falsy_num(c):
    return f"({c} IS NULL OR {c} = 0)"


def _falsy_txt(c):
    return f"({c} IS NULL OR {c} = '')"


# ---- products (W8 with W1/W2) ---------------------------------------------
def _norm_products_sql():
    sel = []
    for c in W.PRODUCT_FIELDS:
        if c in W.PRODUCT_NUMBER_DEFAULTS:
            sel.append(f"CASE WHEN {_falsy_num(c)} THEN {W.PRODUCT_NUMBER_DEFAULTS[c]} ELSE {c} END AS {c}")
        elif c in W.PRODUCT_TEXT_DEFAULTS:
            sel.append(f"CASE WHEN {_falsy_txt(c)} THEN '{W.PRODUCT_TEXT_DEFAULTS[c]}' ELSE {c} END AS {c}")
        elif c in W.PRODUCT_NULL_IF_FALSY:
            f = _falsy_txt(c) if W.PRODUCT_NULL_IF_FALSY[c] == "text" else _falsy_num(c)
            sel.append(f"CASE WHEN {f} THEN NULL ELSE {c} END AS {c}")
        elif c == "PermiteDescuento":
            sel.append("coalesce(PermiteDescuento, true) AS PermiteDescuento")
        else:
            sel.append(c)
    return (f"SELECT ID_Producto, change_seq, {', '.join(sel)} FROM productos_changes "
            f"WHERE Descripcion IS NOT NULL AND ID_Proveedor IS NOT NULL")


def _products(fx):
    ch = change_table(fx.productos, "productos")
    return W.normalise_products(ch)


@register("product_update", with_tables(
    _update_sql("productos", "ID_Producto", W.PRODUCT_FIELDS, "norm"), "productos", "productos_changes",
    extra=[("norm", _norm_products_sql())]))
def product_update(fx):
    good, _ = _products(fx)
    snap, _ = W.update_rows(fx.productos, good, "ID_Producto", W.PRODUCT_FIELDS)
    return decimals_to_double(snap)


@register("product_update_rejects", with_tables("""
SELECT ID_Producto, change_seq, CASE WHEN Descripcion IS NULL THEN 'missing_name' ELSE 'missing_provider' END AS reason
FROM productos_changes WHERE Descripcion IS NULL OR ID_Proveedor IS NULL
UNION ALL
SELECT ID_Producto, change_seq, 'not_found' FROM norm WHERE ID_Producto NOT IN (SELECT ID_Producto FROM productos)""",
    "productos", "productos_changes", extra=[("norm", _norm_products_sql())]))
def product_update_rejects(fx):
    good, bad = _products(fx)
    _, missing = W.update_rows(fx.productos, good, "ID_Producto", W.PRODUCT_FIELDS)
    return bad.unionByName(missing)


def _insert_sql(table, key, fields, norm, extra_cols=()):
    from bodega.plans.fixture_sql import KEY_SQL_TYPE
    sel = ", ".join(_out(c, c) for c in [*fields, *extra_cols])
    return (f"SELECT CAST((SELECT max({key}) FROM {table}) + row_number() OVER (ORDER BY change_seq) "
            f"AS {KEY_SQL_TYPE[table]}) AS {key}, "
            f"change_seq, {sel} FROM {norm} WHERE {key} NOT IN (SELECT {key} FROM {table})")


@register("product_insert", with_tables(
    _insert_sql("productos", "ID_Producto", W.PRODUCT_FIELDS, "norm"), "productos", "productos_changes",
    extra=[("norm", _norm_products_sql())]))
def product_insert(fx):
    good, _ = _products(fx)
    new = good.join(fx.productos.select("ID_Producto"), "ID_Producto", "left_anti")
    _, inserted = W.insert_rows(fx.productos, new, "ID_Producto")
    return decimals_to_double(inserted)


# ---- clients (W9), partial update (W3) -------------------------------------
def _norm_clients_sql(insert):
    sel = ["Nombre"]
    sel += [f"CASE WHEN {_falsy_txt(c)} THEN '' ELSE {c} END AS {c}" for c in W.CLIENT_TEXT]
    sel += [f"CAST(CASE WHEN {_falsy_num(c)} THEN NULL ELSE {c} END AS INTEGER) AS {c}" for c in W.CLIENT_IDS]
    if insert:
        sel += ["'' AS IngresosBrutos", "'' AS CodigoPostal", "'' AS sitioweb", f"{AS_OF_SQL} AS FechaAlta",
                "'ACTIVO' AS Estado"]
    return f"SELECT ID_Cliente, change_seq, {', '.join(sel)} FROM clientes_changes"


@register("client_update", with_tables(
    _update_sql("clientes", "ID_Cliente", W.CLIENT_FIELDS, "norm"), "clientes", "clientes_changes",
    extra=[("norm", _norm_clients_sql(False))]))
def client_update(fx):
    norm = W.normalise_clients(change_table(fx.clientes, "clientes"))
    snap, _ = W.update_rows(fx.clientes, norm, "ID_Cliente", W.CLIENT_FIELDS)
    return snap


@register("client_insert", with_tables(
    _insert_sql("clientes", "ID_Cliente", W.CLIENT_FIELDS, "norm",
                ("IngresosBrutos", "CodigoPostal", "sitioweb", "FechaAlta", "Estado")),
    "clientes", "clientes_changes", extra=[("norm", _norm_clients_sql(True))]))
def client_insert(fx):
    norm = W.normalise_clients(change_table(fx.clientes, "clientes"), fx.as_of, insert=True)
    new = norm.join(fx.clientes.select("ID_Cliente"), "ID_Cliente", "left_anti")
    _, inserted = W.insert_rows(fx.clientes, new, "ID_Cliente")
    return inserted


def _partial_sql():
    fields = W.CLIENT_FIELDS
    latest = ", ".join(f"max_by({c}, CASE WHEN {c} IS NOT NULL THEN change_seq END) AS {c}" for c in fields)
    sel = ", ".join(f"coalesce(l.{c}, b.{c}) AS {c}" if c in fields else f"b.{c}" for c in _cols("clientes"))
    supplied = " OR ".join(f"{c} IS NOT NULL" for c in fields)
    return (f"SELECT {sel} FROM clientes b LEFT JOIN (SELECT ID_Cliente, {latest} FROM clientes_changes "
            f"WHERE ({supplied}) GROUP BY ID_Cliente) l ON b.ID_Cliente = l.ID_Cliente")


@register("client_partial_update", with_tables(_partial_sql(), "clientes", "clientes_changes"))
def client_partial_update(fx):
    snap, _ = W.partial_update(fx.clientes, change_table(fx.clientes, "clientes"), "ID_Cliente", W.CLIENT_FIELDS)
    return snap


# ---- providers (W10), brands (W11), categories (W12) ------------------------
def _norm_providers_sql():
    sel = ["RazonSocial"]
    sel += [f"CASE WHEN {_falsy_txt(c)} THEN '' ELSE {c} END AS {c}" for c in W.PROVIDER_TEXT]
    sel += [f"CAST(CASE WHEN {_falsy_num(c)} THEN NULL ELSE {c} END AS INTEGER) AS {c}" for c in W.PROVIDER_IDS]
    return f"SELECT ID_Proveedor, change_seq, {', '.join(sel)} FROM proveedores_changes"


@register("provider_update", with_tables(
    _update_sql("proveedores", "ID_Proveedor", W.PROVIDER_FIELDS, "norm"), "proveedores", "proveedores_changes",
    extra=[("norm", _norm_providers_sql())]))
def provider_update(fx):
    norm = W.normalise_providers(change_table(fx.proveedores, "proveedores"))
    snap, _ = W.update_rows(fx.proveedores, norm, "ID_Proveedor", W.PROVIDER_FIELDS)
    return snap


@register("brand_update", with_tables(
    _update_sql("marca", "Id_Marca", ["Mrc_Descripcion"], "norm"), "marca", "marca_changes",
    extra=[("norm", "SELECT * FROM marca_changes WHERE Mrc_Descripcion IS NOT NULL AND Mrc_Descripcion <> ''")]))
def brand_update(fx):
    good, _ = W.normalise_brands(change_table(fx.marca, "marca"))
    snap, _ = W.update_rows(fx.marca, good, "Id_Marca", ["Mrc_Descripcion"])
    return snap


@register("brand_insert", with_tables(
    _insert_sql("marca", "Id_Marca", ["Mrc_Descripcion"], "norm").replace(
        "WHERE Id_Marca NOT IN (SELECT Id_Marca FROM marca)", ""),
    "marca", "marca_changes",
    extra=[("norm", "SELECT * FROM marca_changes WHERE Mrc_Descripcion IS NOT NULL AND Mrc_Descripcion <> ''")]))
def brand_insert(fx):
    """Every valid brand change sent as a new brand (ids assigned in order)."""
    good, _ = W.normalise_brands(change_table(fx.marca, "marca"))
    _, inserted = W.insert_rows(fx.marca, good, "Id_Marca")
    return inserted


@register("category_update", with_tables(
    _update_sql("rubros", "ID_Rubro", ["Descripcion"], "norm"), "rubros", "rubros_changes",
    extra=[("norm", "SELECT * FROM rubros_changes WHERE Descripcion IS NOT NULL")]))
def category_update(fx):
    good, _ = W.normalise_categories(change_table(fx.rubros, "rubros"))
    snap, _ = W.update_rows(fx.rubros, good, "ID_Rubro", ["Descripcion"])
    return snap


# ---- drivers (W13), insert-if-absent (W7) ----------------------------------
def _norm_drivers_sql(insert, src="repartidores_changes"):
    sel = ["Nombre", "Apellido"]
    sel += [f"CASE WHEN {_falsy_txt(c)} THEN NULL ELSE {c} END AS {c}" for c in W.DRIVER_OPTIONAL]
    sel += [f"coalesce(FechaIngreso, {AS_OF_SQL}) AS FechaIngreso" if insert else "FechaIngreso",
            f"CASE WHEN {_falsy_txt('Estado')} THEN 'Activo' ELSE Estado END AS Estado", "VencimientoLicencia"]
    if insert:
        sel += [f"{AS_OF_SQL} AS CreatedAt", f"{AS_OF_SQL} AS UpdatedAt"]
        cond = f"NOT ({_falsy_txt('Nombre')} OR {_falsy_txt('Apellido')})"
    else:
        cond = "Nombre IS NOT NULL AND Apellido IS NOT NULL"
    return f"SELECT ID_Repartidor, change_seq, {', '.join(sel)} FROM {src} WHERE {cond}"


@register("driver_update", with_tables(
    _update_sql("repartidores", "ID_Repartidor", W.DRIVER_FIELDS, "norm", {"UpdatedAt": AS_OF_SQL}),
    "repartidores", "repartidores_changes", extra=[("norm", _norm_drivers_sql(False))]))
def driver_update(fx):
    good, _ = W.normalise_drivers(change_table(fx.repartidores, "repartidores"), fx.as_of, insert=False)
    from bodega.functions.exprs import ts
    snap, _ = W.update_rows(fx.repartidores, good, "ID_Repartidor", W.DRIVER_FIELDS, stamp={"UpdatedAt": ts(fx.as_of)})
    return snap


DRIVER_INSERT_COLS = [*W.DRIVER_FIELDS, "CreatedAt", "UpdatedAt"]


@register("driver_insert_if_absent", with_tables(f"""
SELECT CAST((SELECT max(ID_Repartidor) FROM repartidores) + row_number() OVER (ORDER BY change_seq) AS INTEGER)
  AS ID_Repartidor,
  change_seq, {', '.join(DRIVER_INSERT_COLS)}
FROM (SELECT * FROM norm QUALIFY row_number() OVER (PARTITION BY DNI ORDER BY change_seq) = 1) f
WHERE DNI NOT IN (SELECT DNI FROM repartidores WHERE DNI IS NOT NULL)""",
    "repartidores", "driver_roster", extra=[("norm", _norm_drivers_sql(True, "driver_roster"))]))
def driver_insert_if_absent(fx):
    good, _ = W.normalise_drivers(driver_roster(fx.raw("nation")), fx.as_of, insert=True)
    _, inserted = W.insert_if_absent(fx.repartidores, good, ["DNI"], "ID_Repartidor")
    return inserted.select("ID_Repartidor", "change_seq", *DRIVER_INSERT_COLS)


# ---- deletes (W4-W6) ----------------------------------------------------------
PRODUCT_OUT = ", ".join(_out(c, f"p.{c}") for c in _cols("productos"))


@register("delete_unsold_products", with_tables(
    f"SELECT {PRODUCT_OUT} FROM productos p WHERE p.ID_Producto IN (SELECT ID_Producto FROM detalle)",
    "productos", "detalle"))
def delete_unsold_products(fx):
    """Drop every product that no order line mentions."""
    unsold = fx.productos.select("ID_Producto").join(fx.detalle.select("ID_Producto"), "ID_Producto", "left_anti")
    return decimals_to_double(W.delete_rows(fx.productos, unsold, "ID_Producto"))


@register("delete_out_of_stock_products", with_tables(
    f"SELECT {PRODUCT_OUT} FROM productos p WHERE NOT p.SinStockApp", "productos"))
def delete_out_of_stock_products(fx):
    """Drop every product marked as out of stock."""
    return decimals_to_double(W.delete_rows(fx.productos, fx.productos.where("SinStockApp").select("ID_Producto"), "ID_Producto"))


DRIVER_OUT = ", ".join(_cols("repartidores"))


@register("guarded_delete", with_tables(
    f"SELECT {DRIVER_OUT} FROM repartidores WHERE ID_Repartidor IN "
    f"(SELECT ID_Repartidor FROM pedidos WHERE ID_Repartidor IS NOT NULL)", "repartidores", "pedidos"))
def guarded_delete(fx):
    """Ask to delete every driver; those with orders stay."""
    kept, _ = W.guarded_delete(fx.repartidores, fx.repartidores, "ID_Repartidor", fx.pedidos, "ID_Repartidor")
    return kept


@register("guarded_delete_rejects", with_tables("""
SELECT r.ID_Repartidor, count(*) AS ref_count, 'referenced' AS reason
FROM repartidores r JOIN pedidos p ON p.ID_Repartidor = r.ID_Repartidor
GROUP BY r.ID_Repartidor""", "repartidores", "pedidos"))
def guarded_delete_rejects(fx):
    _, rejects = W.guarded_delete(fx.repartidores, fx.repartidores, "ID_Repartidor", fx.pedidos, "ID_Repartidor")
    return rejects


ORDER_OUT = ", ".join(_out(c, c) for c in _cols("pedidos"))
LINE_OUT = ", ".join(_out(c, c) for c in _cols("detalle") if c != "Item")


@register("cascade_delete_orders", with_tables(
    f"SELECT {ORDER_OUT} FROM pedidos WHERE Estado <> 'F'", "pedidos"))
def cascade_delete_orders(fx):
    """Purge the finished orders ('F') with their lines."""
    done = fx.pedidos.where(F.col("Estado") == "F").select("ID_TomaPedido")
    orders, _ = W.cascade_delete(fx.pedidos, fx.detalle, done)
    return decimals_to_double(orders)


@register("cascade_delete_lines", with_tables(
    f"SELECT {LINE_OUT} FROM detalle WHERE ID_TomaPedido NOT IN "
    f"(SELECT ID_TomaPedido FROM pedidos WHERE Estado = 'F')", "pedidos", "detalle"))
def cascade_delete_lines(fx):
    done = fx.pedidos.where(F.col("Estado") == "F").select("ID_TomaPedido")
    _, lines = W.cascade_delete(fx.pedidos, fx.detalle, done)
    return decimals_to_double(lines)


# ---- W1-W7 as one ordered change log --------------------------------------------
LOG_FIELDS = ["Descripcion", "PrecioFinalUni", "Stock", "idMarca", "Estado", "PermiteDescuento"]
_LOG_LIST = ", ".join(LOG_FIELDS)
# (change, op, which keys): 1 to 3 are the derived changes, the others follow on the base keys
_LOG_OP = """CASE WHEN change_seq % 10 = 3 AND ID_Producto % 2 = 0 THEN 'insert'
  WHEN change_seq % 10 = 2 OR (change_seq % 10 = 1 AND ID_Producto % 3 = 0) THEN 'partial' ELSE 'replace' END"""
_LOG_MORE = [(4, "delete", "ID_Producto % 11 = 0"), (5, "insert", "ID_Producto % 22 = 0"), (6, "insert", "ID_Producto % 33 = 0"),
             (7, "partial", "ID_Producto % 12 = 0"), (8, "replace", "ID_Producto % 55 = 0")]


def _log_more(values: str) -> str:
    """The later changes: an insert or replacement brings the base's values, a partial update nothing."""
    rows = []
    for v, op, which in _LOG_MORE:
        cols = ", ".join(c if op in ("insert", "replace") else f"NULL AS {c}" for c in LOG_FIELDS)
        rows.append(f"SELECT ID_Producto, CAST(ID_Producto * 10 + {v} AS BIGINT) AS change_seq, '{op}' AS op, {cols} FROM {values} WHERE {which}")
    return " UNION ALL ".join(rows)


def product_log(fx):
    first = change_table(fx.productos, "productos").selectExpr("ID_Producto", "change_seq", f"{_LOG_OP} AS op", *LOG_FIELDS)
    base = fx.productos
    more = [base.where(which).selectExpr("ID_Producto", f"CAST(ID_Producto * 10 + {v} AS BIGINT) AS change_seq", f"'{op}' AS op",
                                         *[c if op in ("insert", "replace") else f"CAST(NULL AS {base.schema[c].dataType.simpleString()}) AS {c}" for c in LOG_FIELDS])
            for v, op, which in _LOG_MORE]
    for m in more:
        first = first.unionByName(m)
    return first


_PACK = "struct_pack(" + ", ".join(f"{c} := {{t}}.{c}" for c in LOG_FIELDS) + ")"
_MERGE = "struct_pack(" + ", ".join(f"{c} := coalesce(o.{c}, st.s.{c})" for c in LOG_FIELDS) + ")"
LOG_STEPS = [
    ("log", f"SELECT ID_Producto, change_seq, {_LOG_OP} AS op, {_LOG_LIST} FROM productos_changes UNION ALL {_log_more('productos')}"),
    ("ops", f"""SELECT *, row_number() OVER (PARTITION BY ID_Producto ORDER BY change_seq) AS i FROM log
WHERE NOT (op = 'partial' AND coalesce({", ".join(f"CAST({c} AS VARCHAR)" for c in LOG_FIELDS)}) IS NULL)"""),
    ("st", f"""SELECT k.ID_Producto, CAST(0 AS BIGINT) AS i, b.ID_Producto IS NOT NULL AS there, {_PACK.format(t="b")} AS s, false AS made,
  CAST(NULL AS BIGINT) AS change_seq, CAST(NULL AS VARCHAR) AS reason
FROM (SELECT ID_Producto FROM productos UNION SELECT ID_Producto FROM ops) k LEFT JOIN productos b USING (ID_Producto)
UNION ALL
SELECT o.ID_Producto, o.i, CASE o.op WHEN 'insert' THEN true WHEN 'delete' THEN false ELSE st.there END,
  CASE WHEN o.op = 'insert' AND NOT st.there OR o.op = 'replace' AND st.there THEN {_PACK.format(t="o")}
       WHEN o.op = 'partial' AND st.there THEN {_MERGE} ELSE st.s END,
  st.made OR (o.op = 'insert' AND NOT st.there), o.change_seq,
  CASE WHEN o.op = 'insert' AND st.there THEN 'exists' WHEN o.op <> 'insert' AND NOT st.there THEN 'not_found' END
FROM st JOIN ops o ON o.ID_Producto = st.ID_Producto AND o.i = st.i + 1"""),
]


def _log_sql(body: str) -> str:
    return "WITH RECURSIVE" + with_tables(body, "productos", "productos_changes", extra=LOG_STEPS, once=("log", "ops"))[len("WITH"):]


@register("product_log", _log_sql(f"""
SELECT f.ID_Producto, {", ".join(_out(c, f"f.s.{c}") for c in LOG_FIELDS)}, CASE WHEN f.made THEN NULL ELSE b.Pr_Pack END AS Pr_Pack
FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY ID_Producto ORDER BY i DESC) = 1) f LEFT JOIN productos b USING (ID_Producto)
WHERE f.there"""))
def product_log_snapshot(fx):
    """W1-W7 in order: the products after inserts, replacements, partial updates and deletes."""
    snap, _ = W.apply_change_log(fx.productos, product_log(fx), "ID_Producto", LOG_FIELDS)
    return decimals_to_double(snap.select("ID_Producto", *LOG_FIELDS, "Pr_Pack"))


@register("product_log_rejects", _log_sql("""
SELECT ID_Producto, change_seq, reason FROM st WHERE reason IS NOT NULL
UNION ALL
SELECT ID_Producto, change_seq, 'nothing_to_update' FROM log ANTI JOIN ops USING (ID_Producto, change_seq)"""))
def product_log_rejects(fx):
    """W1-W7 in order: the changes rejected, and why."""
    _, rejects = W.apply_change_log(fx.productos, product_log(fx), "ID_Producto", LOG_FIELDS)
    return rejects

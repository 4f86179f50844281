"""Registered migration and load queries.

Source side: products, orders and lines of the "other database" (the
fixture's dirty variants, with broken references). Destination side: the
clean dimension tables.
"""
from __future__ import annotations

import uuid

from bodega.operators import constraints as C
from bodega.operators import migration as M
from bodega.operators.listings import decimals_to_double
from bodega.plans.fixture_sql import with_tables
from bodega.plans.registry import register
from bodega.session import ensure_checkpoint_dir
from bodega.sources import schemas as S
from bodega.sources import tables as T

DST = ("proveedores", "rubros", "marca", "alicuotas", "clientes", "condicion_pago")

PRODUCT_COLS = [c.split(" ")[0] for c in S.DDL["productos"].split(", ")]
MONEY = {"PrecioFinalUni", "Costo", "CostoUnit", "margen", "PrecioFinalPack", "PrecioNetoPack",
         "PrecioNetoUni", "MontoIVA", "Total", "Apagar", "Dto", "CtaCte", "Pr_UnidMinVenta"}


def _sel(cols, alias="p", override=None):
    override = override or {}
    out = []
    for c in cols:
        if c in override:
            out.append(f"{override[c]} AS {c}")
        elif c in MONEY:
            out.append(f"CAST({alias}.{c} AS DOUBLE) AS {c}")
        else:
            out.append(f"{alias}.{c}")
    return ", ".join(out)


def _src(fx):
    return {"productos": fx.productos_src, "pedidos": fx.pedidos_src, "detalle": fx.detalle_items,
            "marca": fx.marca, "alicuotas": fx.alicuotas}


@register("copy_brands", with_tables("SELECT Id_Marca, Mrc_Descripcion FROM marca", "marca"))
def copy_brands(fx):
    return M.copy_table(fx.marca)


@register("copy_vat_rates", with_tables("SELECT id_alicuota, Alic_descripcion, CAST(Alicuota AS DOUBLE) AS Alicuota FROM alicuotas", "alicuotas"))
def copy_vat_rates(fx):
    return M.copy_table(fx.alicuotas).withColumn("Alicuota", fx.alicuotas["Alicuota"].cast("double"))


# A reference survives if its key is among the known ones; each scalar subquery finds
# the known key, or nothing.
def _known(fk: str, table: str, key: str) -> str:
    return f"(SELECT max(t.{key}) FROM {table} t WHERE t.{key} = p.{fk})"


REPAIR_OVERRIDE = {
    "ID_Proveedor": f"coalesce({_known('ID_Proveedor', 'proveedores', 'ID_Proveedor')}, 1)",
    "ID_Rubro": f"coalesce({_known('ID_Rubro', 'rubros', 'ID_Rubro')}, 1)",
    "idMarca": _known("idMarca", "marca", "Id_Marca"),
    "IdAlicIva": _known("IdAlicIva", "alicuotas", "id_alicuota"),
}
REPAIR_FROM = "FROM productos_src p"


@register("repair_references", with_tables(
    f"SELECT {_sel(PRODUCT_COLS, 'p', REPAIR_OVERRIDE)}\n{REPAIR_FROM}",
    "productos_src", "proveedores", "rubros", "marca", "alicuotas"))
def repair_references(fx):
    rules = {fk: (getattr(fx, t), k, fb) for fk, (t, k, fb) in M.FALLBACKS.items()}
    return decimals_to_double(M.repair_references(fx.productos_src, rules))


LCG_STOCK = ("CAST(((p.ID_Producto % 2147483648) * 1103515245 + 12345) % 2147483648 % 500 AS INTEGER)")


@register("load_products", with_tables(
    f"SELECT {_sel(PRODUCT_COLS, 'p', dict(REPAIR_OVERRIDE, Stock=LCG_STOCK))}\n{REPAIR_FROM}",
    "productos_src", "proveedores", "rubros", "marca", "alicuotas"))
def load_products(fx):
    """E2 + E5: repaired references and the synthetic stock."""
    return decimals_to_double(M.load_products(fx.productos_src, fx.tables(*DST)))


NEWEST = ("newest", """SELECT *, row_number() OVER (ORDER BY ID_TomaPedido DESC) AS nth
FROM pedidos_src SEMI JOIN clientes USING (ID_Cliente)""")

RECENT_SQL = with_tables(f"""
SELECT {_sel(M.ORDER_COLS, 'p', {"ID_Condicion": _known("ID_Condicion", "condicion_pago", "ID_CondicionPago")})}
FROM newest p WHERE nth <= 1000""", "pedidos_src", "clientes", "condicion_pago", extra=[NEWEST])


@register("load_recent_orders", RECENT_SQL)
def load_recent_orders(fx):
    return decimals_to_double(M.load_recent_orders(fx.pedidos_src, fx.clientes, fx.condicion_pago, M.RECENT_ORDERS))


LINE_COLS = [c.split(" ")[0] for c in S.DDL["detalle"].split(", ")]
LINES_SQL = with_tables(f"""
SELECT {", ".join(f"CAST(d.{c} AS DOUBLE) AS {c}" if c in ("Cantidad", "PrecioUnitario", "ImporteconDto",
                  "IVA", "RestoIVA", "Dto", "Monto", "CostoUnit") else f"d.{c}" for c in LINE_COLS)}
FROM detalle_items d SEMI JOIN (SELECT ID_TomaPedido FROM newest WHERE nth <= 1000) USING (ID_TomaPedido)
  SEMI JOIN productos_src USING (ID_Producto)""",
                        "detalle_items", "pedidos_src", "clientes", "productos_src", extra=[NEWEST])


@register("load_order_lines", LINES_SQL)
def load_order_lines(fx):
    loaded = M.migrate(_src(fx), fx.tables(*DST), M.RECENT_ORDERS)
    return decimals_to_double(loaded["detalle"])


REPORT_SQL = with_tables("""
SELECT 'marca' AS table_name, count(*) AS rows_loaded FROM marca
UNION ALL SELECT 'alicuotas', count(*) FROM alicuotas
UNION ALL SELECT 'productos', count(*) FROM productos_src
UNION ALL SELECT 'pedidos', count(*) FROM newest WHERE nth <= 1000
UNION ALL SELECT 'detalle', count(*) FROM detalle_items
  SEMI JOIN (SELECT ID_TomaPedido FROM newest WHERE nth <= 1000) USING (ID_TomaPedido)
  SEMI JOIN productos_src USING (ID_Producto)""",
                         "marca", "alicuotas", "productos_src", "pedidos_src", "clientes", "detalle_items", extra=[NEWEST])


@register("load_report", REPORT_SQL)
def load_report(fx):
    return M.load_report(M.migrate(_src(fx), fx.tables(*DST), M.RECENT_ORDERS))


@register("ensure_column", with_tables(
    f"SELECT {_sel(PRODUCT_COLS, 'p', {'PermiteDescuento': 'true'})} FROM productos p", "productos"))
def ensure_column(fx):
    bare = fx.productos.drop("PermiteDescuento")
    once = M.ensure_column(bare, "PermiteDescuento", "boolean", True)
    return decimals_to_double(M.ensure_column(once, "PermiteDescuento", "boolean", True))


# ---- E9 -------------------------------------------------------------------
CHECKED = {"productos": "productos_src", "pedidos": "pedidos_src", "detalle": "detalle_items",
           "marca": "marca", "alicuotas": "alicuotas", "rubros": "rubros", "repartidores": "repartidores",
           "clientes": "clientes", "proveedores": "proveedores", "condicion_pago": "condicion_pago"}


def _constraints_sql() -> str:
    parts = []
    for name, cte in CHECKED.items():
        cols = [c.split(" ")[0] for c in S.DDL[name].split(", ")]
        rules = [("not_null", c, f"{c} IS NULL") for c in S.NOT_NULL.get(name, []) if c in cols]
        rules += [(f"max_length_{n}", c, f"length({c}) > {n}") for c, n in S.MAX_LENGTH.get(name, {}).items()
                  if c in cols]
        for rule, col, cond in rules:
            parts.append(f"SELECT '{name}' AS table_name, '{rule}' AS rule, '{col}' AS columns, "
                         f"count(*) FILTER (WHERE {cond}) AS violations FROM {cte}")
        if name in S.PRIMARY_KEY:
            key = S.PRIMARY_KEY[name]
            nullk = " OR ".join(f"{k} IS NULL" for k in key)
            parts.append(
                f"SELECT '{name}', 'primary_key', '{','.join(key)}', CAST(coalesce(sum(CASE WHEN {nullk} THEN n "
                f"WHEN n > 1 THEN n - 1 ELSE 0 END), 0) AS BIGINT) "
                f"FROM (SELECT {', '.join(key)}, count(*) AS n FROM {cte} GROUP BY {', '.join(key)})")
    for t, c, rt, rc in S.FOREIGN_KEYS:
        if t in CHECKED and rt in CHECKED:
            parts.append(f"SELECT '{t}', 'foreign_key:{rt}.{rc}', '{c}', count(*) FROM {CHECKED[t]} x "
                         f"WHERE x.{c} IS NOT NULL AND x.{c} NOT IN (SELECT {rc} FROM {CHECKED[rt]} "
                         f"WHERE {rc} IS NOT NULL)")
    return with_tables("\nUNION ALL ".join(parts), *CHECKED.values())


@register("check_constraints", _constraints_sql())
def check_constraints(fx):
    return C.check_constraints({k: getattr(fx, v) for k, v in CHECKED.items()})


@register("orphan_products", with_tables(
    f"SELECT {_sel(PRODUCT_COLS, 'p')} FROM productos_src p "
    "WHERE p.ID_Proveedor NOT IN (SELECT ID_Proveedor FROM proveedores)", "productos_src", "proveedores"))
def orphan_products(fx):
    """E9 detail: the source products whose provider does not exist."""
    return decimals_to_double(C.orphans(fx.productos_src, "ID_Proveedor", fx.proveedores, "ID_Proveedor"))


# ---- E3/E4 beyond the newest thousand -------------------------------------------
@register("load_all_orders", RECENT_SQL.replace("WHERE nth <= 1000", ""))
def load_all_orders(fx):
    """E3 over every order whose client exists."""
    return decimals_to_double(M.load_recent_orders(fx.pedidos_src, fx.clientes, fx.condicion_pago, None))


@register("load_newest_orders", RECENT_SQL.replace("nth <= 1000", "nth <= 5000"))
def load_newest_orders(fx):
    """E3 with the newest 5,000 orders, found by counts per range of ids."""
    return decimals_to_double(M.load_recent_orders(fx.pedidos_src, fx.clientes, fx.condicion_pago, 5000))


@register("load_all_order_lines", LINES_SQL.replace("WHERE nth <= 1000", ""))
def load_all_order_lines(fx):
    """E4 over the lines of every loaded order."""
    return decimals_to_double(M.migrate(_src(fx), fx.tables(*DST), None)["detalle"])


# ---- appends into filled tables, counted by their writes ------------------------
def _fresh_root(fx) -> str:
    return f"{ensure_checkpoint_dir(fx.spark).rstrip('/')}/bodega-loads/{uuid.uuid4().hex}"


@register("load_report_observed", REPORT_SQL)
def load_report_observed(fx):
    """E6 written table by table, E7 as the writes observed it."""
    report, _ = M.migrate_into(_src(fx), fx.tables(*DST), _fresh_root(fx), "first", M.RECENT_ORDERS)
    return report


def _append_orders(fx):
    """The newest thousand orders, then all of them, the second load run twice."""
    root = _fresh_root(fx)
    T.ensure_table(fx.spark, root, "pedidos")
    refused = None
    for batch, n in (("first", M.RECENT_ORDERS), ("second", None), ("second", None)):
        orders = M.load_recent_orders(fx.pedidos_src, fx.clientes, fx.condicion_pago, n)
        _, refused = T.append_batch(orders, root, "pedidos", batch, S.PRIMARY_KEY["pedidos"])
    return T.read_appended(fx.spark, root, "pedidos", orders.schema), refused


@register("append_orders", RECENT_SQL.replace("\nFROM newest", ",\n  CASE WHEN nth <= 1000 THEN 'first' ELSE 'second' END AS batch\nFROM newest")
          .replace("WHERE nth <= 1000", ""))
def append_orders(fx):
    """E3 as an append into a filled table, read back with the batch of each order."""
    return decimals_to_double(_append_orders(fx)[0])


@register("append_orders_refused", RECENT_SQL)
def append_orders_refused(fx):
    """The orders of the second load whose ids the first one had brought."""
    return decimals_to_double(_append_orders(fx)[1])

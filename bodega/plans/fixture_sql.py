"""DuckDB text of the fixture derivations in ``bodega.sources.fixtures``.

The raw test tables are pre-registered views; each model table is a CTE.
``with_tables(body, *names)`` prefixes a query with the CTEs it needs.
"""
from __future__ import annotations

AS_OF_SQL = "TIMESTAMP '2001-08-01 00:00:00'"

LINE_ORDER_SQL = ("l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, "
                  "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate")

UNIT_PRICE_SQL = "CAST(floor(round(l_extendedprice * 100) / l_quantity) / 100 AS DECIMAL(18,2))"

LINE_EXTRAS = f"""CAST(l_linenumber AS INTEGER) AS Hoja,
  CASE l_returnflag WHEN 'R' THEN 1 WHEN 'N' THEN 0 END AS Rechazo, CAST(l_extendedprice AS DECIMAL(18,2)) AS Monto,
  CAST({UNIT_PRICE_SQL} * 0.6 AS DECIMAL(18,2)) AS CostoUnit, l_orderkey AS NroPedido"""

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, deps: tuple[str, ...], body: str) -> None:
    CTES[name] = (deps, body)


_cte("rubros", (), """
SELECT CAST(row_number() OVER (ORDER BY p_type) AS INTEGER) AS ID_Rubro, p_type AS Descripcion
FROM (SELECT DISTINCT p_type FROM part)""")

_cte("marca", (), """
SELECT DISTINCT CAST(split_part(p_brand, '#', 2) AS INTEGER) AS Id_Marca, p_brand AS Mrc_Descripcion FROM part""")

_cte("alicuotas", (), """
SELECT CAST(row_number() OVER (ORDER BY l_tax) AS INTEGER) AS id_alicuota,
  'IVA ' || CAST(CAST(round(l_tax * 100) AS INTEGER) AS VARCHAR) || '%' AS Alic_descripcion, CAST(l_tax AS REAL) AS Alicuota
FROM (SELECT DISTINCT l_tax FROM lineitem)""")

_cte("condicion_pago", (), """
SELECT CAST(row_number() OVER (ORDER BY o_orderpriority) AS INTEGER) AS ID_CondicionPago,
       o_orderpriority AS Descripcion
FROM (SELECT DISTINCT o_orderpriority FROM orders)""")

_cte("localidad", (), "SELECT n_nationkey AS ID_Localidad, rpad(n_name, 30, ' ') AS Nombre FROM nation")
_cte("barrios", (), "SELECT n_nationkey AS ID_Barrio, rpad(n_name, 30, ' ') AS Nombre FROM nation")
_cte("zona", (), "SELECT r_regionkey AS ID_Zona, rpad(r_name, 30, ' ') AS Descripcion FROM region")

_cte("repartidores", (), """
SELECT rid AS ID_Repartidor,
  rpad(n_name, 40, ' ') AS Nombre,
  'Apellido' || CAST(rid AS VARCHAR) AS Apellido,
  CASE WHEN rid % 2 = 1 THEN NULL ELSE CAST(rid + 30000000 AS VARCHAR) END AS DNI,
  CASE WHEN rid % 2 = 1 THEN NULL ELSE '351-' || lpad(CAST(rid AS VARCHAR), 7, '0') END AS Telefono,
  CASE WHEN rid % 2 = 1 THEN NULL ELSE 'Calle ' || CAST(rid AS VARCHAR) END AS Direccion,
  CASE WHEN rid % 2 = 1 THEN NULL ELSE 'rep' || CAST(rid AS VARCHAR) || '@correo.test' END AS Email,
  TIMESTAMP '2020-01-01 00:00:00' AS FechaIngreso,
  'Activo' AS Estado,
  CASE WHEN rid % 2 = 1 THEN NULL ELSE 'turno ' || CAST(rid AS VARCHAR) END AS Observaciones,
  CASE WHEN rid % 2 = 1 THEN NULL ELSE 'B' || lpad(CAST(rid AS VARCHAR), 6, '0') END AS LicenciaConducir,
  CASE WHEN rid % 2 = 1 THEN NULL ELSE TIMESTAMP '2026-12-31 00:00:00' END AS VencimientoLicencia,
  TIMESTAMP '2020-01-01 00:00:00' AS CreatedAt,
  TIMESTAMP '2020-01-01 00:00:00' AS UpdatedAt
FROM (SELECT CAST(n_nationkey + 1 AS INTEGER) AS rid, n_name FROM nation)""")

_cte("clientes", (), """
SELECT c_custkey AS ID_Cliente,
  CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE rpad(c_name, 50, ' ') END AS Nombre,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS Apellido,
  'Razon Social ' || CAST(c_custkey AS VARCHAR) AS RazonSocial,
  rpad('Calle ' || CAST(c_custkey % 97 AS VARCHAR), 30, ' ') AS Direccion,
  CAST(c_custkey % 1000 AS VARCHAR) AS Numero,
  '351-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS Telefono,
  '30-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '-9' AS CUIT,
  'cliente' || CAST(c_custkey AS VARCHAR) || '@correo.test' AS correo,
  CAST(c_custkey % 30 AS INTEGER) AS ID_Barrio,
  c_nationkey AS ID_Localidad,
  CAST(c_nationkey % 5 AS INTEGER) AS ID_Zona,
  CAST(c_custkey % 7 + 1 AS INTEGER) AS id_condicion,
  'ACTIVO' AS Estado,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'IB-' || CAST(c_custkey AS VARCHAR) END AS IngresosBrutos,
  CAST(c_custkey % 900 + 5000 AS VARCHAR) AS CodigoPostal,
  CASE WHEN c_custkey % 2 = 1 THEN NULL ELSE 'www.cliente' || CAST(c_custkey AS VARCHAR) || '.test' END AS sitioweb,
  TIMESTAMP '2019-02-01 00:00:00' AS FechaAlta
FROM customer""")

_cte("proveedores", (), """
SELECT s_suppkey AS ID_Proveedor,
  rpad(s_name, 50, ' ') AS RazonSocial,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'Contacto ' || CAST(s_suppkey AS VARCHAR) END AS Contacto,
  '351-' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS Telefono,
  '20-' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') || '-5' AS CUIT,
  'proveedor' || CAST(s_suppkey AS VARCHAR) || '@correo.test' AS Correo,
  rpad('Avenida ' || CAST(s_suppkey % 89 AS VARCHAR), 30, ' ') AS Direccion,
  CAST(s_suppkey % 500 AS VARCHAR) AS Numero,
  CAST(s_suppkey % 7 + 1 AS INTEGER) AS ID_Condicion,
  s_nationkey AS Barrio,
  s_nationkey AS Localidad,
  'ACTIVO' AS Estado,
  CAST(s_suppkey % 900 + 5000 AS VARCHAR) AS CodigoPostal,
  CASE WHEN s_suppkey % 2 = 1 THEN NULL ELSE 'www.proveedor' || CAST(s_suppkey AS VARCHAR) || '.test' END AS SitioWeb,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE '351-9' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') END AS Fax,
  'IB-' || CAST(s_suppkey AS VARCHAR) AS IB,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE lpad(CAST(s_suppkey AS VARCHAR), 12, '0') END AS NroCuenta
FROM supplier""")


def _productos_sql(dirty: bool) -> str:
    nsup = "(SELECT count(*) * 2 FROM supplier)" if dirty else "(SELECT count(*) FROM supplier)"
    brand = "CAST(split_part(p_brand, '#', 2) AS INTEGER)" + (" + 10" if dirty else "")
    vat = "CAST(p_partkey % 3 + 1 AS INTEGER)" + (" + 1" if dirty else "")
    rubro = "CAST(p_partkey % 9 + 1 AS INTEGER)" if dirty else "r.ID_Rubro"
    src = "part p" if dirty else "part p JOIN rubros r ON r.Descripcion = p.p_type"
    return f"""
SELECT ID_Producto, Descripcion, Pr_Ean13, PrecioFinalUni, Stock, ID_Proveedor, ID_Rubro, idMarca, IdAlicIva,
  CAST(CASE WHEN IdAlicIva = 1 THEN 0.21 WHEN IdAlicIva = 2 THEN 0.105 WHEN IdAlicIva = 3 THEN 0.27 END AS DOUBLE)
    AS AlicIva_desc,
  CAST(PrecioFinalUni * 0.6 AS DECIMAL(18,2)) AS Costo,
  CAST(PrecioFinalUni * 0.6 AS DECIMAL(18,2)) AS CostoUnit,
  CAST(PrecioFinalUni * 0.4 AS DECIMAL(18,2)) AS margen,
  CAST(PrecioFinalUni * Pr_UniXPack AS DECIMAL(18,2)) AS PrecioFinalPack,
  CAST(CAST(PrecioFinalUni * 0.8 AS DECIMAL(18,2)) * Pr_UniXPack AS DECIMAL(18,2)) AS PrecioNetoPack,
  CAST(PrecioFinalUni * 0.8 AS DECIMAL(18,2)) AS PrecioNetoUni,
  CAST(PrecioFinalUni * 0.2 AS DECIMAL(18,2)) AS MontoIVA,
  1 AS PMR, 'UN' AS Pr_Pack, Pr_UniXPack, 'Activo' AS Estado, false AS OcultarApp,
  p_size < 5 AS SinStockApp, p_partkey % 5 <> 0 AS PermiteDescuento,
  CASE WHEN idMarca IS NOT NULL THEN p_brand END AS MarcaDesc,
  CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 'OR-' || CAST(p_partkey AS VARCHAR) END AS Pr_CodOrigen,
  CAST(p_size % 4 + 0.5 AS DECIMAL(18,2)) AS Pr_UnidMinVenta, CAST(p_partkey % 2 AS BIGINT) AS Enviado
FROM (
  SELECT p.p_partkey AS ID_Producto, p.p_name AS Descripcion,
    lpad(CAST(p.p_partkey AS VARCHAR), 13, '0') AS Pr_Ean13,
    CAST(p.p_retailprice AS DECIMAL(18,2)) AS PrecioFinalUni,
    CASE WHEN p.p_partkey % 101 = 0 THEN NULL ELSE p.p_size * 3 END AS Stock,
    p.p_partkey % {nsup} AS ID_Proveedor,
    {rubro} AS ID_Rubro,
    CASE WHEN p.p_size % 7 = 0 THEN NULL ELSE {brand} END AS idMarca,
    CASE WHEN p.p_partkey % 11 = 0 THEN NULL ELSE {vat} END AS IdAlicIva,
    CAST(p.p_size % 12 + 1 AS INTEGER) AS Pr_UniXPack,
    p.p_size, p.p_partkey, p.p_brand
  FROM {src}
)"""


_cte("productos", ("rubros",), _productos_sql(False))
_cte("productos_src", (), _productos_sql(True))


def _pedidos_sql(dirty: bool) -> str:
    client = "o_custkey + 100" if dirty else "o_custkey"
    return f"""
SELECT o_orderkey AS ID_TomaPedido, {client} AS ID_Cliente, o_orderdate AS Fecha,
  o_orderdate + INTERVAL 7 DAY AS FechaEntrega,
  CAST(o_orderkey % 7 + 1 AS INTEGER) AS ID_Condicion,
  CAST(o_totalprice AS DECIMAL(18,2)) AS Total,
  CAST(o_totalprice AS DECIMAL(18,2)) AS Apagar,
  CAST(0 AS DECIMAL(18,2)) AS Dto, CAST(0 AS DECIMAL(18,2)) AS CtaCte,
  o_orderstatus AS Estado,
  CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderpriority END AS Observaciones,
  CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 3 = 1 THEN 0 END AS SMALLINT) AS bDeposito,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 27 + 1 AS INTEGER) END AS ID_Repartidor,
  'A' AS Letra, 1 AS ID_Comprobante,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 40 + 1 AS INTEGER) END AS ID_Empleado,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS DOUBLE) / 4 END AS PorcentajeDto
FROM orders"""


_cte("pedidos", (), _pedidos_sql(False))
_cte("pedidos_src", (), _pedidos_sql(True))


def _detalle_sql(fractional: bool) -> str:
    qty = "CAST(l_quantity AS DECIMAL(18,2))"
    if fractional:
        qty = f"CAST(CASE WHEN l_linenumber = 1 THEN {qty} + 0.5 ELSE {qty} END AS DECIMAL(18,2))"
    return f"""
SELECT l_orderkey AS ID_TomaPedido, l_partkey AS ID_Producto,
  {qty} AS Cantidad,
  {UNIT_PRICE_SQL} AS PrecioUnitario,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS ImporteconDto,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 0.21 AS DECIMAL(18,4)) AS IVA,
  CAST(0 AS DECIMAL(18,2)) AS RestoIVA, CAST(0 AS DECIMAL(18,2)) AS Dto,
  {LINE_EXTRAS}
FROM lineitem"""


_cte("detalle", (), _detalle_sql(False))
_cte("detalle_frac", (), _detalle_sql(True))

_cte("detalle_items", (), f"""
SELECT l_orderkey AS ID_TomaPedido, l_partkey AS ID_Producto,
  CAST(l_quantity AS DECIMAL(18,2)) AS Cantidad,
  {UNIT_PRICE_SQL} AS PrecioUnitario,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS ImporteconDto,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 0.21 AS DECIMAL(18,4)) AS IVA,
  CAST(0 AS DECIMAL(18,2)) AS RestoIVA, CAST(0 AS DECIMAL(18,2)) AS Dto,
  printf('%02d', CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER_SQL}) AS INTEGER)) AS Item,
  {LINE_EXTRAS}
FROM lineitem""")

_cte("request_headers", (), """
SELECT o_orderkey + away AS request_id,
  CAST(NULL AS BIGINT) AS order_id,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN o_custkey + 1000000000 ELSE o_custkey END AS client_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'deposito' ELSE 'por reparto' END AS delivery_type,
  CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderdate + INTERVAL 3 DAY END AS delivery_date,
  CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN 9999
    ELSE CAST(o_orderkey % 10 + 1 AS INTEGER) END AS repartidor_id,
  CAST(NULL AS VARCHAR) AS status
FROM orders, unnest(CASE WHEN o_orderkey % 37 = 0 THEN [0, 0] WHEN o_orderkey % 19 = 0 THEN [0, 10000000000] ELSE [0] END) AS s(away)""")

_cte("request_items", (), f"""
SELECT request_id, pos,
  CASE WHEN request_id % 23 = 0 AND pos = 1 THEN l_partkey + 1000000000 ELSE l_partkey END AS product_id,
  CAST(l_quantity AS DECIMAL(18,2)) AS quantity,
  CAST(CASE WHEN pos % 2 = 0 THEN NULL WHEN pos % 5 = 0 THEN 0 ELSE {UNIT_PRICE_SQL} END AS DECIMAL(18,2))
    AS unit_price
FROM (
  SELECT l.*, l.l_orderkey AS request_id,
    row_number() OVER (PARTITION BY l.l_orderkey ORDER BY {LINE_ORDER_SQL}) AS pos
  FROM lineitem l
)""")

_cte("edit_headers", ("request_headers",),
     """
SELECT sign * request_id AS request_id, CASE WHEN sign = -1 AND request_id % 41 <> 0 THEN NULL ELSE request_id % 10000000000 END AS order_id,
  client_id, delivery_type, delivery_date, repartidor_id, status
FROM request_headers, unnest(CASE WHEN request_id % 41 = 0 OR request_id % 43 = 0 THEN [1, -1] ELSE [1] END) AS s(sign)""")
_cte("edit_items", ("request_items",), "SELECT * FROM request_items")

_cte("order_log", ("request_headers",), """
SELECT request_id * 2 AS request_id, CASE WHEN k % 4 < 2 THEN 'POST' ELSE 'PUT' END AS method,
  CASE k % 8 WHEN 2 THEN k - 2 WHEN 6 THEN k - 6 END AS order_id,
  CASE WHEN k % 4 = 3 THEN (k - 3) * 2 END AS created_by, client_id, delivery_type, delivery_date, repartidor_id, status
FROM (SELECT *, request_id % 10000000000 AS k FROM request_headers)
UNION ALL
SELECT o_orderkey * 2 + 1, 'PUT', CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey END,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 2 END, NULL, NULL, NULL, NULL, 'Entregado'
FROM orders WHERE o_orderkey % 5 = 0""")
_cte("order_log_items", ("request_items",), "SELECT * REPLACE (request_id * 2 AS request_id) FROM request_items")
_cte("edit_log", ("edit_headers",), """
SELECT request_id, 'PUT' AS method, order_id, CAST(NULL AS BIGINT) AS created_by, client_id, delivery_type, delivery_date,
  repartidor_id, CAST(NULL AS VARCHAR) AS status FROM edit_headers""")


def _resolve(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in CTES[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_tables(body: str, *names: str, extra: list[tuple[str, str]] | None = None, once: tuple[str, ...] = ()) -> str:
    """``WITH <fixture CTEs>, <extra CTEs> <body>``; the extra ones in ``once`` are materialized."""
    parts = [f"{n} AS ({CTES[n][1]}\n)" for n in _resolve(names)]
    parts += [f"{n} AS {'MATERIALIZED ' if n in once else ''}({b}\n)" for n, b in (extra or [])]
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body


# ---- change tables (shared expression text, see bodega.sources.change_fixtures) ----
KEY_SQL_TYPE = {"productos": "BIGINT", "clientes": "BIGINT", "proveedores": "BIGINT",
                "marca": "INTEGER", "rubros": "INTEGER", "repartidores": "INTEGER"}


def _change_cte(table: str) -> str:
    from bodega.sources.change_fixtures import ALTER, FIELDS, KEYS
    key = KEYS[table]
    cols = ",\n  ".join(f"{ALTER[table].get(c, c)} AS {c}" for c in FIELDS[table])
    return f"""
SELECT CAST(CASE WHEN _v = 3 THEN _k + (SELECT max({key}) FROM {table}) + 1 ELSE _k END AS {KEY_SQL_TYPE[table]})
    AS {key},
  CAST(_k * 10 + _v AS BIGINT) AS change_seq,
  {cols}
FROM (SELECT b.*, b.{key} AS _k, 1 AS _v FROM {table} b
      UNION ALL
      SELECT b.*, b.{key} AS _k, 2 AS _v FROM {table} b WHERE b.{key} % 7 = 0
      UNION ALL
      SELECT b.*, b.{key} AS _k, 3 AS _v FROM {table} b
      WHERE b.{key} % 50 = 0 OR b.{key} = (SELECT max({key}) FROM {table}))"""


for _t in KEY_SQL_TYPE:
    _cte(f"{_t}_changes", (_t,), _change_cte(_t))


def _roster_cte() -> str:
    from bodega.sources.change_fixtures import ROSTER_SQL
    cols = ",\n  ".join(f"{e.replace('TIMESTAMP_NTZ', 'TIMESTAMP')} AS {c}" for c, e in ROSTER_SQL.items())
    return f"SELECT {cols} FROM nation"


_cte("driver_roster", (), _roster_cte())

"""Registered listings and lookups.

Lookups are asked for every order, and otherwise for every key that another
table refers to (every product sold, every client with orders, ...), so the
work grows with the data and unknown keys are exercised too.
"""
from __future__ import annotations

from bodega.operators import listings as L
from bodega.plans.fixture_sql import with_tables
from bodega.plans.registry import register

# ---- L1-L4 ----------------------------------------------------------------
# The list oracles look names up per key: one small lookup per dimension, keyed by
# the list's own key column, joined with USING in the order of the keys.
ORDER_LIST_SQL = with_tables("""
SELECT id, order_type, client_id, client_name, client_direccion, client_numero, client_telefono, created_at,
  delivery_date, total_amount, status, discount, notes, delivery_type, repartidor_id, repartidor_name
FROM head LEFT JOIN who USING (client_id) LEFT JOIN driver USING (repartidor_id)
ORDER BY created_at DESC, id""", "pedidos", "clientes", "repartidores", extra=[
    ("head", """SELECT ID_TomaPedido AS id, 'client' AS order_type, ID_Cliente AS client_id, Fecha AS created_at,
  FechaEntrega AS delivery_date, CAST(Total AS DOUBLE) AS total_amount, Estado AS status, CAST(Dto AS DOUBLE) AS discount,
  Observaciones AS notes, CASE WHEN bDeposito = 1 THEN 'deposito' ELSE 'por reparto' END AS delivery_type,
  ID_Repartidor AS repartidor_id FROM pedidos"""),
    ("who", """SELECT ID_Cliente AS client_id, Nombre || ' ' || coalesce(Apellido, '') AS client_name,
  rtrim(Direccion) AS client_direccion, rtrim(Numero) AS client_numero, rtrim(Telefono) AS client_telefono FROM clientes"""),
    ("driver", """SELECT ID_Repartidor AS repartidor_id,
  rtrim(Nombre) || ' ' || coalesce(rtrim(Apellido), '') AS repartidor_name FROM repartidores""")])


@register("order_list", ORDER_LIST_SQL)
def order_list(fx):
    return L.order_list(fx.tables("pedidos", "clientes", "repartidores"))


def _order_ids(fx):
    return fx.pedidos.select("ID_TomaPedido")


ORDER_HEADER_SQL = with_tables("""
SELECT tp.ID_TomaPedido AS id, 'client' AS order_type, tp.ID_Cliente AS client_id,
  c.Nombre || ' ' || coalesce(c.Apellido, '') AS client_name,
  tp.Fecha AS created_at, CAST(tp.Total AS DOUBLE) AS total_amount, tp.Estado AS status
FROM pedidos tp LEFT JOIN clientes c ON tp.ID_Cliente = c.ID_Cliente""", "pedidos", "clientes")


@register("order_header", ORDER_HEADER_SQL)
def order_header(fx):
    return L.order_header(fx.tables("pedidos", "clientes"), _order_ids(fx))


ORDER_ITEMS_SQL = with_tables("""
SELECT dt.ID_TomaPedido AS order_id, dt.ID_Producto AS product_id, p.Descripcion AS name, p.Pr_Ean13 AS sku,
  CAST(dt.Cantidad AS DOUBLE) AS quantity, CAST(dt.PrecioUnitario AS DOUBLE) AS unit_price
FROM detalle dt LEFT JOIN productos p ON dt.ID_Producto = p.ID_Producto
WHERE dt.ID_TomaPedido IN (SELECT ID_TomaPedido FROM pedidos)""", "detalle", "productos", "pedidos")


@register("order_items", ORDER_ITEMS_SQL)
def order_items(fx):
    return L.order_items(fx.tables("detalle", "productos"), _order_ids(fx))


@register("order_document")
def order_document(fx):
    return L.order_document(fx.tables("pedidos", "clientes", "detalle", "productos"), _order_ids(fx))


@register("order_document_json", with_tables("""
SELECT tp.ID_TomaPedido AS id, to_json({'id': tp.ID_TomaPedido, 'order_type': 'client', 'client_id': tp.ID_Cliente,
  'client_name': c.Nombre || ' ' || coalesce(c.Apellido, ''), 'created_at': strftime(tp.Fecha, '%Y-%m-%d %H:%M:%S'),
  'total_amount': CAST(tp.Total AS DOUBLE), 'status': tp.Estado,
  'items': coalesce(it.items, [])})::VARCHAR AS document
FROM pedidos tp LEFT JOIN clientes c ON tp.ID_Cliente = c.ID_Cliente
LEFT JOIN (SELECT dt.ID_TomaPedido, list({'product_id': dt.ID_Producto, 'name': p.Descripcion, 'sku': p.Pr_Ean13,
     'quantity': CAST(dt.Cantidad AS DOUBLE), 'unit_price': CAST(dt.PrecioUnitario AS DOUBLE)}
     ORDER BY dt.ID_Producto, p.Descripcion, p.Pr_Ean13, dt.Cantidad, dt.PrecioUnitario) AS items
   FROM detalle dt LEFT JOIN productos p ON dt.ID_Producto = p.ID_Producto GROUP BY dt.ID_TomaPedido) it
  ON tp.ID_TomaPedido = it.ID_TomaPedido""", "pedidos", "clientes", "detalle", "productos"))
def order_document_json(fx):
    """L4 + E12: the order document as the JSON reply body."""
    return L.order_document_json(fx.tables("pedidos", "clientes", "detalle", "productos"), _order_ids(fx))


# ---- L5-L6 ----------------------------------------------------------------
PRODUCT_LIST_SQL = with_tables("""
SELECT ID_Producto AS id, Descripcion AS name, Pr_Ean13 AS sku, CAST(PrecioFinalUni AS DOUBLE) AS price, Stock AS stock,
  provider_id, provider_name, rubro_id, rubro_name, marca_id, marca_name,
  IdAlicIva AS alicuota_id, AlicIva_desc AS alicuota_desc,
  COLUMNS(['Costo', 'CostoUnit', 'margen', 'PrecioFinalPack', 'PrecioNetoPack', 'PrecioNetoUni', 'MontoIVA'])::DOUBLE,
  PMR, Pr_Pack, Pr_UniXPack, Estado, OcultarApp, SinStockApp, PermiteDescuento AS permite_descuento
FROM (SELECT *, ID_Proveedor AS provider_id, ID_Rubro AS rubro_id, idMarca AS marca_id FROM productos)
  LEFT JOIN provider USING (provider_id) LEFT JOIN category USING (rubro_id) LEFT JOIN brand USING (marca_id)
ORDER BY id""", "productos", "proveedores", "rubros", "marca", extra=[
    ("provider", "SELECT ID_Proveedor AS provider_id, RazonSocial AS provider_name FROM proveedores"),
    ("category", "SELECT ID_Rubro AS rubro_id, Descripcion AS rubro_name FROM rubros"),
    ("brand", "SELECT Id_Marca AS marca_id, Mrc_Descripcion AS marca_name FROM marca")])


@register("product_list", PRODUCT_LIST_SQL)
def product_list(fx):
    return L.product_list(fx.tables("productos", "proveedores", "rubros", "marca"))


PRODUCT_GET_SQL = with_tables("""
SELECT p.ID_Producto AS id, p.Descripcion AS name, p.Pr_Ean13 AS sku, CAST(p.PrecioFinalUni AS DOUBLE) AS price,
  p.Stock AS stock, p.ID_Proveedor AS provider_id, p.ID_Rubro AS rubro_id, p.idMarca AS marca_id,
  p.IdAlicIva AS alicuota_id,
  p.ID_Producto, p.Descripcion, p.Pr_Ean13, CAST(p.PrecioFinalUni AS DOUBLE) AS PrecioFinalUni,
  p.ID_Proveedor, p.ID_Rubro, p.idMarca, p.IdAlicIva, p.AlicIva_desc,
  CAST(p.Costo AS DOUBLE) AS Costo, CAST(p.CostoUnit AS DOUBLE) AS CostoUnit, CAST(p.margen AS DOUBLE) AS margen,
  CAST(p.PrecioFinalPack AS DOUBLE) AS PrecioFinalPack, CAST(p.PrecioNetoPack AS DOUBLE) AS PrecioNetoPack,
  CAST(p.PrecioNetoUni AS DOUBLE) AS PrecioNetoUni, CAST(p.MontoIVA AS DOUBLE) AS MontoIVA,
  p.PMR, p.Pr_Pack, p.Pr_UniXPack, p.Estado, p.OcultarApp, p.SinStockApp, p.PermiteDescuento,
  p.MarcaDesc, p.Pr_CodOrigen, CAST(p.Pr_UnidMinVenta AS DOUBLE) AS Pr_UnidMinVenta, p.Enviado
FROM productos p
WHERE p.ID_Producto IN (SELECT ID_Producto FROM detalle)""", "productos", "detalle")


@register("product_get", PRODUCT_GET_SQL)
def product_get(fx):
    return L.product_get(fx.tables("productos"), fx.detalle.select("ID_Producto"))


# ---- L7-L10 ---------------------------------------------------------------
PLACE_NAMES = [
    ("district", "SELECT ID_Barrio AS id_barrio, rtrim(Nombre) AS barrio_nombre FROM barrios"),
    ("town", "SELECT ID_Localidad AS id_localidad, rtrim(Nombre) AS localidad_nombre FROM localidad"),
    ("terms", "SELECT ID_CondicionPago AS id_condicion, rtrim(Descripcion) AS condicion_pago FROM condicion_pago"),
]

CLIENT_LIST_SQL = with_tables("""
SELECT id, razon_social, apellido, nombre, direccion, numero, telefono, cuit, correo, id_barrio, barrio_nombre,
  id_localidad, localidad_nombre, id_zona, zona_nombre, id_condicion, condicion_pago, estado
FROM own LEFT JOIN district USING (id_barrio) LEFT JOIN town USING (id_localidad)
  LEFT JOIN zone USING (id_zona) LEFT JOIN terms USING (id_condicion)
ORDER BY id DESC""", "clientes", "barrios", "localidad", "zona", "condicion_pago", extra=PLACE_NAMES + [
    ("zone", "SELECT ID_Zona AS id_zona, rtrim(Descripcion) AS zona_nombre FROM zona"),
    ("own", """SELECT ID_Cliente AS id, rtrim(RazonSocial) AS razon_social, rtrim(Apellido) AS apellido, rtrim(Nombre) AS nombre,
  rtrim(Direccion) AS direccion, rtrim(Numero) AS numero, rtrim(Telefono) AS telefono, rtrim(CUIT) AS cuit, rtrim(correo) AS correo,
  ID_Barrio AS id_barrio, ID_Localidad AS id_localidad, ID_Zona AS id_zona, id_condicion, rtrim(Estado) AS estado FROM clientes""")])

CLIENT_DIMS = ("clientes", "barrios", "localidad", "zona", "condicion_pago")


@register("client_list", CLIENT_LIST_SQL)
def client_list(fx):
    return L.client_list(fx.tables(*CLIENT_DIMS))


CLIENT_GET_SQL = with_tables("""
SELECT c.*, rtrim(b.Nombre) AS barrio_nombre, rtrim(l.Nombre) AS localidad_nombre,
  rtrim(z.Descripcion) AS zona_nombre, rtrim(cp.Descripcion) AS condicion_pago
FROM clientes c
LEFT JOIN barrios b ON c.ID_Barrio = b.ID_Barrio
LEFT JOIN localidad l ON c.ID_Localidad = l.ID_Localidad
LEFT JOIN zona z ON c.ID_Zona = z.ID_Zona
LEFT JOIN condicion_pago cp ON c.id_condicion = cp.ID_CondicionPago
WHERE c.ID_Cliente IN (SELECT ID_Cliente FROM pedidos)""", *CLIENT_DIMS, "pedidos")


@register("client_get", CLIENT_GET_SQL)
def client_get(fx):
    return L.client_get(fx.tables(*CLIENT_DIMS), fx.pedidos.select("ID_Cliente"))


PROVIDER_DIMS = ("proveedores", "condicion_pago", "barrios", "localidad")

PROVIDER_LIST_SQL = with_tables("""
SELECT id, razon_social, direccion, numero, telefono, cuit, correo, id_condicion, condicion_pago, id_barrio,
  barrio_nombre, id_localidad, localidad_nombre, estado
FROM own LEFT JOIN terms USING (id_condicion) LEFT JOIN district USING (id_barrio) LEFT JOIN town USING (id_localidad)
ORDER BY id DESC""", *PROVIDER_DIMS, extra=PLACE_NAMES + [
    ("own", """SELECT ID_Proveedor AS id, rtrim(RazonSocial) AS razon_social, rtrim(Direccion) AS direccion, rtrim(Numero) AS numero,
  rtrim(Telefono) AS telefono, rtrim(CUIT) AS cuit, rtrim(Correo) AS correo, ID_Condicion AS id_condicion, Barrio AS id_barrio,
  Localidad AS id_localidad, rtrim(Estado) AS estado FROM proveedores""")])


@register("provider_list", PROVIDER_LIST_SQL)
def provider_list(fx):
    return L.provider_list(fx.tables(*PROVIDER_DIMS))


PROVIDER_GET_SQL = with_tables("""
SELECT p.*, rtrim(cp.Descripcion) AS condicion_pago, rtrim(b.Nombre) AS barrio_nombre,
  rtrim(l.Nombre) AS localidad_nombre
FROM proveedores p
LEFT JOIN condicion_pago cp ON p.ID_Condicion = cp.ID_CondicionPago
LEFT JOIN barrios b ON p.Barrio = b.ID_Barrio
LEFT JOIN localidad l ON p.Localidad = l.ID_Localidad
WHERE p.ID_Proveedor IN (SELECT ID_Proveedor FROM productos)""", *PROVIDER_DIMS, "productos")


@register("provider_get", PROVIDER_GET_SQL)
def provider_get(fx):
    return L.provider_get(fx.tables(*PROVIDER_DIMS), fx.productos.select("ID_Proveedor"))


# ---- L11-L20 --------------------------------------------------------------
@register("brand_list", with_tables(
    "SELECT Id_Marca AS id_marca, rtrim(Mrc_Descripcion) AS descripcion FROM marca "
    "ORDER BY Mrc_Descripcion, id_marca", "marca"))
def brand_list(fx):
    return L.brand_list(fx.tables("marca"))


@register("brands_by_category", with_tables("""
SELECT DISTINCT p.ID_Rubro AS rubro_id, m.Id_Marca AS id_marca, rtrim(m.Mrc_Descripcion) AS descripcion
FROM marca m JOIN productos p ON m.Id_Marca = p.idMarca
ORDER BY rubro_id, descripcion, id_marca""", "marca", "productos"))
def brands_by_category(fx):
    return L.brands_by_category(fx.tables("productos", "marca"))


@register("category_list", with_tables(
    "SELECT ID_Rubro AS id_rubro, rtrim(Descripcion) AS descripcion FROM rubros ORDER BY ID_Rubro", "rubros"))
def category_list(fx):
    return L.category_list(fx.tables("rubros"))


@register("category_get", with_tables(
    "SELECT ID_Rubro AS id_rubro, rtrim(Descripcion) AS descripcion FROM rubros "
    "WHERE ID_Rubro IN (SELECT ID_Rubro FROM productos)", "rubros", "productos"))
def category_get(fx):
    return L.category_get(fx.tables("rubros"), fx.productos.select("ID_Rubro"))


@register("town_list", with_tables(
    "SELECT ID_Localidad AS id, rtrim(Nombre) AS nombre FROM localidad ORDER BY Nombre, id", "localidad"))
def town_list(fx):
    return L.town_list(fx.tables("localidad"))


@register("zone_list", with_tables(
    "SELECT ID_Zona AS id, rtrim(Descripcion) AS descripcion FROM zona ORDER BY Descripcion, id", "zona"))
def zone_list(fx):
    return L.zone_list(fx.tables("zona"))


@register("district_list", with_tables(
    "SELECT ID_Barrio AS id, rtrim(Nombre) AS nombre FROM barrios ORDER BY Nombre, id", "barrios"))
def district_list(fx):
    return L.district_list(fx.tables("barrios"))


@register("payment_terms_list", with_tables(
    "SELECT ID_CondicionPago AS id, rtrim(Descripcion) AS descripcion FROM condicion_pago "
    "ORDER BY Descripcion, id", "condicion_pago"))
def payment_terms_list(fx):
    return L.payment_terms_list(fx.tables("condicion_pago"))


DRIVER_COLS_SQL = """ID_Repartidor AS id, rtrim(Nombre) AS nombre, rtrim(Apellido) AS apellido, rtrim(DNI) AS dni,
  rtrim(Telefono) AS telefono, rtrim(Direccion) AS direccion, rtrim(Email) AS email, FechaIngreso AS fecha_ingreso,
  rtrim(Estado) AS estado, rtrim(Observaciones) AS observaciones, rtrim(LicenciaConducir) AS licencia_conducir,
  VencimientoLicencia AS vencimiento_licencia, CreatedAt AS created_at, UpdatedAt AS updated_at"""


@register("driver_list", with_tables(f"SELECT {DRIVER_COLS_SQL} FROM repartidores ORDER BY ID_Repartidor DESC",
                                     "repartidores"))
def driver_list(fx):
    return L.driver_list(fx.tables("repartidores"))


@register("driver_get", with_tables(
    f"SELECT {DRIVER_COLS_SQL} FROM repartidores WHERE ID_Repartidor IN (SELECT ID_Repartidor FROM pedidos)",
    "repartidores", "pedidos"))
def driver_get(fx):
    return L.driver_get(fx.tables("repartidores"), fx.pedidos.select("ID_Repartidor"))

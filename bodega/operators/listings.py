"""Denormalised listings and lookups.

Lookups take a DataFrame of keys instead of one id, and keep the matching
rows with a semi-join; so one plan answers any number of ids. Dimension
joins are plain left joins: the planner broadcasts a side only when its
measured size is under the broadcast threshold, else it shuffles both.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from bodega.functions.exprs import ORDER_TYPE, delivery_type, full_name, trimmed_full_name


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Money leaves as DOUBLE (the reference stores REAL/FLOAT)."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
                       else F.col(f.name) for f in df.schema.fields])


def _semi(df: DataFrame, ids: DataFrame | None, key: str) -> DataFrame:
    return df if ids is None else df.join(ids.select(key).distinct(), key, "left_semi")


def _dim(df: DataFrame, dim: DataFrame, left_key: str, right_key: str, cols: dict[str, Column]) -> DataFrame:
    """Left join one dimension, bringing ``cols`` (name -> expression over the dim)."""
    d = dim.select(F.col(right_key).alias(f"_k_{left_key}"), *[e.alias(n) for n, e in cols.items()])
    return df.join(d, df[left_key] == d[f"_k_{left_key}"], "left").drop(f"_k_{left_key}")


# ---- orders ---------------------------------------------------------------
def order_list(d: dict) -> DataFrame:
    """L1: every order with client, driver and delivery type, newest first."""
    tp = d["pedidos"]
    tp = _dim(tp, d["clientes"], "ID_Cliente", "ID_Cliente", {
        "client_name": full_name(F.col("Nombre"), F.col("Apellido")),
        "client_direccion": F.rtrim("Direccion"),
        "client_numero": F.rtrim("Numero"),
        "client_telefono": F.rtrim("Telefono"),
    })
    tp = _dim(tp, d["repartidores"], "ID_Repartidor", "ID_Repartidor", {
        "repartidor_name": trimmed_full_name(F.col("Nombre"), F.col("Apellido")),
    })
    out = tp.select(
        F.col("ID_TomaPedido").alias("id"),
        F.lit(ORDER_TYPE).alias("order_type"),
        F.col("ID_Cliente").alias("client_id"),
        "client_name", "client_direccion", "client_numero", "client_telefono",
        F.col("Fecha").alias("created_at"),
        F.col("FechaEntrega").alias("delivery_date"),
        F.col("Total").cast("double").alias("total_amount"),
        F.col("Estado").alias("status"),
        F.col("Dto").cast("double").alias("discount"),
        F.col("Observaciones").alias("notes"),
        delivery_type(F.col("bDeposito")).alias("delivery_type"),
        F.col("ID_Repartidor").alias("repartidor_id"),
        "repartidor_name",
    )
    return out.orderBy(F.col("created_at").desc(), F.col("id"))


def order_header(d: dict, ids: DataFrame | None) -> DataFrame:
    """L2: header of each order in ``ids`` (column ``ID_TomaPedido``)."""
    tp = _semi(d["pedidos"], ids, "ID_TomaPedido")
    tp = _dim(tp, d["clientes"], "ID_Cliente", "ID_Cliente",
              {"client_name": full_name(F.col("Nombre"), F.col("Apellido"))})
    return tp.select(
        F.col("ID_TomaPedido").alias("id"),
        F.lit(ORDER_TYPE).alias("order_type"),
        F.col("ID_Cliente").alias("client_id"),
        "client_name",
        F.col("Fecha").alias("created_at"),
        F.col("Total").cast("double").alias("total_amount"),
        F.col("Estado").alias("status"),
    )


def order_items(d: dict, ids: DataFrame | None) -> DataFrame:
    """L3: lines of the orders in ``ids``; a line whose product is gone keeps NULL names."""
    dt = _semi(d["detalle"], ids, "ID_TomaPedido")
    dt = _dim(dt, d["productos"], "ID_Producto", "ID_Producto",
              {"name": F.col("Descripcion"), "sku": F.col("Pr_Ean13")})
    return dt.select(
        F.col("ID_TomaPedido").alias("order_id"),
        F.col("ID_Producto").alias("product_id"),
        "name", "sku",
        F.col("Cantidad").cast("double").alias("quantity"),
        F.col("PrecioUnitario").cast("double").alias("unit_price"),
    )


def order_document(d: dict, ids: DataFrame | None) -> DataFrame:
    """L4: header with its lines nested as ``items`` (sorted by product)."""
    head = order_header(d, ids)
    items = order_items(d, ids)
    nested = items.groupBy("order_id").agg(F.sort_array(F.collect_list(
        F.struct("product_id", "name", "sku", "quantity", "unit_price"))).alias("items"))
    doc = head.join(nested, head["id"] == nested["order_id"], "left").drop("order_id")
    empty = F.array().cast(nested.schema["items"].dataType)
    return doc.withColumn("items", F.coalesce(F.col("items"), empty))


def order_document_json(d: dict, ids: DataFrame | None) -> DataFrame:
    """L4 as the reply body: one JSON document per order (``id``, ``document``),
    NULL fields kept, times as 'yyyy-MM-dd HH:mm:ss'."""
    doc = order_document(d, ids)
    body = F.struct("id", "order_type", "client_id", "client_name",
                    F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
                    "total_amount", "status", "items")
    return doc.select("id", F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))


# ---- products ---------------------------------------------------------------
PRODUCT_TAIL = ["Costo", "CostoUnit", "margen", "PrecioFinalPack", "PrecioNetoPack", "PrecioNetoUni",
                "MontoIVA", "PMR", "Pr_Pack", "Pr_UniXPack", "Estado", "OcultarApp", "SinStockApp"]


def product_list(d: dict) -> DataFrame:
    """Products with provider, category and brand names, by id."""
    p = d["productos"]
    p = _dim(p, d["proveedores"], "ID_Proveedor", "ID_Proveedor", {"provider_name": F.col("RazonSocial")})
    p = _dim(p, d["rubros"], "ID_Rubro", "ID_Rubro", {"rubro_name": F.col("Descripcion")})
    p = _dim(p, d["marca"], "idMarca", "Id_Marca", {"marca_name": F.col("Mrc_Descripcion")})
    out = p.select(
        F.col("ID_Producto").alias("id"), F.col("Descripcion").alias("name"), F.col("Pr_Ean13").alias("sku"),
        F.col("PrecioFinalUni").alias("price"), F.col("Stock").alias("stock"),
        F.col("ID_Proveedor").alias("provider_id"), "provider_name",
        F.col("ID_Rubro").alias("rubro_id"), "rubro_name",
        F.col("idMarca").alias("marca_id"), "marca_name",
        F.col("IdAlicIva").alias("alicuota_id"), F.col("AlicIva_desc").alias("alicuota_desc"),
        *PRODUCT_TAIL,
        F.col("PermiteDescuento").alias("permite_descuento"),
    )
    return decimals_to_double(out).orderBy("id")


def product_get(d: dict, ids: DataFrame | None) -> DataFrame:
    """Aliases plus every product column; ``Stock`` appears once, as ``stock``
    (column names are case-insensitive, so both would clash)."""
    p = _semi(d["productos"], ids, "ID_Producto")
    aliases = [F.col("ID_Producto").alias("id"), F.col("Descripcion").alias("name"),
               F.col("Pr_Ean13").alias("sku"), F.col("PrecioFinalUni").alias("price"),
               F.col("Stock").alias("stock"), F.col("ID_Proveedor").alias("provider_id"),
               F.col("ID_Rubro").alias("rubro_id"), F.col("idMarca").alias("marca_id"),
               F.col("IdAlicIva").alias("alicuota_id")]
    rest = [c for c in p.columns if c.lower() != "stock"]
    return decimals_to_double(p.select(*aliases, *rest))


# ---- clients and providers ------------------------------------------------
def _client_dims(c: DataFrame, d: dict) -> DataFrame:
    c = _dim(c, d["barrios"], "ID_Barrio", "ID_Barrio", {"barrio_nombre": F.rtrim("Nombre")})
    c = _dim(c, d["localidad"], "ID_Localidad", "ID_Localidad", {"localidad_nombre": F.rtrim("Nombre")})
    c = _dim(c, d["zona"], "ID_Zona", "ID_Zona", {"zona_nombre": F.rtrim("Descripcion")})
    return _dim(c, d["condicion_pago"], "id_condicion", "ID_CondicionPago",
                {"condicion_pago": F.rtrim("Descripcion")})


def client_list(d: dict) -> DataFrame:
    """Clients, trimmed, with district, town, zone and payment terms; id desc."""
    c = _client_dims(d["clientes"], d)
    out = c.select(
        F.col("ID_Cliente").alias("id"),
        F.rtrim("RazonSocial").alias("razon_social"), F.rtrim("Apellido").alias("apellido"),
        F.rtrim("Nombre").alias("nombre"), F.rtrim("Direccion").alias("direccion"),
        F.rtrim("Numero").alias("numero"), F.rtrim("Telefono").alias("telefono"),
        F.rtrim("CUIT").alias("cuit"), F.rtrim("correo").alias("correo"),
        F.col("ID_Barrio").alias("id_barrio"), "barrio_nombre",
        F.col("ID_Localidad").alias("id_localidad"), "localidad_nombre",
        F.col("ID_Zona").alias("id_zona"), "zona_nombre",
        F.col("id_condicion"), "condicion_pago", F.rtrim("Estado").alias("estado"),
    )
    return out.orderBy(F.col("id").desc())


def client_get(d: dict, ids: DataFrame | None) -> DataFrame:
    """All client columns (untrimmed) plus the four names."""
    c = _semi(d["clientes"], ids, "ID_Cliente")
    cols = d["clientes"].columns
    return _client_dims(c, d).select(*cols, "barrio_nombre", "localidad_nombre", "zona_nombre", "condicion_pago")


def _provider_dims(p: DataFrame, d: dict) -> DataFrame:
    p = _dim(p, d["condicion_pago"], "ID_Condicion", "ID_CondicionPago", {"condicion_pago": F.rtrim("Descripcion")})
    p = _dim(p, d["barrios"], "Barrio", "ID_Barrio", {"barrio_nombre": F.rtrim("Nombre")})
    return _dim(p, d["localidad"], "Localidad", "ID_Localidad", {"localidad_nombre": F.rtrim("Nombre")})


def provider_list(d: dict) -> DataFrame:
    """Providers, trimmed, with payment terms, district and town; id desc."""
    p = _provider_dims(d["proveedores"], d)
    out = p.select(
        F.col("ID_Proveedor").alias("id"),
        F.rtrim("RazonSocial").alias("razon_social"), F.rtrim("Direccion").alias("direccion"),
        F.rtrim("Numero").alias("numero"), F.rtrim("Telefono").alias("telefono"),
        F.rtrim("CUIT").alias("cuit"), F.rtrim("Correo").alias("correo"),
        F.col("ID_Condicion").alias("id_condicion"), "condicion_pago",
        F.col("Barrio").alias("id_barrio"), "barrio_nombre",
        F.col("Localidad").alias("id_localidad"), "localidad_nombre",
        F.rtrim("Estado").alias("estado"),
    )
    return out.orderBy(F.col("id").desc())


def provider_get(d: dict, ids: DataFrame | None) -> DataFrame:
    """All provider columns plus three names."""
    p = _semi(d["proveedores"], ids, "ID_Proveedor")
    cols = d["proveedores"].columns
    return _provider_dims(p, d).select(*cols, "condicion_pago", "barrio_nombre", "localidad_nombre")


# ---- small catalogs -------------------------------------------------------
def brand_list(d: dict, collation: str | None = None) -> DataFrame:
    """Brands, trimmed, by name."""
    return _catalog(d["marca"], "Id_Marca", "Mrc_Descripcion", "id_marca", "descripcion", collation)


def brands_by_category(d: dict, rubro_ids: DataFrame | None = None) -> DataFrame:
    """Per category, the distinct brands having a product in it.

    The pairs are made distinct on the product side first (partial
    aggregation, so a category with a third of all products is combined
    before the shuffle); the brand join then sees one row per pair."""
    p = d["productos"].where(F.col("idMarca").isNotNull())
    if rubro_ids is not None:
        p = p.join(rubro_ids.select("ID_Rubro"), "ID_Rubro", "left_semi")
    pairs = p.select("ID_Rubro", F.col("idMarca").alias("Id_Marca")).distinct()
    out = pairs.join(d["marca"], "Id_Marca").select(
        F.col("ID_Rubro").alias("rubro_id"), F.col("Id_Marca").alias("id_marca"),
        F.rtrim("Mrc_Descripcion").alias("descripcion"))
    return out.orderBy("rubro_id", "descripcion", "id_marca")


def category_list(d: dict) -> DataFrame:
    """L13."""
    return d["rubros"].select(F.col("ID_Rubro").alias("id_rubro"),
                              F.rtrim("Descripcion").alias("descripcion")).orderBy("id_rubro")


def category_get(d: dict, ids: DataFrame | None) -> DataFrame:
    """L14."""
    return category_list({"rubros": _semi(d["rubros"], ids, "ID_Rubro")})


def sort_text(c: Column, collation: str | None = None) -> Column:
    """Sort key for text. Default binary order; ``collation`` (e.g.
    'UNICODE_CI_RTRIM', case-insensitive and ignoring trailing blanks, like
    the usual database default) makes the sort follow it."""
    return F.collate(c, collation) if collation else c


def _catalog(df: DataFrame, key: str, text: str, out_key: str, out_text: str,
             collation: str | None = None) -> DataFrame:
    return df.select(F.col(key).alias(out_key), F.rtrim(text).alias(out_text),
                     sort_text(F.col(text), collation).alias("_o")).orderBy("_o", out_key).drop("_o")


def town_list(d: dict, collation: str | None = None) -> DataFrame:
    """L15."""
    return _catalog(d["localidad"], "ID_Localidad", "Nombre", "id", "nombre", collation)


def zone_list(d: dict, collation: str | None = None) -> DataFrame:
    """L16."""
    return _catalog(d["zona"], "ID_Zona", "Descripcion", "id", "descripcion", collation)


def district_list(d: dict, collation: str | None = None) -> DataFrame:
    """L17."""
    return _catalog(d["barrios"], "ID_Barrio", "Nombre", "id", "nombre", collation)


def payment_terms_list(d: dict, collation: str | None = None) -> DataFrame:
    """L18."""
    return _catalog(d["condicion_pago"], "ID_CondicionPago", "Descripcion", "id", "descripcion", collation)


DRIVER_TEXT = ["Nombre", "Apellido", "DNI", "Telefono", "Direccion", "Email"]


def _driver_cols() -> list[Column]:
    return [
        F.col("ID_Repartidor").alias("id"),
        *[F.rtrim(c).alias(c.lower()) for c in DRIVER_TEXT],
        F.col("FechaIngreso").alias("fecha_ingreso"),
        F.rtrim("Estado").alias("estado"),
        F.rtrim("Observaciones").alias("observaciones"),
        F.rtrim("LicenciaConducir").alias("licencia_conducir"),
        F.col("VencimientoLicencia").alias("vencimiento_licencia"),
        F.col("CreatedAt").alias("created_at"),
        F.col("UpdatedAt").alias("updated_at"),
    ]


def driver_list(d: dict) -> DataFrame:
    """Drivers, trimmed, id desc."""
    return d["repartidores"].select(*_driver_cols()).orderBy(F.col("id").desc())


def driver_get(d: dict, ids: DataFrame | None) -> DataFrame:
    """L20."""
    return _semi(d["repartidores"], ids, "ID_Repartidor").select(*_driver_cols())

"""Registered round trips through the sinks and sources.

Each writes a derived table to a fresh folder under the session's shared
checkpoint folder and reads it back with the declared schema; the result
must equal the table it came from.
"""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bodega.operators.listings import decimals_to_double
from bodega.operators.posting import validate_requests
from bodega.plans.fixture_sql import with_tables
from bodega.plans.registry import register
from bodega.session import ensure_checkpoint_dir
from bodega.sources import tables as T


def _scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/bodega-io/{uuid.uuid4().hex}"


PRODUCT_SQL = with_tables("""
SELECT ID_Producto, Descripcion, Pr_Ean13, CAST(PrecioFinalUni AS DOUBLE) AS PrecioFinalUni, Stock, ID_Proveedor,
  ID_Rubro, idMarca, IdAlicIva, AlicIva_desc, CAST(Costo AS DOUBLE) AS Costo, CAST(CostoUnit AS DOUBLE) AS CostoUnit,
  CAST(margen AS DOUBLE) AS margen, CAST(PrecioFinalPack AS DOUBLE) AS PrecioFinalPack,
  CAST(PrecioNetoPack AS DOUBLE) AS PrecioNetoPack, CAST(PrecioNetoUni AS DOUBLE) AS PrecioNetoUni,
  CAST(MontoIVA AS DOUBLE) AS MontoIVA, PMR, Pr_Pack, Pr_UniXPack, Estado, OcultarApp, SinStockApp, PermiteDescuento,
  MarcaDesc, Pr_CodOrigen, CAST(Pr_UnidMinVenta AS DOUBLE) AS Pr_UnidMinVenta, Enviado
FROM productos""", "productos")


@register("typed_scan_roundtrip", PRODUCT_SQL)
def typed_scan_roundtrip(fx):
    """E12 Parquet sink, then E10 typed scan of the written table."""
    root = _scratch(fx.spark)
    T.write_result(fx.productos, f"{root}/productos", fmt="parquet")
    return decimals_to_double(T.open_tables(fx.spark, root, ["productos"])["productos"])


@register("json_requests_roundtrip", with_tables("""
SELECT request_id, pos, product_id, CAST(quantity AS DOUBLE) AS quantity, CAST(unit_price AS DOUBLE) AS unit_price
FROM request_items JOIN request_headers USING (request_id)""", "request_items", "request_headers"))
def json_requests_roundtrip(fx):
    """E12 JSON sink of nested order requests, then E11 read and flatten (a request sent
    twice carries its items twice)."""
    items = fx.request_items.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct(
        "pos", "product_id", F.col("quantity").cast("string").alias("quantity"),
        F.col("unit_price").cast("string").alias("unit_price")))).alias("items"))
    nested = fx.request_headers.join(items, "request_id", "left").withColumn(
        "items", F.expr("transform(items, x -> named_struct('product_id', x.product_id, "
                        "'quantity', x.quantity, 'unit_price', x.unit_price))"))
    path = _scratch(fx.spark)
    T.write_result(nested, path, fmt="json")
    _, flat = T.flatten_requests(T.read_requests(fx.spark, path).where("_corrupt_record IS NULL"))
    return flat.select("request_id", "pos", "product_id",
                       F.col("quantity").try_cast("decimal(18,2)").cast("double").alias("quantity"),
                       F.col("unit_price").try_cast("decimal(18,2)").cast("double").alias("unit_price"))


@register("malformed_requests", with_tables("""
SELECT CAST(NULL AS BIGINT) AS request_id, 'malformed' AS reason, '{"request_id":' || request_id || ',"del' AS body
FROM request_headers WHERE request_id % 11 = 3
UNION ALL SELECT request_id, CASE WHEN client_id IS NULL OR client_id = 0 THEN 'missing_data'
  WHEN delivery_type = 'por reparto' AND (repartidor_id IS NULL OR repartidor_id = 0) THEN 'missing_driver' END, NULL
FROM (SELECT *, count(*) OVER (PARTITION BY request_id) AS sent FROM request_headers WHERE request_id % 11 <> 3)
WHERE sent = 1 AND request_id IN (SELECT request_id FROM request_items)
UNION ALL SELECT request_id, CASE WHEN sent > 1 THEN 'duplicate_request' ELSE 'missing_data' END, NULL
FROM (SELECT *, count(*) OVER (PARTITION BY request_id) AS sent FROM request_headers WHERE request_id % 11 <> 3)
WHERE sent > 1 OR request_id NOT IN (SELECT request_id FROM request_items)""", "request_headers", "request_items"))
def malformed_requests(fx):
    """E11 then P1 over request bodies of which some are cut off: every body is answered,
    the whole ones with the first rule they fail (or none)."""
    items = fx.request_items.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct(
        "pos", "product_id", F.col("quantity").cast("string").alias("quantity"),
        F.col("unit_price").cast("string").alias("unit_price")))).alias("items"))
    bodies = fx.request_headers.drop("order_id", "status").join(items, "request_id", "left").select(
        "request_id", F.to_json(F.struct("request_id", "delivery_type", "client_id", "repartidor_id",
                                         F.expr("transform(items, x -> named_struct('product_id', x.product_id, 'quantity', "
                                                "x.quantity, 'unit_price', x.unit_price))").alias("items"))).alias("body"))
    cut = F.substring_index("body", "ivery_type", 1)
    path = _scratch(fx.spark)
    bodies.select(F.when(F.col("request_id") % 11 == 3, F.substring("body", F.lit(1), F.length(cut))).otherwise(F.col("body")).alias("value")).write.text(path)
    good, bad = T.split_malformed(T.read_requests(fx.spark, path))
    headers, flat = T.flatten_requests(good)
    answered = validate_requests(headers, flat).select("request_id", F.col("reject_reason").alias("reason"), F.lit(None).cast("string").alias("body"))
    return bad.unionByName(answered)

"""Derive the distributor's tables from the generated star-schema test data.

Every derivation here has a twin in DuckDB SQL (``bodega.plans.fixture_sql``);
both use only expressions the two engines share. Tables are built lazily,
so a query scans only the Parquet files and columns it needs.
"""
from __future__ import annotations

import datetime as dt
from decimal import Decimal
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bodega.functions.exprs import add_days
from bodega.functions.sequence import number_rows

# Fixed values of the test fixtures.
AS_OF = dt.datetime(2001, 8, 1, 0, 0, 0)
UNKNOWN_CLIENT_OFFSET = 1_000_000_000
UNKNOWN_DRIVER = 9999
UNKNOWN_PRODUCT_OFFSET = 1_000_000_000
EMPTY_REQUEST_OFFSET = 10_000_000_000
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _s(c):
    return F.col(c).cast("string")


def _dec(c, frac: str):
    return (F.col(c) * F.lit(Decimal(frac))).cast("decimal(18,2)")


def _null_when(cond, value):
    return F.when(cond, F.lit(None)).otherwise(value)


def unit_price_recipe():
    """Unit price from the extended price, floored on cents (exact in both engines)."""
    return (F.floor(F.round(F.col("l_extendedprice") * 100) / F.col("l_quantity")) / 100).cast("decimal(18,2)")


def _line_extras():
    """The optional columns of an order line."""
    flag = F.col("l_returnflag")
    return [F.col("l_linenumber").cast("int").alias("Hoja"),
            F.when(flag == "R", F.lit(1)).when(flag == "N", F.lit(0)).alias("Rechazo"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("Monto"),
            (unit_price_recipe() * F.lit(Decimal("0.6"))).cast("decimal(18,2)").alias("CostoUnit"),
            F.col("l_orderkey").alias("NroPedido")]


class Fixture:
    """The model tables over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: dt.datetime = AS_OF):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.as_of = as_of

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def tables(self, *names: str) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in names}

    # ---- dimensions -------------------------------------------------------
    # The ranked catalogs below number the *distinct* values of a category
    # column (a handful of rows, bounded by the domain, not by the data), so
    # their unpartitioned window sees only that small set.
    @cached_property
    def rubros(self) -> DataFrame:
        types = self.raw("part").select(F.col("p_type").alias("Descripcion")).distinct()
        return types.select(F.row_number().over(Window.orderBy("Descripcion")).cast("int").alias("ID_Rubro"),
                            "Descripcion")

    @cached_property
    def marca(self) -> DataFrame:
        brands = self.raw("part").select(F.col("p_brand").alias("Mrc_Descripcion")).distinct()
        return brands.select(F.substring_index("Mrc_Descripcion", "#", -1).cast("int").alias("Id_Marca"),
                             "Mrc_Descripcion")

    @cached_property
    def alicuotas(self) -> DataFrame:
        """A rate per different tax of the order lines."""
        rates = self.raw("lineitem").select(F.col("l_tax").alias("rate")).distinct()
        return rates.select(F.row_number().over(Window.orderBy("rate")).cast("int").alias("id_alicuota"),
                            F.concat(F.lit("IVA "), F.round(F.col("rate") * 100).cast("int").cast("string"), F.lit("%")).alias("Alic_descripcion"),
                            F.col("rate").cast("float").alias("Alicuota"))

    @cached_property
    def condicion_pago(self) -> DataFrame:
        prio = self.raw("orders").select(F.col("o_orderpriority").alias("Descripcion")).distinct()
        return prio.select(F.row_number().over(Window.orderBy("Descripcion")).cast("int").alias("ID_CondicionPago"),
                           "Descripcion")

    @cached_property
    def localidad(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").alias("ID_Localidad"),
                                         F.rpad("n_name", 30, " ").alias("Nombre"))

    @cached_property
    def barrios(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").alias("ID_Barrio"),
                                         F.rpad("n_name", 30, " ").alias("Nombre"))

    @cached_property
    def zona(self) -> DataFrame:
        return self.raw("region").select(F.col("r_regionkey").alias("ID_Zona"),
                                         F.rpad("r_name", 30, " ").alias("Descripcion"))

    @cached_property
    def repartidores(self) -> DataFrame:
        n = self.raw("nation")
        rid = (F.col("n_nationkey") + 1).cast("int")
        odd = rid % 2 == 1
        return n.select(
            rid.alias("ID_Repartidor"),
            F.rpad("n_name", 40, " ").alias("Nombre"),
            F.concat(F.lit("Apellido"), rid.cast("string")).alias("Apellido"),
            _null_when(odd, (rid + 30000000).cast("string")).alias("DNI"),
            _null_when(odd, F.concat(F.lit("351-"), F.lpad(rid.cast("string"), 7, "0"))).alias("Telefono"),
            _null_when(odd, F.concat(F.lit("Calle "), rid.cast("string"))).alias("Direccion"),
            _null_when(odd, F.concat(F.lit("rep"), rid.cast("string"), F.lit("@correo.test"))).alias("Email"),
            F.lit("2020-01-01 00:00:00").cast("timestamp_ntz").alias("FechaIngreso"),
            F.lit("Activo").alias("Estado"),
            _null_when(odd, F.concat(F.lit("turno "), rid.cast("string"))).alias("Observaciones"),
            _null_when(odd, F.concat(F.lit("B"), F.lpad(rid.cast("string"), 6, "0"))).alias("LicenciaConducir"),
            _null_when(odd, F.lit("2026-12-31 00:00:00").cast("timestamp_ntz")).alias("VencimientoLicencia"),
            F.lit("2020-01-01 00:00:00").cast("timestamp_ntz").alias("CreatedAt"),
            F.lit("2020-01-01 00:00:00").cast("timestamp_ntz").alias("UpdatedAt"),
        )

    # ---- master tables ----------------------------------------------------
    @cached_property
    def clientes(self) -> DataFrame:
        c = self.raw("customer")
        k = _s("c_custkey")
        return c.select(
            F.col("c_custkey").alias("ID_Cliente"),
            _null_when(F.col("c_custkey") % 23 == 0, F.rpad("c_name", 50, " ")).alias("Nombre"),
            _null_when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).alias("Apellido"),
            F.concat(F.lit("Razon Social "), k).alias("RazonSocial"),
            F.rpad(F.concat(F.lit("Calle "), (F.col("c_custkey") % 97).cast("string")), 30, " ").alias("Direccion"),
            (F.col("c_custkey") % 1000).cast("string").alias("Numero"),
            F.concat(F.lit("351-"), F.lpad(k, 7, "0")).alias("Telefono"),
            F.concat(F.lit("30-"), F.lpad(k, 8, "0"), F.lit("-9")).alias("CUIT"),
            F.concat(F.lit("cliente"), k, F.lit("@correo.test")).alias("correo"),
            (F.col("c_custkey") % 30).cast("int").alias("ID_Barrio"),
            F.col("c_nationkey").alias("ID_Localidad"),
            (F.col("c_nationkey") % 5).cast("int").alias("ID_Zona"),
            (F.col("c_custkey") % 7 + 1).cast("int").alias("id_condicion"),
            F.lit("ACTIVO").alias("Estado"),
            _null_when(F.col("c_custkey") % 6 == 0, F.concat(F.lit("IB-"), k)).alias("IngresosBrutos"),
            (F.col("c_custkey") % 900 + 5000).cast("string").alias("CodigoPostal"),
            _null_when(F.col("c_custkey") % 2 == 1, F.concat(F.lit("www.cliente"), k, F.lit(".test"))).alias("sitioweb"),
            add_days(F.lit("2019-01-01 00:00:00").cast("timestamp_ntz"), 31).alias("FechaAlta"),
        )

    @cached_property
    def proveedores(self) -> DataFrame:
        s = self.raw("supplier")
        k = _s("s_suppkey")
        return s.select(
            F.col("s_suppkey").alias("ID_Proveedor"),
            F.rpad("s_name", 50, " ").alias("RazonSocial"),
            _null_when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Contacto "), k)).alias("Contacto"),
            F.concat(F.lit("351-"), F.lpad(k, 7, "0")).alias("Telefono"),
            F.concat(F.lit("20-"), F.lpad(k, 8, "0"), F.lit("-5")).alias("CUIT"),
            F.concat(F.lit("proveedor"), k, F.lit("@correo.test")).alias("Correo"),
            F.rpad(F.concat(F.lit("Avenida "), (F.col("s_suppkey") % 89).cast("string")), 30, " ").alias("Direccion"),
            (F.col("s_suppkey") % 500).cast("string").alias("Numero"),
            (F.col("s_suppkey") % 7 + 1).cast("int").alias("ID_Condicion"),
            F.col("s_nationkey").alias("Barrio"),
            F.col("s_nationkey").alias("Localidad"),
            F.lit("ACTIVO").alias("Estado"),
            (F.col("s_suppkey") % 900 + 5000).cast("string").alias("CodigoPostal"),
            _null_when(F.col("s_suppkey") % 2 == 1, F.concat(F.lit("www.proveedor"), k, F.lit(".test"))).alias("SitioWeb"),
            _null_when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("351-9"), F.lpad(k, 6, "0"))).alias("Fax"),
            F.concat(F.lit("IB-"), k).alias("IB"),
            _null_when(F.col("s_suppkey") % 5 == 0, F.lpad(k, 12, "0")).alias("NroCuenta"),
        )

    def _productos(self, dirty: bool) -> DataFrame:
        p = self.raw("part")
        n_sup = self.raw("supplier").select(F.count(F.lit(1))).scalar()
        if dirty:
            n_sup = n_sup * 2
        price = F.col("p_retailprice").cast("decimal(18,2)")
        uxp = (F.col("p_size") % 12 + 1).cast("int")
        brand = F.substring_index("p_brand", "#", -1).cast("int")
        vat = (F.col("p_partkey") % 3 + 1).cast("int")
        if dirty:
            brand, vat = brand + 10, vat + 1
        rubro = F.col("ID_Rubro")
        if dirty:
            rubro = (F.col("p_partkey") % 9 + 1).cast("int")
        base = p.join(self.rubros.withColumnRenamed("Descripcion", "p_type"), "p_type") if not dirty else p
        out = base.select(
            F.col("p_partkey").alias("ID_Producto"),
            F.col("p_name").alias("Descripcion"),
            F.lpad(_s("p_partkey"), 13, "0").alias("Pr_Ean13"),
            price.alias("PrecioFinalUni"),
            _null_when(F.col("p_partkey") % 101 == 0, F.col("p_size") * 3).alias("Stock"),
            (F.col("p_partkey") % n_sup).alias("ID_Proveedor"),
            rubro.alias("ID_Rubro"),
            _null_when(F.col("p_size") % 7 == 0, brand).alias("idMarca"),
            _null_when(F.col("p_partkey") % 11 == 0, vat).alias("IdAlicIva"),
            F.col("p_size"), price.alias("_price"), uxp.alias("Pr_UniXPack"),
            F.col("p_partkey"), F.col("p_brand"),
        )
        rate = (F.when(F.col("IdAlicIva") == 1, F.lit(0.21)).when(F.col("IdAlicIva") == 2, F.lit(0.105))
                .when(F.col("IdAlicIva") == 3, F.lit(0.27)))
        return out.select(
            "ID_Producto", "Descripcion", "Pr_Ean13", "PrecioFinalUni", "Stock", "ID_Proveedor", "ID_Rubro",
            "idMarca", "IdAlicIva",
            rate.cast("double").alias("AlicIva_desc"),
            _dec("_price", "0.6").alias("Costo"),
            _dec("_price", "0.6").alias("CostoUnit"),
            _dec("_price", "0.4").alias("margen"),
            (F.col("_price") * F.col("Pr_UniXPack")).cast("decimal(18,2)").alias("PrecioFinalPack"),
            (_dec("_price", "0.8") * F.col("Pr_UniXPack")).cast("decimal(18,2)").alias("PrecioNetoPack"),
            _dec("_price", "0.8").alias("PrecioNetoUni"),
            _dec("_price", "0.2").alias("MontoIVA"),
            F.lit(1).alias("PMR"),
            F.lit("UN").alias("Pr_Pack"),
            "Pr_UniXPack",
            F.lit("Activo").alias("Estado"),
            F.lit(False).alias("OcultarApp"),
            (F.col("p_size") < 5).alias("SinStockApp"),
            (F.col("p_partkey") % 5 != 0).alias("PermiteDescuento"),
            F.when(F.col("idMarca").isNotNull(), F.col("p_brand")).alias("MarcaDesc"),
            _null_when(F.col("p_partkey") % 6 == 0, F.concat(F.lit("OR-"), _s("p_partkey"))).alias("Pr_CodOrigen"),
            (F.col("p_size") % 4 + F.lit(Decimal("0.5"))).cast("decimal(18,2)").alias("Pr_UnidMinVenta"),
            (F.col("p_partkey") % 2).cast("long").alias("Enviado"),
        )

    @cached_property
    def productos(self) -> DataFrame:
        return self._productos(dirty=False)

    @cached_property
    def productos_src(self) -> DataFrame:
        """Source products of the migration, with broken references."""
        return self._productos(dirty=True)

    def _pedidos(self, dirty: bool) -> DataFrame:
        o = self.raw("orders")
        k = F.col("o_orderkey")
        dep = F.when(k % 3 == 0, F.lit(1)).when(k % 3 == 1, F.lit(0)).cast("smallint")
        client = F.col("o_custkey") + 100 if dirty else F.col("o_custkey")
        return o.select(
            k.alias("ID_TomaPedido"),
            client.alias("ID_Cliente"),
            F.col("o_orderdate").alias("Fecha"),
            add_days(F.col("o_orderdate"), 7).alias("FechaEntrega"),
            (k % 7 + 1).cast("int").alias("ID_Condicion"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("Total"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("Apagar"),
            F.lit(0).cast("decimal(18,2)").alias("Dto"),
            F.lit(0).cast("decimal(18,2)").alias("CtaCte"),
            F.col("o_orderstatus").alias("Estado"),
            _null_when(k % 2 == 0, F.col("o_orderpriority")).alias("Observaciones"),
            dep.alias("bDeposito"),
            F.when(dep == 1, F.lit(None)).otherwise((k % 27 + 1).cast("int")).cast("int").alias("ID_Repartidor"),
            F.lit("A").alias("Letra"),
            F.lit(1).alias("ID_Comprobante"),
            _null_when(k % 5 == 0, (k % 40 + 1).cast("int")).alias("ID_Empleado"),
            _null_when(k % 9 == 0, (k % 4).cast("double") / 4).alias("PorcentajeDto"),
        )

    @cached_property
    def pedidos(self) -> DataFrame:
        return self._pedidos(dirty=False)

    @cached_property
    def pedidos_src(self) -> DataFrame:
        """Source orders of the migration: some clients do not exist."""
        return self._pedidos(dirty=True)

    def _detalle(self, fractional: bool = False) -> DataFrame:
        li = self.raw("lineitem")
        qty = F.col("l_quantity").cast("decimal(18,2)")
        if fractional:
            qty = F.when(F.col("l_linenumber") == 1, qty + F.lit(Decimal("0.5"))).otherwise(qty).cast("decimal(18,2)")
        amount = F.col("l_extendedprice").cast("decimal(18,2)")
        return li.select(
            F.col("l_orderkey").alias("ID_TomaPedido"),
            F.col("l_partkey").alias("ID_Producto"),
            qty.alias("Cantidad"),
            unit_price_recipe().alias("PrecioUnitario"),
            amount.alias("ImporteconDto"),
            (amount * F.lit(Decimal("0.21"))).cast("decimal(18,4)").alias("IVA"),
            F.lit(0).cast("decimal(18,2)").alias("RestoIVA"),
            F.lit(0).cast("decimal(18,2)").alias("Dto"),
            *_line_extras(),
        )

    @cached_property
    def detalle(self) -> DataFrame:
        return self._detalle()

    @cached_property
    def detalle_frac(self) -> DataFrame:
        """Order lines with fractional quantities on every first line."""
        return self._detalle(fractional=True)

    @cached_property
    def detalle_items(self) -> DataFrame:
        """Order lines with their two-digit ``Item`` (row number by all lineitem columns)."""
        li = self.raw("lineitem")
        numbered = number_rows(li, ["l_orderkey"], LINE_ORDER, "_rn")
        amount = F.col("l_extendedprice").cast("decimal(18,2)")
        return numbered.select(
            F.col("l_orderkey").alias("ID_TomaPedido"),
            F.col("l_partkey").alias("ID_Producto"),
            F.col("l_quantity").cast("decimal(18,2)").alias("Cantidad"),
            unit_price_recipe().alias("PrecioUnitario"),
            amount.alias("ImporteconDto"),
            (amount * F.lit(Decimal("0.21"))).cast("decimal(18,4)").alias("IVA"),
            F.lit(0).cast("decimal(18,2)").alias("RestoIVA"),
            F.lit(0).cast("decimal(18,2)").alias("Dto"),
            F.format_string("%02d", F.col("_rn").cast("int")).alias("Item"),
            *_line_extras(),
        )

    # ---- order requests (flat: headers + items) ----------------------------
    @cached_property
    def request_headers(self) -> DataFrame:
        """One request per order; some name an unknown client or driver, some arrive
        twice under one id, and beside some of them an empty one arrives."""
        o = self.raw("orders")
        k = F.col("o_orderkey")
        own, empty = F.lit(0).cast("long"), F.lit(EMPTY_REQUEST_OFFSET)
        o = o.withColumn("_offset", F.explode(F.when(k % 37 == 0, F.array(own, own)).when(k % 19 == 0, F.array(own, empty)).otherwise(F.array(own))))
        client = F.when(k % 29 == 0, F.col("o_custkey") + UNKNOWN_CLIENT_OFFSET).otherwise(F.col("o_custkey"))
        return o.select(
            (k + F.col("_offset")).alias("request_id"),
            F.lit(None).cast("long").alias("order_id"),
            _null_when(k % 17 == 0, client).alias("client_id"),
            F.when(k % 3 == 0, F.lit("deposito")).otherwise(F.lit("por reparto")).alias("delivery_type"),
            _null_when(k % 2 == 0, add_days(F.col("o_orderdate"), 3)).alias("delivery_date"),
            F.when((k % 13 == 0) | (k % 3 == 0), F.lit(None)).when(k % 31 == 0, F.lit(UNKNOWN_DRIVER))
             .otherwise((k % 10 + 1).cast("int")).cast("int").alias("repartidor_id"),
            F.lit(None).cast("string").alias("status"),
        )

    @cached_property
    def request_items(self) -> DataFrame:
        numbered = number_rows(self.raw("lineitem"), ["l_orderkey"], LINE_ORDER, "pos")
        pos = F.col("pos")
        return numbered.select(
            F.col("l_orderkey").alias("request_id"),
            pos,
            F.when((F.col("l_orderkey") % 23 == 0) & (pos == 1),
                   F.col("l_partkey") + UNKNOWN_PRODUCT_OFFSET).otherwise(F.col("l_partkey")).alias("product_id"),
            F.col("l_quantity").cast("decimal(18,2)").alias("quantity"),
            F.when(pos % 2 == 0, F.lit(None)).when(pos % 5 == 0, F.lit(Decimal("0")))
             .otherwise(unit_price_recipe()).cast("decimal(18,2)").alias("unit_price"),
        )

    @cached_property
    def edit_headers(self) -> DataFrame:
        """Full edits: every order is re-sent with its own id; some were sent before with
        nothing in them, some without their order's id."""
        k = F.col("request_id")
        full = self.request_headers.withColumn("order_id", k % EMPTY_REQUEST_OFFSET)
        early = full.where(k % 41 == 0).withColumn("request_id", -k)
        lost = full.where((k % 43 == 0) & (k % 41 != 0)).withColumn("request_id", -k).withColumn(
            "order_id", F.lit(None).cast("long"))
        return full.unionByName(early).unionByName(lost)

    @cached_property
    def edit_items(self) -> DataFrame:
        return self.request_items

    # ---- a log of posts, edits and status changes (request_id is its order) ----
    @cached_property
    def order_log(self) -> DataFrame:
        """Every request, half of them posted, the others edits: of orders that exist
        (some twice) or that a request before them creates; and status changes."""
        h = self.request_headers.withColumn("k", F.col("request_id") % EMPTY_REQUEST_OFFSET)
        k, r = F.col("k"), F.col("request_id")
        main = h.withColumns({
            "method": F.when(k % 4 < 2, F.lit("POST")).otherwise(F.lit("PUT")),
            "order_id": F.when(k % 8 == 2, k - 2).when(k % 8 == 6, k - 6),
            "created_by": F.when(k % 4 == 3, (k - 3) * 2),
            "request_id": r * 2})
        state = self.raw("orders").select(F.col("o_orderkey").alias("k")).where(k % 5 == 0)
        status = state.select(
            (k * 2 + 1).alias("request_id"), F.lit("PUT").alias("method"), F.when(k % 2 == 1, k).alias("order_id"),
            F.when(k % 2 == 0, k * 2).alias("created_by"), F.lit("Entregado").alias("status"))
        cols = ["request_id", "method", "order_id", "created_by", "client_id", "delivery_type", "delivery_date", "repartidor_id", "status"]
        return main.select(*cols).unionByName(status, allowMissingColumns=True)

    @cached_property
    def order_log_items(self) -> DataFrame:
        return self.request_items.withColumn("request_id", F.col("request_id") * 2)

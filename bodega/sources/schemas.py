"""Schemas of the distributor's tables and the constraints their DDL declares.

Money columns are DECIMAL(18,2) here (the source stores REAL); sums stay
exact and results leave as DOUBLE.
"""
from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

DDL: dict[str, str] = {
    "productos": (
        "ID_Producto BIGINT, Descripcion STRING, Pr_Ean13 STRING, PrecioFinalUni DECIMAL(18,2), Stock INT, "
        "ID_Proveedor BIGINT, ID_Rubro INT, idMarca INT, IdAlicIva INT, AlicIva_desc DOUBLE, "
        "Costo DECIMAL(18,2), CostoUnit DECIMAL(18,2), margen DECIMAL(18,2), PrecioFinalPack DECIMAL(18,2), "
        "PrecioNetoPack DECIMAL(18,2), PrecioNetoUni DECIMAL(18,2), MontoIVA DECIMAL(18,2), PMR INT, "
        "Pr_Pack STRING, Pr_UniXPack INT, Estado STRING, OcultarApp BOOLEAN, SinStockApp BOOLEAN, "
        "PermiteDescuento BOOLEAN, MarcaDesc STRING, Pr_CodOrigen STRING, Pr_UnidMinVenta DECIMAL(18,2), "
        "Enviado BIGINT"),
    "pedidos": (
        "ID_TomaPedido BIGINT, ID_Cliente BIGINT, Fecha TIMESTAMP_NTZ, FechaEntrega TIMESTAMP_NTZ, "
        "ID_Condicion INT, Total DECIMAL(18,2), Apagar DECIMAL(18,2), Dto DECIMAL(18,2), CtaCte DECIMAL(18,2), "
        "Estado STRING, Observaciones STRING, bDeposito SMALLINT, ID_Repartidor INT, Letra STRING, "
        "ID_Comprobante INT, ID_Empleado INT, PorcentajeDto DOUBLE"),
    "detalle": (
        "ID_TomaPedido BIGINT, ID_Producto BIGINT, Cantidad DECIMAL(18,2), PrecioUnitario DECIMAL(18,2), "
        "ImporteconDto DECIMAL(18,2), IVA DECIMAL(18,4), RestoIVA DECIMAL(18,2), Dto DECIMAL(18,2), Item STRING, "
        "Hoja INT, Rechazo INT, Monto DECIMAL(18,2), CostoUnit DECIMAL(18,2), NroPedido BIGINT"),
    "clientes": (
        "ID_Cliente BIGINT, Nombre STRING, Apellido STRING, RazonSocial STRING, Direccion STRING, Numero STRING, "
        "Telefono STRING, CUIT STRING, correo STRING, ID_Barrio INT, ID_Localidad INT, ID_Zona INT, "
        "id_condicion INT, Estado STRING, IngresosBrutos STRING, CodigoPostal STRING, sitioweb STRING, "
        "FechaAlta TIMESTAMP_NTZ"),
    "proveedores": (
        "ID_Proveedor BIGINT, RazonSocial STRING, Contacto STRING, Telefono STRING, CUIT STRING, Correo STRING, "
        "Direccion STRING, Numero STRING, ID_Condicion INT, Barrio INT, Localidad INT, Estado STRING, "
        "CodigoPostal STRING, SitioWeb STRING, Fax STRING, IB STRING, NroCuenta STRING"),
    "localidad": "ID_Localidad INT, Nombre STRING",
    "barrios": "ID_Barrio INT, Nombre STRING",
    "zona": "ID_Zona INT, Descripcion STRING",
    "condicion_pago": "ID_CondicionPago INT, Descripcion STRING",
    "rubros": "ID_Rubro INT, Descripcion STRING",
    "marca": "Id_Marca INT, Mrc_Descripcion STRING",
    "alicuotas": "id_alicuota INT, Alic_descripcion STRING, Alicuota FLOAT",
    "repartidores": (
        "ID_Repartidor INT, Nombre STRING, Apellido STRING, DNI STRING, Telefono STRING, Direccion STRING, "
        "Email STRING, FechaIngreso TIMESTAMP_NTZ, Estado STRING, Observaciones STRING, LicenciaConducir STRING, "
        "VencimientoLicencia TIMESTAMP_NTZ, CreatedAt TIMESTAMP_NTZ, UpdatedAt TIMESTAMP_NTZ"),
}

# An order request as it arrives (JSON body): header fields and nested items.
REQUEST_DDL = (
    "request_id BIGINT, order_id BIGINT, client_id BIGINT, delivery_type STRING, delivery_date TIMESTAMP_NTZ, "
    "repartidor_id INT, status STRING, "
    "items ARRAY<STRUCT<product_id: BIGINT, quantity: STRING, unit_price: STRING>>")

PRIMARY_KEY: dict[str, list[str]] = {
    "productos": ["ID_Producto"],
    "pedidos": ["ID_TomaPedido"],
    "detalle": ["ID_TomaPedido", "ID_Producto", "Item"],
    "marca": ["Id_Marca"],
    "alicuotas": ["id_alicuota"],
    "rubros": ["ID_Rubro"],
    "repartidores": ["ID_Repartidor"],
    "clientes": ["ID_Cliente"],
    "proveedores": ["ID_Proveedor"],
}

NOT_NULL: dict[str, list[str]] = {
    "productos": ["Descripcion", "ID_Proveedor", "PMR", "Costo", "PrecioFinalPack", "ID_Rubro",
                  "PrecioNetoPack", "MontoIVA", "Estado", "PermiteDescuento"],
    "pedidos": ["Letra", "ID_Comprobante", "ID_Cliente", "Fecha", "FechaEntrega", "Dto", "Total", "Apagar", "CtaCte", "Estado"],
    "detalle": ["ID_TomaPedido", "ID_Producto", "IVA", "PrecioUnitario", "Cantidad", "RestoIVA", "Dto",
                "ImporteconDto", "Item"],
    "marca": ["Mrc_Descripcion"],
    "alicuotas": ["Alic_descripcion", "Alicuota"],
    "rubros": ["Descripcion"],
    "repartidores": ["Nombre", "Apellido", "Estado"],
}

MAX_LENGTH: dict[str, dict[str, int]] = {
    "productos": {"Descripcion": 999, "Pr_Ean13": 15, "Pr_Pack": 3, "Estado": 50, "MarcaDesc": 255, "Pr_CodOrigen": 15},
    "pedidos": {"Letra": 30, "Estado": 50, "Observaciones": 255},
    "detalle": {"Item": 2},
    "marca": {"Mrc_Descripcion": 30},
    "alicuotas": {"Alic_descripcion": 50},
    "rubros": {"Descripcion": 40},
    "repartidores": {"Nombre": 100, "Apellido": 100, "DNI": 20, "Telefono": 50, "Direccion": 200,
                     "Email": 100, "Estado": 50, "Observaciones": 255, "LicenciaConducir": 50},
}

# (table, column, referenced table, referenced column)
FOREIGN_KEYS: list[tuple[str, str, str, str]] = [
    ("productos", "ID_Proveedor", "proveedores", "ID_Proveedor"),
    ("productos", "ID_Rubro", "rubros", "ID_Rubro"),
    ("productos", "idMarca", "marca", "Id_Marca"),
    ("productos", "IdAlicIva", "alicuotas", "id_alicuota"),
    ("pedidos", "ID_Cliente", "clientes", "ID_Cliente"),
    ("pedidos", "ID_Condicion", "condicion_pago", "ID_CondicionPago"),
    ("pedidos", "ID_Repartidor", "repartidores", "ID_Repartidor"),
    ("detalle", "ID_TomaPedido", "pedidos", "ID_TomaPedido"),
    ("detalle", "ID_Producto", "productos", "ID_Producto"),
]


def schema(spark: SparkSession, name: str) -> StructType:
    """The declared schema as a StructType (parsed by Spark itself)."""
    return spark.createDataFrame([], DDL[name]).schema


def columns(name: str) -> list[str]:
    """Column names of a table, in declared order."""
    return [c.split(" ", 1)[0] for c in DDL[name].split(", ")]

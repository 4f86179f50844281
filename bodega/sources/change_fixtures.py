"""Change tables for the maintenance jobs, derived from the base snapshots.

Per base key: one change (seq = key*10 + 1); keys divisible by 7 get a
second, later one (seq + 1, latest wins); keys divisible by 50 and the
highest key also appear shifted beyond the base (seq + 2: not found for an
update, new rows for an insert). Alterations put explicit NULLs, blanks
and zeros where the defaults must act.

Each alteration is one SQL expression over the base columns plus ``_k``
(original key) and ``_v`` (version); Spark evaluates it with ``F.expr``,
the oracle hands the same text to DuckDB.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bodega.operators import changes as W

ALTER: dict[str, dict[str, str]] = {
    "productos": {
        "Descripcion": "CASE WHEN _k % 13 = 0 AND _v = 1 THEN NULL WHEN _v = 2 THEN Descripcion || ' (segunda)' "
                       "ELSE Descripcion || ' (nuevo)' END",
        "Pr_Ean13": "CASE WHEN _k % 9 = 0 THEN '' ELSE Pr_Ean13 END",
        "PrecioFinalUni": "CASE WHEN _k % 8 = 0 THEN NULL WHEN _k % 8 = 1 THEN CAST(0 AS DECIMAL(18,2)) "
                          "ELSE CAST(PrecioFinalUni + 1 AS DECIMAL(18,2)) END",
        "Stock": "CASE WHEN _k % 6 = 0 THEN NULL ELSE Stock + 5 END",
        "ID_Proveedor": "CASE WHEN _k % 17 = 0 AND _v = 2 THEN NULL ELSE ID_Proveedor END",
        "ID_Rubro": "CASE WHEN _k % 5 = 0 THEN NULL ELSE ID_Rubro END",
        "PMR": "CASE WHEN _k % 4 = 0 THEN 0 ELSE PMR END",
        "Pr_Pack": "CASE WHEN _k % 7 = 0 THEN '' ELSE Pr_Pack END",
        "Estado": "CASE WHEN _k % 10 = 0 THEN NULL ELSE Estado END",
        "PermiteDescuento": "CASE WHEN _k % 3 = 0 THEN NULL ELSE PermiteDescuento END",
    },
    "clientes": {
        "Nombre": "CASE WHEN _k % 11 = 0 AND _v = 1 THEN NULL ELSE rtrim(Nombre) || ' mod' || CAST(_v AS STRING) END",
        "Apellido": "CASE WHEN _k % 9 = 0 THEN '' ELSE Apellido END",
        "RazonSocial": "CASE WHEN _v = 2 THEN RazonSocial || ' SA' ELSE RazonSocial END",
        "Direccion": "CASE WHEN _k % 8 = 0 THEN NULL ELSE Direccion END",
        "correo": "CASE WHEN _k % 10 = 0 THEN '' ELSE correo END",
        "ID_Barrio": "CASE WHEN _k % 6 = 0 THEN 0 ELSE ID_Barrio END",
        "id_condicion": "CASE WHEN _k % 5 = 0 THEN NULL ELSE id_condicion END",
    },
    "proveedores": {
        "RazonSocial": "CASE WHEN _k % 11 = 0 THEN NULL ELSE rtrim(RazonSocial) || ' mod' || CAST(_v AS STRING) END",
        "Direccion": "CASE WHEN _k % 4 = 0 THEN '' ELSE Direccion END",
        "Correo": "CASE WHEN _k % 3 = 0 THEN NULL ELSE Correo END",
        "ID_Condicion": "CASE WHEN _k % 5 = 0 THEN 0 ELSE ID_Condicion END",
    },
    "marca": {
        "Mrc_Descripcion": "CASE WHEN _k % 6 = 0 THEN '' WHEN _k % 10 = 0 THEN NULL "
                           "ELSE Mrc_Descripcion || ' v' || CAST(_v AS STRING) END",
    },
    "rubros": {
        "Descripcion": "CASE WHEN _k % 5 = 0 THEN NULL WHEN _k % 4 = 0 THEN '' "
                       "ELSE Descripcion || ' v' || CAST(_v AS STRING) END",
    },
    "repartidores": {
        "Nombre": "CASE WHEN _k % 4 = 0 THEN NULL ELSE rtrim(Nombre) END",
        "Apellido": "Apellido || ' v' || CAST(_v AS STRING)",
        "DNI": "CASE WHEN _k % 3 = 0 THEN '' ELSE DNI END",
        "FechaIngreso": "CASE WHEN _k % 2 = 0 THEN NULL ELSE FechaIngreso END",
        "Estado": "CASE WHEN _k % 5 = 0 THEN NULL ELSE Estado END",
    },
}

KEYS = {"productos": "ID_Producto", "clientes": "ID_Cliente", "proveedores": "ID_Proveedor",
        "marca": "Id_Marca", "rubros": "ID_Rubro", "repartidores": "ID_Repartidor"}

FIELDS = {"productos": W.PRODUCT_FIELDS, "clientes": W.CLIENT_FIELDS, "proveedores": W.PROVIDER_FIELDS,
          "marca": ["Mrc_Descripcion"], "rubros": ["Descripcion"], "repartidores": W.DRIVER_FIELDS}

# New drivers offered to insert-if-absent, keyed by DNI (one per nation).
ROSTER_SQL = {
    "ID_Repartidor": "CAST(NULL AS INT)",
    "change_seq": "CAST(n_nationkey AS BIGINT)",
    "Nombre": "rpad(n_name, 40, ' ')",
    "Apellido": "'Nuevo' || CAST(n_nationkey AS STRING)",
    "DNI": "CAST(n_nationkey + 30000001 AS STRING)",
    "Telefono": "CAST(NULL AS STRING)",
    "Direccion": "CAST(NULL AS STRING)",
    "Email": "CAST(NULL AS STRING)",
    "Observaciones": "CAST(NULL AS STRING)",
    "LicenciaConducir": "CAST(NULL AS STRING)",
    "FechaIngreso": "CAST(NULL AS TIMESTAMP_NTZ)",
    "Estado": "CAST(NULL AS STRING)",
    "VencimientoLicencia": "CAST(NULL AS TIMESTAMP_NTZ)",
}


def change_table(base: DataFrame, table: str) -> DataFrame:
    key = KEYS[table]
    ktype = base.schema[key].dataType
    maxk = base.select(F.max(key)).scalar()
    k = F.col(key)
    v1 = base.withColumn("_v", F.lit(1))
    v2 = base.where(k % 7 == 0).withColumn("_v", F.lit(2))
    v3 = base.where((k % 50 == 0) | (k == maxk)).withColumn("_v", F.lit(3))
    rows = v1.unionByName(v2).unionByName(v3).withColumn("_k", k)
    alter = ALTER[table]
    return rows.select(
        F.when(F.col("_v") == 3, F.col("_k") + maxk + 1).otherwise(F.col("_k")).cast(ktype).alias(key),
        (F.col("_k") * 10 + F.col("_v")).cast("long").alias(W.SEQ),
        *[F.expr(alter.get(c, c)).alias(c) for c in FIELDS[table]],
    )


def driver_roster(nation: DataFrame) -> DataFrame:
    return nation.select(*[F.expr(e).alias(c) for c, e in ROSTER_SQL.items()])

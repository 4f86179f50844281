"""Loading another database's tables while repairing broken references.

``src`` is the dict of source tables, ``dst`` the destination's dimension
tables. Each step is a DataFrame function; ``migrate`` chains them in the
order of the original script and ``load_report`` counts what each wrote.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bodega.sources.schemas import PRIMARY_KEY
from bodega.sources.tables import append_batch, ensure_table, read_appended

# Fixed values of the migration.
FALLBACKS = {  # foreign key -> (dimension, its key, value when the target is missing)
    "ID_Proveedor": ("proveedores", "ID_Proveedor", 1),
    "ID_Rubro": ("rubros", "ID_Rubro", 1),
    "idMarca": ("marca", "Id_Marca", None),
    "IdAlicIva": ("alicuotas", "id_alicuota", None),
}
RECENT_ORDERS = 1000       # what the reference's script loads
MERGED_LIMIT = 1000        # rows that one task merges, and that are broadcast
KEY_RANGES = 1024
STOCK_RANGE = 500
# One step of the classic linear congruential generator, applied to the key:
# repeatable, cheap, and expressible in plain SQL.
LCG_MULTIPLIER = 1103515245
LCG_INCREMENT = 12345
LCG_MODULUS = 2 ** 31

ORDER_COLS = ["ID_TomaPedido", "Letra", "ID_Comprobante", "ID_Cliente", "Fecha", "FechaEntrega",
              "ID_Condicion", "ID_Empleado", "PorcentajeDto", "Dto", "Total", "Apagar", "CtaCte", "Estado", "Observaciones", "bDeposito"]


def copy_table(src: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Copy rows keeping their ids (the identity values are inserted as given)."""
    return src.select(*(columns or src.columns))


def repair_references(df: DataFrame, rules: dict[str, tuple[DataFrame, str, object]]) -> DataFrame:
    """Keep each foreign key whose target exists, else put its fallback.

    Each dimension is reduced to its distinct keys and left-joined once.
    Small dimensions are broadcast by the planner after it has measured
    them; a large one (providers) is a normal shuffle join."""
    out = df
    for fk, (dim, key, fallback) in rules.items():
        tag = f"_hit_{fk}"
        keys = dim.select(F.col(key).alias(tag)).distinct()
        out = out.join(keys, out[fk] == keys[tag], "left")
        fb: Column = F.lit(fallback).cast(df.schema[fk].dataType)
        out = out.withColumn(fk, F.when(F.col(tag).isNotNull(), F.col(fk)).otherwise(fb)).drop(tag)
    return out.select(*df.columns)


def synthetic_stock(df: DataFrame, key: str = "ID_Producto", upper: int = STOCK_RANGE) -> DataFrame:
    """E5: a stock in [0, upper) per row, a pseudo-random function of the key.

    Repeatable: a recomputed partition gets the same values, unlike rand().
    The key is reduced below 2^31 first, so the product stays inside BIGINT."""
    k = F.pmod(F.col(key).cast("long"), F.lit(LCG_MODULUS))
    mixed = F.pmod(k * F.lit(LCG_MULTIPLIER) + F.lit(LCG_INCREMENT), F.lit(LCG_MODULUS))
    return df.withColumn("Stock", F.pmod(mixed, F.lit(upper)).cast("int"))


def newest(rows: DataFrame, key: str, n: int | None) -> DataFrame:
    """The ``n`` rows with the largest ``key`` (a whole number; None: all rows). NULL keys
    come last.

    Up to ``MERGED_LIMIT`` rows are a limit, which one task merges. Beyond, the n-th
    largest key is found first: rows are counted per range of keys, the range that holds
    it is divided again, and so on (a few passes, at most ``KEY_RANGES`` counts each to the
    driver). What lies above it is then a filter, and only the ties at the key itself are cut."""
    if n is None:
        return rows
    if n <= MERGED_LIMIT:
        return rows.orderBy(F.col(key).desc()).limit(n)
    k = F.col(key).cast("long")
    lo, hi, total = rows.agg(F.min(k), F.max(k), F.count(k)).first()
    if total <= n:
        # whatever is missing are rows without a key, all alike
        return rows.where(k.isNotNull()).unionByName(rows.where(k.isNull()).limit(n - total)) if total < n else rows.where(k.isNotNull())
    above = 0
    while lo < hi:
        width = -(-(hi - lo + 1) // KEY_RANGES)
        counts = rows.where(k.between(lo, hi)).groupBy(F.floor((k - lo) / F.lit(width)).alias("r")).count().collect()
        for r in sorted(counts, key=lambda r: -r["r"]):
            if above + r["count"] >= n:
                lo, hi = lo + r["r"] * width, min(hi, lo + (r["r"] + 1) * width - 1)
                break
            above += r["count"]
    return rows.where(k > lo).unionByName(rows.where(k == lo).limit(n - above))


def load_recent_orders(orders: DataFrame, clients: DataFrame, terms: DataFrame, n: int | None) -> DataFrame:
    """The newest ``n`` orders by id (None: all) whose client exists; unknown
    payment terms become NULL."""
    known = orders.join(clients.select("ID_Cliente"), "ID_Cliente", "left_semi")
    tk = terms.select(F.col("ID_CondicionPago").alias("_term")).distinct()
    known = known.join(tk, known["ID_Condicion"] == tk["_term"], "left")
    known = known.withColumn("ID_Condicion", F.when(F.col("_term").isNotNull(), F.col("ID_Condicion"))
                             .cast("int")).drop("_term")
    return newest(known.select(*ORDER_COLS), "ID_TomaPedido", n)


def load_order_lines(lines: DataFrame, loaded_orders: DataFrame, loaded_products: DataFrame, n: int | None) -> DataFrame:
    """Lines whose order and product were both loaded.

    Up to ``MERGED_LIMIT`` loaded orders are broadcast, a proven bound; beyond, both
    sides are joined as the planner sees fit."""
    keys = loaded_orders.select("ID_TomaPedido")
    out = lines.join(F.broadcast(keys) if n is not None and n <= MERGED_LIMIT else keys, "ID_TomaPedido", "left_semi")
    return out.join(loaded_products.select("ID_Producto"), "ID_Producto", "left_semi").select(*lines.columns)


def ensure_column(df: DataFrame, name: str, dtype: str, default=None) -> DataFrame:
    """Add a column with a default when it is missing, else leave the table alone.
    Applying it twice is the same as once."""
    if name.lower() in (c.lower() for c in df.columns):
        return df
    return df.withColumn(name, F.lit(default).cast(dtype))


def load_products(src_products: DataFrame, dst: dict) -> DataFrame:
    """E2 + E5: products with repaired references and a synthetic stock."""
    rules = {fk: (dst[t], k, fb) for fk, (t, k, fb) in FALLBACKS.items()}
    return synthetic_stock(repair_references(src_products, rules))


def migrate(src: dict, dst: dict, n: int | None) -> dict[str, DataFrame]:
    """Brands, VAT rates, products, the newest ``n`` orders (None: all) and their
    lines, in order."""
    marca = copy_table(src["marca"])
    alicuotas = copy_table(src["alicuotas"])
    dims = dict(dst, marca=marca, alicuotas=alicuotas)
    productos = load_products(src["productos"], dims)
    pedidos = load_recent_orders(src["pedidos"], dst["clientes"], dst["condicion_pago"], n)
    detalle = load_order_lines(src["detalle"], pedidos, productos, n)
    return {"marca": marca, "alicuotas": alicuotas, "productos": productos,
            "pedidos": pedidos, "detalle": detalle}


def migrate_into(src: dict, dst: dict, root: str, batch: str, n: int | None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """E6 into the tables under ``root``, which may hold earlier loads: each table is
    written once as ``batch``, and later steps read the written table instead of working it
    out again. -> (E7's report: table_name, rows_loaded as observed by each write; the
    refused rows of each table)."""
    spark = src["pedidos"].sparkSession
    counts, refused, held = [], {}, {}

    def put(name: str, df: DataFrame) -> None:
        ensure_table(spark, root, name)
        rows, refused[name] = append_batch(df, root, name, batch, PRIMARY_KEY[name])
        counts.append((name, rows))
        held[name] = read_appended(spark, root, name, df.schema)

    put("marca", copy_table(src["marca"]))
    put("alicuotas", copy_table(src["alicuotas"]))
    put("productos", load_products(src["productos"], dst | held))
    put("pedidos", load_recent_orders(src["pedidos"], dst["clientes"], dst["condicion_pago"], n))
    put("detalle", load_order_lines(src["detalle"], held["pedidos"], held["productos"], None))
    return spark.createDataFrame(counts, "table_name string, rows_loaded long"), refused


def load_report(loaded: dict[str, DataFrame]) -> DataFrame:
    """Rows written per table (true counts, one small aggregate each)."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows_loaded"))
             .select(F.lit(name).alias("table_name"), "rows_loaded")
             for name, df in loaded.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

"""R1-R4 from a store of daily totals.

Every figure of the reports is a sum over orders, and an order has one date, so totals
per day add up to any window: also the number of distinct orders, which no two days
share. The store under ``root`` is append-only:

  product_day/batch=N         day, ID_Producto: quantity, amount, orders
  client_day/batch=N          day, ID_Cliente: orders, total, total once per line, quantity
  client_product_day/batch=N  day, ID_Cliente, ID_Producto: quantity, amount, lines

An appended batch holds totals of its own orders on whatever days they bear, so a
back-dated order is nothing special. An order that changes is brought twice: whole as it
was, taken off, and whole as it is now, added. A batch loaded again replaces its own
folders. ``compact`` folds the batches up to one into a new base.

A window begins at a moment, not at midnight: whole days come from the totals, and the
orders of its first day, if it is cut, from the order and line tables. What is read is
then in proportion to days, not to lines; rows are laid out by day, so the pushed bound
rules out files and row groups.
"""
from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bodega.functions.exprs import DEFAULT_REPORT_DAYS
from bodega.functions.sequence import stored
from bodega.operators import reports

KEYS = {"product_day": ["ID_Producto"], "client_day": ["ID_Cliente"], "client_product_day": ["ID_Cliente", "ID_Producto"]}


TASK_ROWS = 500_000  # lines of a task, whatever the size of the input


def _tasks(spark: SparkSession, rows: int) -> int:
    return max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 20_000 + 1), rows // TASK_ROWS)


def _per_order(orders: DataFrame, lines: DataFrame, tasks: int | None = None) -> DataFrame:
    """Per order and product: q, a, n (lines) and total, and sign 1. Orders without a line
    count nowhere, as in the reports; orders without a date are in no window."""
    dated = orders.where(F.col("Fecha").isNotNull()).select("ID_TomaPedido", "ID_Cliente", "Total", F.to_date("Fecha").alias("day"))
    amount = F.col("Cantidad") * F.col("PrecioUnitario")
    sold = lines.select("ID_TomaPedido", "ID_Producto", "Cantidad", amount.alias("amount"))
    if tasks:
        sold, dated = sold.repartition(tasks, "ID_TomaPedido"), dated.repartition(tasks, "ID_TomaPedido")
    return sold.join(dated, "ID_TomaPedido").groupBy("day", "ID_Cliente", "ID_TomaPedido", "ID_Producto").agg(
        F.sum("Cantidad").alias("q"), F.sum("amount").alias("a"), F.count(F.lit(1)).alias("n"), F.first("Total").alias("total"), F.lit(1).alias("sign"))


def _totals(name: str, per: DataFrame) -> DataFrame:
    """The totals of one kind. What is taken off has sign -1 and q, a, n below zero."""
    if name == "product_day":
        return per.groupBy("day", "ID_Producto").agg(F.sum("q").alias("q"), F.sum("a").alias("a"), F.sum("sign").alias("orders"))
    if name == "client_product_day":
        return per.groupBy("day", "ID_Cliente", "ID_Producto").agg(F.sum("q").alias("q"), F.sum("a").alias("a"), F.sum("n").alias("lines"))
    whole = per.groupBy("day", "ID_Cliente", "ID_TomaPedido", "sign").agg(F.sum("q").alias("q"), F.sum("n").alias("n"), F.first("total").alias("total"))
    return whole.groupBy("day", "ID_Cliente").agg(
        F.sum("sign").alias("orders"), F.sum(F.when(F.col("sign") < 0, -F.col("total")).otherwise(F.col("total"))).alias("t"),
        F.sum(F.col("total") * F.col("n")).alias("t_lines"), F.sum("q").alias("q"))


def day_totals(orders: DataFrame, lines: DataFrame) -> dict[str, DataFrame]:
    """The totals of whole orders (``lines`` are joined to them)."""
    per = _per_order(orders, lines)
    return {name: _totals(name, per) for name in KEYS}


def _add(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of the same keys added up, in types that hold any number of batches."""
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in parts.columns if c not in keys])


def _stored(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts as long, sums as decimals that keep their scale over any number of batches."""
    cols = [f.name for f in df.schema.fields if f.name not in ("day", *keys)]
    kinds = {"orders": "long", "lines": "long", "q": "decimal(38,4)"}
    return df.select("day", *keys, *[F.col(c).cast(kinds.get(c, "decimal(38,6)")).alias(c) for c in cols])


def append_days(root: str, batch: int, added: tuple[DataFrame, DataFrame],
                taken: tuple[DataFrame, DataFrame] | None = None) -> None:
    """Store one batch: ``added`` and ``taken`` are (orders, lines) of whole orders. They are
    joined once; the order rows are then dealt by day and key, where the totals and their
    layout need no further shuffle."""
    spark = added[0].sparkSession
    sides = []
    for sign, (orders, lines) in ((1, added), *(((-1, taken),) if taken else ())):
        per = _per_order(orders, lines, _tasks(spark, lines.count()))
        if sign < 0:
            per = per.select(*[(-F.col(c)).cast(per.schema[c].dataType).alias(c) if c in ("q", "a", "n", "sign") else F.col(c) for c in per.columns])
        sides.append(stored(per))
    per = reduce(DataFrame.unionByName, sides)
    tasks = _tasks(spark, per.count())
    for name, keys in KEYS.items():
        out = _stored(_totals(name, per.repartitionByRange(tasks, "day", *keys)), keys)
        out.sortWithinPartitions("day").write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}/batch={batch}")


def compact(spark: SparkSession, root: str, target: str, upto: int) -> None:
    """Fold the batches up to ``upto`` into batch ``upto`` of a new store ``target``;
    later ones are copied as they are, so readers of the old store are not disturbed."""
    for name, keys in KEYS.items():
        rows = spark.read.parquet(f"{root.rstrip('/')}/{name}")
        folded = _stored(_add(rows.where(F.col("batch") <= upto).drop("batch"), ["day", *keys]), keys)
        later = rows.where(F.col("batch") > upto)
        for part, where in ((folded.withColumn("batch", F.lit(upto)), "append"), (later, "append")):
            (part.repartitionByRange("batch", "day", *keys).sortWithinPartitions("batch", "day")
             .write.mode(where).partitionBy("batch").parquet(f"{target.rstrip('/')}/{name}"))


def window_totals(root: str, name: str, d: dict, as_of: dt.datetime, days: float = DEFAULT_REPORT_DAYS) -> DataFrame:
    """The totals of one kind since ``as_of - days``, per key, without keys whose orders
    have all been taken off."""
    keys, start = KEYS[name], as_of - dt.timedelta(days=days)
    whole = start.date() if start.time() == dt.time() else start.date() + dt.timedelta(days=1)
    stored = d["pedidos"].sparkSession.read.parquet(f"{root.rstrip('/')}/{name}").drop("batch").where(F.col("day") >= F.lit(whole))
    if whole != start.date():
        midnight = dt.datetime.combine(whole, dt.time())
        cut = reports.orders_in_window(d["pedidos"], as_of, days).where(F.col("Fecha") < F.lit(midnight.isoformat()).cast("timestamp_ntz"))
        stored = stored.unionByName(_stored(day_totals(cut, reports.lines_near(d["detalle"], cut))[name], keys))
    return _add(stored.drop("day"), keys).where(F.col("lines" if "lines" in stored.columns else "orders") > 0)


def top_products(root: str, d: dict, as_of, days: float = DEFAULT_REPORT_DAYS, n: int | None = None) -> DataFrame:
    """R1 from the store."""
    return reports.named_products(window_totals(root, "product_day", d, as_of, days).withColumnRenamed("orders", "order_count"), d, n)


def top_providers(root: str, d: dict, as_of, days: float = DEFAULT_REPORT_DAYS, n: int | None = None) -> DataFrame:
    """R2 from the store."""
    return reports.named_providers(window_totals(root, "product_day", d, as_of, days), d, n)


def top_clients(root: str, d: dict, as_of, days: float = DEFAULT_REPORT_DAYS, n: int | None = None, exact: bool = False) -> DataFrame:
    """R3 (R3b with ``exact``) from the store."""
    per_client = window_totals(root, "client_day", d, as_of, days)
    return reports.named_clients(per_client.select("ID_Cliente", F.col("orders").alias("order_count"), F.col("t" if exact else "t_lines").alias("t"), "q"), d, n)


def client_products(root: str, d: dict, client_ids: DataFrame | None, as_of, days: float = DEFAULT_REPORT_DAYS) -> DataFrame:
    """R4 from the store."""
    per = window_totals(root, "client_product_day", d, as_of, days)
    if client_ids is not None:
        per = per.join(client_ids.select("ID_Cliente"), "ID_Cliente", "left_semi")
    return reports.named_client_products(per, d)

"""Order intake as a Structured Streaming job.

The reference posts orders as they arrive, one HTTP call each. Here order
requests arrive as JSON lines in a folder; every micro-batch is posted with
``post_orders`` in ``sequential`` mode against the store's current state,
so the effect equals posting each request in arrival order.

Store layout under ``root`` (shared storage):
  pedidos/batch=N, detalle/batch=N  append-only: rows added by batch N
  stock_moves/batch=N               net stock change per product of batch N
  productos/version=N               full product snapshot after batch N, written
                                    at start (0) and by every compaction
  rejects/batch=N                   rejected requests of batch N
  last_id/batch=N                   one row: the highest order id after batch N
  batch_time/batch=N                one row: the moment batch N is posted at

A batch never rewrites the product table and never scans every order: it
reads the stock of just the products its items mention (base snapshot plus
the moves since), and the next id from a one-row table. Every
``compact_every`` batches the moves are folded into a new product version.
A retried batch reads only what earlier batches wrote and rewrites only its
own folders with the same content, so the sink is idempotent; the stream's
own checkpoint lives in the shared folder too.
"""
from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bodega.operators.posting import apply_stock, post_orders
from bodega.sources.schemas import DDL, REQUEST_DDL
from bodega.sources.tables import exists, flatten_requests, latest_version, split_malformed

COMPACT_EVERY = 100


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _fields(table: str) -> list[tuple[str, str]]:
    return [tuple(x.split(" ", 1)) for x in DDL[table].split(", ")]


def _conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of ``table`` in order and type; absent ones are NULL."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in _fields(table)])


def init_store(d: dict[str, DataFrame], root: str) -> None:
    """Write the initial tables as batch 0 / version 0."""
    root = root.rstrip("/")
    _write(_conform(d["pedidos"], "pedidos"), f"{root}/pedidos/batch=0")
    _write(_conform(d["detalle"], "detalle"), f"{root}/detalle/batch=0")
    _write(d["productos"], f"{root}/productos/version=0")
    _write(d["productos"].sparkSession.createDataFrame([], "ID_Producto BIGINT, delta BIGINT"),
           f"{root}/stock_moves/batch=0")
    _write(d["pedidos"].agg(F.max("ID_TomaPedido").alias("ID_TomaPedido")), f"{root}/last_id/batch=0")


def _appended(spark: SparkSession, root: str, table: str, ddl: str, lo: int, hi: int) -> DataFrame:
    """Rows of batches lo < batch < hi (the batch folders are pruned by the filter)."""
    return (spark.read.schema(ddl + ", batch INT").parquet(f"{root}/{table}")
            .where((F.col("batch") > lo) & (F.col("batch") < hi)).drop("batch"))


def stock_state(spark: SparkSession, root: str, n: int, products: DataFrame | None = None) -> DataFrame:
    """Products as batch ``n`` must see them: the newest snapshot before n plus
    the moves of the batches after it. ``products`` (a column ``ID_Producto``)
    restricts both reads to the products a batch needs."""
    root = root.rstrip("/")
    v = latest_version(spark, root, "productos", upto=n - 1)
    base = spark.read.parquet(f"{root}/productos/version={v}")
    moves = _appended(spark, root, "stock_moves", "ID_Producto BIGINT, delta BIGINT", v, n)
    if products is not None:
        wanted = products.select("ID_Producto").distinct()
        base = base.join(wanted, "ID_Producto", "left_semi")
        moves = moves.join(wanted, "ID_Producto", "left_semi")
    net = moves.groupBy(F.col("ID_Producto").alias("product_id")).agg(F.sum("delta").alias("delta"))
    return apply_stock(base, net)


def state_before(spark: SparkSession, root: str, n: int) -> dict[str, DataFrame]:
    """The store as batch ``n`` must see it (a retried batch never reads its
    own output)."""
    root = root.rstrip("/")
    return {"pedidos": _appended(spark, root, "pedidos", DDL["pedidos"], -1, n),
            "detalle": _appended(spark, root, "detalle", DDL["detalle"], -1, n),
            "productos": stock_state(spark, root, n),
            "last_id": spark.read.parquet(f"{root}/last_id/batch={n - 1}")}


def last_batch(spark: SparkSession, root: str) -> int:
    ids = spark.read.schema("ID_TomaPedido BIGINT, batch INT").parquet(f"{root.rstrip('/')}/last_id")
    return ids.agg(F.max("batch")).first()[0]


def current_state(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The store after its last complete batch."""
    return state_before(spark, root, last_batch(spark, root) + 1)


def compact(spark: SparkSession, root: str, n: int) -> None:
    """Fold the moves up to batch ``n`` into product version ``n``."""
    _write(stock_state(spark, root, n + 1), f"{root.rstrip('/')}/productos/version={n}")


def batch_time(spark: SparkSession, root: str, n: int, clock: Callable[[], dt.datetime]) -> dt.datetime:
    """The moment batch ``n`` is posted at: read from the clock once and written down
    before anything is posted, so that a retried batch gets the same dates."""
    path = f"{root}/batch_time/batch={n}"
    if not exists(spark, f"{path}/_SUCCESS"):
        _write(spark.createDataFrame([(clock(),)], "as_of timestamp_ntz"), path)
    return spark.read.parquet(path).first()["as_of"]


def post_batch(batch: DataFrame, batch_id: int, root: str, clock: Callable[[], dt.datetime],
               mode: str = "sequential", compact_every: int = COMPACT_EVERY,
               parties: dict[str, DataFrame] | None = None) -> None:
    """Post one micro-batch and write its folders (batch ``batch_id + 1``)."""
    spark = batch.sparkSession
    root = root.rstrip("/")
    n = batch_id + 1
    good, malformed = split_malformed(batch)
    headers, items = flatten_requests(good)
    needed = items.select(F.col("product_id").alias("ID_Producto"))
    last_id = spark.read.parquet(f"{root}/last_id/batch={n - 1}")
    # new ids continue from the one-row last-id table, not from a scan of every order
    out = post_orders({"productos": stock_state(spark, root, n, needed), "pedidos": last_id} | (parties or {}),
                      headers, items, batch_time(spark, root, n, clock), mode=mode)
    _write(_conform(out["orders"], "pedidos"), f"{root}/pedidos/batch={n}")
    _write(_conform(out["lines"], "detalle"), f"{root}/detalle/batch={n}")
    _write(out["moves"].select(F.col("product_id").alias("ID_Producto"), F.col("delta").cast("long")),
           f"{root}/stock_moves/batch={n}")
    _write(out["rejects"].unionByName(malformed.drop("body")), f"{root}/rejects/batch={n}")
    _write(last_id.unionByName(out["orders"].select("ID_TomaPedido"))
           .agg(F.max("ID_TomaPedido").alias("ID_TomaPedido")), f"{root}/last_id/batch={n}")
    if n % compact_every == 0:
        compact(spark, root, n)


def start_order_intake(spark: SparkSession, requests_dir: str, root: str,
                       checkpoint_location: str,
                       clock: Callable[[], dt.datetime] | None = None, mode: str = "sequential",
                       available_now: bool = False,
                       max_files_per_trigger: int | None = None,
                       compact_every: int = COMPACT_EVERY,
                       parties: dict[str, DataFrame] | None = None) -> StreamingQuery:
    """Start the intake stream; returns the running query. ``checkpoint_location`` is
    the stream's own folder in the shared store: a restart with the same one goes on
    after the last complete batch. ``parties``: the tables ``clientes`` and
    ``repartidores``, whose ids every request must name."""
    clock = clock or (lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0))
    reader = (spark.readStream.schema(REQUEST_DDL + ", _corrupt_record STRING")
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
              .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSS]"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.json(requests_dir)
    writer = (stream.writeStream
              .foreachBatch(lambda df, i: post_batch(df, i, root, clock, mode, compact_every, parties))
              .option("checkpointLocation", checkpoint_location))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()

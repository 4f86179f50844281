"""Typed scans, JSON requests, versioned snapshots, and the intake stream."""
import datetime as dt
import json
import os
import tempfile
import time
from decimal import Decimal

from pyspark.sql import functions as F

from bodega.operators import posting as P
from bodega.sources import tables as T
from bodega.streaming import intake

AS_OF = dt.datetime(2001, 8, 1)


def _tmp():
    return tempfile.mkdtemp(prefix="bodega-test-", dir="/tmp")


def test_open_tables_round_trip(spark, fx):
    root = _tmp()
    for name in ("productos", "clientes", "marca"):
        T.write_result(getattr(fx, name), f"{root}/{name}", fmt="parquet")
    got = T.open_tables(spark, root, ["productos", "clientes", "marca"])
    for name, df in got.items():
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in getattr(fx, name).schema]
        assert sorted(df.collect()) == sorted(getattr(fx, name).collect())


def test_ensure_table_creates_once(spark, fx):
    root = _tmp()
    assert T.ensure_table(spark, root, "marca") is True
    assert T.open_tables(spark, root, ["marca"])["marca"].count() == 0
    T.write_result(fx.marca, f"{root}/marca", fmt="parquet", mode="overwrite")
    assert T.ensure_table(spark, root, "marca") is False          # an existing table is left alone
    assert T.open_tables(spark, root, ["marca"])["marca"].count() == fx.marca.count()


def test_snapshots_and_latest_version(spark, fx):
    root = _tmp()
    assert T.latest_version(spark, root, "marca") is None
    T.write_snapshot(fx.marca, root, "marca", 0)
    T.write_snapshot(fx.marca.limit(3), root, "marca", 1)
    os.makedirs(f"{root}/marca/version=2")          # incomplete: no _SUCCESS
    assert T.latest_version(spark, root, "marca") == 1


def _request_json(headers, items):
    by = {}
    for it in items:
        by.setdefault(it["request_id"], []).append(it)
    out = []
    for h in headers:
        its = sorted(by.get(h["request_id"], []), key=lambda r: r["pos"])
        rec = {k: (v.strftime("%Y-%m-%dT%H:%M:%S") if isinstance(v, dt.datetime) else v) for k, v in h.items()}
        rec["items"] = [{"product_id": i["product_id"],
                         "quantity": None if i["quantity"] is None else float(i["quantity"]),
                         "unit_price": None if i["unit_price"] is None else float(i["unit_price"])} for i in its]
        out.append(json.dumps(rec))
    return out


def test_read_requests_flattens_and_keeps_malformed(spark):
    d = _tmp()
    with open(f"{d}/r.json", "w") as f:
        f.write('{"request_id": 1, "client_id": 5, "delivery_type": "deposito", '
                '"items": [{"product_id": 3, "quantity": 2, "unit_price": "1.5"}, {"product_id": 4, "quantity": "7"}]}\n')
        f.write('{"request_id": 2, "client_id": 5, "items": [\n')
    df = T.read_requests(spark, d)
    rows = df.collect()
    assert len(rows) == 2 and sum(r._corrupt_record is not None for r in rows) == 1
    heads, items = T.flatten_requests(df.where("_corrupt_record IS NULL"))
    got = sorted((r.pos, r.product_id, r.quantity, r.unit_price) for r in items.collect())
    assert got == [(1, 3, "2", "1.5"), (2, 4, "7", None)]


def test_intake_stream_equals_one_shot_sequential(spark, fx):
    heads = [r.asDict() for r in fx.request_headers.orderBy("request_id").collect()]
    items = [r.asDict() for r in fx.request_items.collect()]
    half = len(heads) // 2
    src, root = _tmp(), _tmp()
    for name, part in (("a.json", heads[:half]), ("b.json", heads[half:])):
        ids = {h["request_id"] for h in part}
        with open(f"{src}/{name}", "w") as f:
            f.write("\n".join(_request_json(part, [i for i in items if i["request_id"] in ids])) + "\n")
        time.sleep(1.1)
    d = fx.tables("productos", "pedidos", "detalle")
    intake.init_store(d, root)
    q = intake.start_order_intake(spark, src, root, clock=lambda: AS_OF, available_now=True,
                                  max_files_per_trigger=1, checkpoint_location=f"{_tmp()}/ckpt",
                                  compact_every=2)   # batch 2 also folds the moves into a new version
    q.awaitTermination(600)
    assert q.exception() is None
    state = intake.current_state(spark, root)
    want = P.post_orders(d, fx.request_headers, fx.request_items, AS_OF, mode="sequential")
    base = fx.pedidos.agg(F.max("ID_TomaPedido")).first()[0]
    got_ids = sorted(r.ID_TomaPedido for r in state["pedidos"].where(F.col("ID_TomaPedido") > base).collect())
    want_ids = sorted(r.ID_TomaPedido for r in want["orders"].collect())
    assert got_ids == want_ids
    got_stock = {r.ID_Producto: r.Stock for r in state["productos"].collect()}
    want_stock = {r.ID_Producto: r.Stock for r in want["products"].collect()}
    assert got_stock == want_stock
    assert T.latest_version(spark, root, "productos") == 2
    assert T.latest_version(spark, root, "productos", upto=1) == 0
    folded = {r.ID_Producto: r.Stock for r in spark.read.parquet(f"{root}/productos/version=2").collect()}
    assert folded == want_stock
    rej = spark.read.parquet(f"{root}/rejects")
    assert rej.count() == want["rejects"].count()
    lines = state["detalle"].where(F.col("ID_TomaPedido") > base)
    assert lines.count() == want["lines"].count()
    assert lines.agg(F.sum("Cantidad")).first()[0] == Decimal(want["lines"].agg(F.sum("Cantidad")).first()[0])


def test_restricted_stock_read_equals_full_read(spark, fx):
    root = _tmp()
    d = fx.tables("productos", "pedidos", "detalle")
    intake.init_store(d, root)
    moves = spark.createDataFrame([(int(r.ID_Producto), -2) for r in fx.productos.limit(20).collect()],
                                  "ID_Producto BIGINT, delta BIGINT")
    moves.write.parquet(f"{root}/stock_moves/batch=1")
    intake.compact(spark, root, 1)                                   # version 1 folds batch 1
    moves.limit(5).write.parquet(f"{root}/stock_moves/batch=2")
    wanted = fx.productos.limit(30).select("ID_Producto")
    full = {r.ID_Producto: r.Stock for r in intake.stock_state(spark, root, 3).collect()}
    part = {r.ID_Producto: r.Stock for r in intake.stock_state(spark, root, 3, wanted).collect()}
    assert set(part) == {r.ID_Producto for r in wanted.collect()}
    assert all(full[k] == v for k, v in part.items())
    base = {r.ID_Producto: r.Stock for r in fx.productos.collect()}
    hit_twice = {int(r.ID_Producto) for r in moves.limit(5).collect()}
    for k in hit_twice:
        # an unknown stock stays unknown
        assert full[k] == (None if base[k] is None else base[k] - 4)

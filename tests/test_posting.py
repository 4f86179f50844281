"""Order posting: one-by-one simulation of the sequential mode, invariants,
and the reference's per-request semantics on hand-made rows."""
import datetime as dt
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bodega.operators import posting as P
from bodega.sources.fixtures import Fixture

AS_OF = dt.datetime(2001, 8, 1)


def simulate(headers, items, products, per_product=False, clients=None, drivers=None):
    """Post requests one at a time in request_id order, as the reference does
    (``per_product``: an order's lines of one product are checked together; ``clients`` and
    ``drivers``: the ids that exist). An id sent twice is refused both times."""
    stock = {p["ID_Producto"]: p["Stock"] for p in products}
    by_req = defaultdict(list)
    for it in items:
        by_req[it["request_id"]].append(it)
    accepted, reasons = [], {}
    sent = Counter(h["request_id"] for h in headers)
    for h in sorted(headers, key=lambda r: r["request_id"]):
        its = sorted(by_req[h["request_id"]], key=lambda r: r["pos"])
        if sent[h["request_id"]] > 1:
            reasons[h["request_id"]] = "duplicate_request"
            continue
        if not h["client_id"] or not its:
            reasons[h["request_id"]] = "missing_data"
            continue
        if h["delivery_type"] == "por reparto" and not h["repartidor_id"]:
            reasons[h["request_id"]] = "missing_driver"
            continue
        if len(its) > 99:
            reasons[h["request_id"]] = "too_many_items"
            continue
        fail = None
        need = defaultdict(Decimal)
        for it in its:
            if it["quantity"] is not None:
                need[it["product_id"]] += it["quantity"]
        for it in its:
            if it["product_id"] not in stock:
                fail = "unknown_product"
                break
            q = need[it["product_id"]] if per_product else it["quantity"]
            if it["quantity"] is not None and (stock[it["product_id"]] or 0) < q:
                fail = "insufficient_stock"
                break
        if fail is None and clients is not None and h["client_id"] not in clients:
            fail = "unknown_client"
        if fail is None and drivers is not None and h["repartidor_id"] and h["repartidor_id"] not in drivers:
            fail = "unknown_driver"
        if fail is None and any(it["quantity"] is None for it in its):
            fail = "bad_number"
        if fail:
            reasons[h["request_id"]] = fail
            continue
        for it in its:  # Stock = Stock - q, truncated to INT toward zero
            stock[it["product_id"]] = int(Decimal(stock[it["product_id"]]) - it["quantity"])
        accepted.append(h["request_id"])
    return accepted, reasons, stock


def _rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("sf,hot_rows", [
    ("/root/testdata/sf0.001", None),
    ("/root/testdata/sf0.01", None),
    ("/root/testdata/sf0.001", "3"),        # every product with more than 3 orders range-split
])
def test_sequential_equals_one_by_one(spark, sf, hot_rows):
    if hot_rows:
        spark.conf.set("bodega.hotGroupRows", hot_rows)
    else:
        spark.conf.unset("bodega.hotGroupRows")
    fx = Fixture(spark, sf)
    d = fx.tables("productos", "pedidos", "detalle", "clientes", "repartidores")
    out = P.post_orders(d, fx.request_headers, fx.request_items, AS_OF, mode="sequential")
    acc, reasons, stock = simulate(_rows(fx.request_headers), _rows(fx.request_items),
                                   _rows(fx.productos.select("ID_Producto", "Stock")),
                                   clients={r[0] for r in fx.clientes.select("ID_Cliente").collect()},
                                   drivers={r[0] for r in fx.repartidores.select("ID_Repartidor").collect()})
    assert {"duplicate_request", "unknown_client", "insufficient_stock"} <= set(reasons.values())
    got_acc = sorted(r.request_id for r in out["orders"].select("request_id").collect())
    assert got_acc == sorted(acc)
    got_rej = {r.request_id: r.reason for r in out["rejects"].collect()}
    assert got_rej == reasons
    got_stock = {r.ID_Producto: r.Stock for r in out["products"].select("ID_Producto", "Stock").collect()}
    assert got_stock == stock
    # ids continue the identity in arrival order
    base = fx.pedidos.agg(F.max("ID_TomaPedido")).first()[0]
    ids = sorted((r.request_id, r.ID_TomaPedido) for r in out["orders"].collect())
    assert [i for _, i in ids] == list(range(base + 1, base + 1 + len(ids)))
    spark.conf.unset("bodega.hotGroupRows")


def test_opening_stock_invariants(spark, fx):
    d = fx.tables("productos", "pedidos", "detalle")
    out = P.post_orders(d, fx.request_headers, fx.request_items, AS_OF, mode="opening_stock")
    dec = out["decisions"]
    assert dec.count() == fx.request_headers.count()          # every request decided once
    n_acc = out["orders"].count()
    assert n_acc + out["rejects"].count() == dec.count()
    before = fx.productos.agg(F.sum("Stock")).first()[0]
    after = out["products"].agg(F.sum("Stock")).first()[0]
    taken = out["lines"].agg(F.sum(F.ceil("Cantidad"))).first()[0]
    assert before - taken == after
    # every accepted order's total is the sum of its lines
    tot = out["lines"].groupBy("ID_TomaPedido").agg(F.sum("ImporteconDto").alias("s"))
    bad = out["orders"].join(tot, "ID_TomaPedido").where(F.col("s") != F.col("Total"))
    assert bad.count() == 0


def _products(spark, rows):
    return spark.createDataFrame(rows, "ID_Producto long, PrecioFinalUni decimal(18,2), Stock int")


def _headers(spark, rows):
    return spark.createDataFrame(rows, "request_id long, order_id long, client_id long, delivery_type string, "
                                       "delivery_date timestamp_ntz, repartidor_id int, status string")


def _items(spark, rows):
    return spark.createDataFrame(rows, "request_id long, pos long, product_id long, quantity string, "
                                       "unit_price string")


def test_reference_semantics_on_hand_made_rows(spark):
    prods = _products(spark, [(1, Decimal("10.00"), 5), (2, Decimal("3.50"), 100), (3, None, 9)])
    heads = _headers(spark, [
        (1, None, 7, "deposito", None, None, None),          # two lines of one product: 4 + 4 > 5 yet accepted (S12)
        (2, None, 0, "deposito", None, None, None),          # client 0 is missing (S9)
        (3, None, 7, "por reparto", None, None, None),       # route without driver
        (4, None, 7, "deposito", None, None, None),          # no items
        (5, None, 7, "por reparto", None, 2, None),          # price given as 0 takes the product's price
        (6, None, 7, "deposito", None, None, None),          # unparsable quantity
        (7, None, 7, "deposito", None, None, None),          # negative quantity adds stock (S13)
        (8, None, 7, "deposito", None, None, None),          # 100 items (S16)
        (9, None, 7, "deposito", None, None, None),          # fractional quantity takes ceil (S14)
    ])
    items = [(1, 1, 1, "4", None), (1, 2, 1, "4", "2.5"),
             (3, 1, 2, "1", None), (5, 1, 2, "2", "0"), (6, 1, 2, "3abc", None),
             (7, 1, 2, "-2", None), (9, 1, 2, "1.5", None)]
    items += [(8, i, 2, "0", None) for i in range(1, 101)]
    out = P.post_orders({"productos": prods, "pedidos": spark.createDataFrame([(100,)], "ID_TomaPedido long")},
                        heads, _items(spark, items), AS_OF, mode="opening_stock")
    dec = {r.request_id: r.reason for r in out["decisions"].collect()}
    assert dec == {1: None, 2: "missing_data", 3: "missing_driver", 4: "missing_data", 5: None,
                   6: "bad_number", 7: None, 8: "too_many_items", 9: None}
    lines = {(r.request_id, r.Item): r for r in out["lines"].collect()}
    assert lines[(5, "01")].PrecioUnitario == Decimal("3.50")
    assert lines[(1, "02")].PrecioUnitario == Decimal("2.50") and lines[(1, "01")].PrecioUnitario == Decimal("10.00")
    assert lines[(1, "01")].IVA == Decimal("8.400000")
    stock = {r.ID_Producto: r.Stock for r in out["products"].collect()}
    assert stock == {1: 5 - 8, 2: 100 - 2 + 2 - 2, 3: 9}
    assert [(r.ID_Producto, r.Stock) for r in out["overdrafts"].collect()] == [(1, -3)]
    orders = {r.request_id: r for r in out["orders"].collect()}
    assert orders[1].ID_TomaPedido == 101 and orders[9].ID_TomaPedido == 104
    assert orders[1].FechaEntrega == AS_OF + dt.timedelta(days=7)
    assert orders[1].bDeposito == 1 and orders[5].bDeposito == 0 and orders[5].ID_Repartidor == 2
    assert orders[1].Estado == "Pendiente"


def test_item_number_never_cut(spark):
    from bodega.functions.exprs import item_number
    got = spark.range(1, 101).select(item_number(F.col("id")).alias("i")).collect()
    assert got[0].i == "01" and got[98].i == "99" and got[99].i == "100"


def test_set_order_status_latest_wins_and_unknown_rejected(spark):
    orders = spark.createDataFrame([(1, "Pendiente"), (2, "Pendiente")], "ID_TomaPedido long, Estado string")
    ch = spark.createDataFrame([(1, "En camino", 1), (1, "Entregado", 2), (9, "x", 3)],
                               "order_id long, status string, change_seq long")
    snap, rej = P.set_order_status(orders, ch)
    assert {r.ID_TomaPedido: r.Estado for r in snap.collect()} == {1: "Entregado", 2: "Pendiente"}
    assert [r.order_id for r in rej.collect()] == [9]
    assert [(r.ID_TomaPedido, r.Estado) for r in P.status_updates(orders, ch).collect()] == [(1, "Entregado")]


def test_replace_checks_against_own_give_back(spark):
    prods = _products(spark, [(1, Decimal("1.00"), 0), (2, Decimal("1.00"), 0)])
    orders = spark.createDataFrame(
        [(10, 7, dt.datetime(2001, 1, 1), dt.datetime(2001, 1, 8), 1, Decimal(5), Decimal(5), Decimal(0),
          Decimal(0), "Pendiente", None, 1, None, "A", 1)],
        "ID_TomaPedido long, ID_Cliente long, Fecha timestamp_ntz, FechaEntrega timestamp_ntz, ID_Condicion int, "
        "Total decimal(18,2), Apagar decimal(18,2), Dto decimal(18,2), CtaCte decimal(18,2), Estado string, "
        "Observaciones string, bDeposito smallint, ID_Repartidor int, Letra string, ID_Comprobante int")
    lines = spark.createDataFrame([(10, 1, Decimal("5.00"))], "ID_TomaPedido long, ID_Producto long, Cantidad decimal(18,2)")
    heads = _headers(spark, [(1, 10, 8, "deposito", None, None, None), (2, 99, 8, "deposito", None, None, None)])
    items = _items(spark, [(1, 1, 1, "5", None), (2, 1, 2, "1", None)])
    out = P.replace_orders({"pedidos": orders, "detalle": lines, "productos": prods}, heads, items, AS_OF)
    dec = {r.request_id: r.reason for r in out["decisions"].collect()}
    assert dec == {1: None, 2: "insufficient_stock"}
    o = out["orders"].first()
    assert o.ID_Cliente == 8 and o.Fecha == dt.datetime(2001, 1, 1) and o.Estado == "Pendiente"
    assert {r.ID_Producto: r.Stock for r in out["products"].collect()} == {1: 0, 2: 0}
    assert [r.ID_TomaPedido for r in out["replaced"].collect()] == [10]


def test_sequential_per_product_check_equals_one_by_one(spark):
    fx = Fixture(spark, "/root/testdata/sf0.01")
    out = P.post_orders(fx.tables("productos", "pedidos", "detalle"), fx.request_headers, fx.request_items, AS_OF,
                        mode="sequential", check="per_product")
    acc, reasons, stock = simulate(_rows(fx.request_headers), _rows(fx.request_items),
                                   _rows(fx.productos.select("ID_Producto", "Stock")), per_product=True)
    assert sorted(r.request_id for r in out["orders"].select("request_id").collect()) == sorted(acc)
    assert {r.request_id: r.reason for r in out["rejects"].collect()} == reasons
    assert {r.ID_Producto: r.Stock for r in out["products"].select("ID_Producto", "Stock").collect()} == stock


@pytest.mark.parametrize("mode", ["sequential", "opening_stock"])
def test_empty_and_fully_rejected_batches(spark, mode):
    prods = _products(spark, [(1, Decimal("10.00"), 5)])
    base = {"productos": prods, "pedidos": spark.createDataFrame([(100,)], "ID_TomaPedido long")}
    cases = [([(1, None, None, "deposito", None, None, None)], [(1, 1, 1, "1", None)], 0, 5),
             ([], [], 0, 5),
             ([(1, None, 7, "deposito", None, None, None)], [(1, 1, 1, "2", None)], 1, 3)]
    for heads, items, n_orders, stock in cases:
        out = P.post_orders(base, _headers(spark, heads), _items(spark, items), AS_OF, mode=mode)
        assert out["orders"].count() == n_orders
        assert [r.Stock for r in out["products"].collect()] == [stock]


@pytest.mark.parametrize("mode", ["sequential", "opening_stock"])
def test_unknown_stock_sells_nothing(spark, fx, mode):
    d = fx.tables("productos", "pedidos", "detalle")
    blank = d | {"productos": d["productos"].withColumn("Stock", F.lit(None).cast("int"))}
    out = P.post_orders(blank, fx.request_headers, fx.request_items, AS_OF, mode=mode)
    assert out["orders"].count() == 0
    assert "insufficient_stock" in {r.reason for r in out["rejects"].collect()}


def test_opening_stock_edits_store_narrow_rows_and_give_back_once(spark, monkeypatch):
    """Lines are stored as what amounts follow from, the old lines' give-back with them;
    several lines of a product in one edit give it back once."""
    kept, store = [], P.stored
    monkeypatch.setattr(P, "stored", lambda df: kept.append(df.columns) or store(df))
    products = _products(spark, [(1, Decimal("10"), 2), (2, Decimal("10"), 9), (3, Decimal("10"), 5)])
    orders = spark.createDataFrame([(i, 1, "P") for i in (7, 8)], "ID_TomaPedido long, ID_Cliente long, Estado string").withColumns({
        "Fecha": F.lit(AS_OF), "FechaEntrega": F.lit(AS_OF), **{c: F.lit(0).cast("decimal(18,2)") for c in ("Total", "Apagar", "Dto", "CtaCte")},
        "bDeposito": F.lit(0).cast("smallint"), "ID_Repartidor": F.lit(None).cast("int")})
    old = spark.createDataFrame([(7, 1, 3), (7, 3, 2), (7, None, 4), (8, 2, 1)], "ID_TomaPedido long, ID_Producto long, q int").select(
        "ID_TomaPedido", "ID_Producto", F.col("q").cast("decimal(18,2)").alias("Cantidad"))
    heads = _headers(spark, [(i, i + 6, 1, "deposito", None, None, None) for i in (1, 2)])
    items = _items(spark, [(1, 1, 1, "5", None), (1, 2, 1, "2", None), (1, 3, 2, "1", None), (2, 1, 3, "6", None)])
    out = P.replace_orders({"productos": products, "pedidos": orders, "detalle": old}, heads, items, AS_OF, mode="opening_stock")
    assert {r.ID_Producto: r.Stock for r in out["products"].collect()} == {1: 2 + 3 - 7, 2: 9 - 1, 3: 5 + 2}
    assert [(r.request_id, r.reason) for r in out["rejects"].collect()] == [(2, "insufficient_stock")]
    assert sorted((r.ID_TomaPedido, r.ID_Producto, int(r.Cantidad)) for r in out["added_lines"].collect()) == [(7, 1, 2), (7, 1, 5), (7, 2, 1)]
    assert len(kept) == 3 and not any({"amount", "vat", "Item"} & set(c) for c in kept)


def test_opening_stock_edits_join_in_place_and_read_their_lines_once(spark, fx, monkeypatch):
    """The lines cross no shuffle of their own to meet what the old ones give back, and the
    stock follows from one pass over both; the session's setting is as before."""
    key, plans, store = "spark.sql.requireAllClusterKeysForCoPartition", [], P.stored

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df)

    monkeypatch.setattr(P, "stored", seen)
    before, limit = spark.conf.get(key), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = fx.tables("productos", "pedidos", "detalle", "clientes", "repartidores")
        out = P.replace_orders(d, fx.edit_headers, fx.edit_items, AS_OF, mode="opening_stock")
        moves = out["moves"]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert spark.conf.get(key) == before
    assert not [x for x in plans[1].splitlines() if "Exchange hashpartitioning(request_id" in x and "product_id" in x]
    assert moves.count("FileScan") == 2  # the lines and the decisions

"""Order posting as batch jobs.

The reference posts one order per HTTP call: one product lookup per item,
a stock check per item, inserts, and ``Stock = Stock - q`` per line inside a
transaction. Here a whole batch of requests is one plan: items are joined
to the products once, checked, aggregated per order, and accepted or
rejected as a unit; the outputs are the new order headers and lines, the
new product snapshot and the rejects.

Requests come flat: ``headers`` (request_id, order_id, client_id,
delivery_type, delivery_date, repartidor_id, status) and ``items``
(request_id, pos, product_id, quantity, unit_price); nested JSON bodies
are flattened by ``bodega.sources.tables.flatten_requests``.

Modes for several requests touching the same product:
  ``opening_stock``  every order is checked against the stock at the start;
  ``sequential``     each order sees the stock left by the accepted orders
                     before it (request_id order), as one-by-one posting does.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from bodega.functions.exprs import (DEFAULT_DELIVERY_DAYS, DELIVERY_ROUTE, MAX_ITEMS, STATE_PENDING, VAT_RATE,
                                    deposit_flag, falsy_number, item_number, shift_days, ts)
from bodega.functions.sequence import stored, unsent
from bodega.operators.changes import assign_ids

MONEY = "decimal(18,2)"


def _falsy(df: DataFrame, c: str) -> Column:
    """JavaScript falsiness of a field, by its type."""
    t = df.schema[c].dataType
    if isinstance(t, StringType):
        # a JSON number read as text: 0 is missing, as the number 0 is in JS
        return F.col(c).isNull() | (F.col(c) == "") | F.coalesce(F.col(c).try_cast("double") == 0, F.lit(False))
    if isinstance(t, NumericType):
        return falsy_number(F.col(c))
    return F.col(c).isNull()


# ---- P1 -------------------------------------------------------------------
def validate_requests(headers: DataFrame, items: DataFrame) -> DataFrame:
    """Headers with ``n_items`` and ``reject_reason`` (first failing rule, or NULL).

    Requests that share a ``request_id`` are all rejected: their items cannot be
    told apart. Needs a client and at least one item; 'por reparto' needs a driver.
    More than 99 items cannot be numbered in the two-character ``Item``."""
    counts = items.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_items"))
    again = (headers.groupBy("request_id").agg(F.count(F.lit(1)).alias("_sent")).where("_sent > 1")
             .select("request_id", F.lit(True).alias("_again")))
    h = headers.join(counts, "request_id", "left").join(again, "request_id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    reason = (F.when(F.col("_again"), F.lit("duplicate_request"))
              .when(_falsy(h, "client_id") | (F.col("n_items") == 0), F.lit("missing_data"))
              .when((F.col("delivery_type") == DELIVERY_ROUTE) & _falsy(h, "repartidor_id"), F.lit("missing_driver"))
              .when(F.col("n_items") > MAX_ITEMS, F.lit("too_many_items")))
    return h.withColumn("reject_reason", reason).drop("_again")


def check_parties(v: DataFrame, headers: DataFrame, parties: dict | None) -> DataFrame:
    """``late_reason``: a client or driver that does not exist, the foreign keys a
    header meets when it is written. ``parties``: the tables ``clientes`` and
    ``repartidores``; the key of a table that is not given is not checked.

    The keys a header names are made distinct first (with map-side combining), so a
    client with very many orders crosses the shuffle once."""
    missing = F.lit(None).cast("string")
    for table, key, col, why in (("repartidores", "ID_Repartidor", "repartidor_id", "unknown_driver"),
                                 ("clientes", "ID_Cliente", "client_id", "unknown_client")):
        if parties is None or table not in parties:
            continue
        named = headers.where(~_falsy(headers, col)).select(F.col(col).alias("_named")).distinct()
        known = parties[table].select(F.col(key).alias("_named"))
        bad = named.join(known, "_named", "left_anti").withColumn(f"_no_{col}", F.lit(True))
        v = v.join(bad, v[col] == bad["_named"], "left").drop("_named")
        missing = F.when(F.col(f"_no_{col}"), F.lit(why)).otherwise(missing)
    return v.withColumn("late_reason", missing).drop("_no_repartidor_id", "_no_client_id")


# ---- P2 -------------------------------------------------------------------
def price_lines(items: DataFrame, products: DataFrame) -> DataFrame:
    """One row per item, joined to its product (one join replaces a lookup per item).

    quantity and unit price are parsed with try_cast (unparsable -> NULL ->
    ``bad_number``); a missing, zero or NaN unit price takes the product's
    final unit price; amount = price x quantity, VAT 21 % of the amount;
    ``Item`` is the two-digit position."""
    return _amounts(_priced(items, products))


def _priced(items: DataFrame, products: DataFrame, *extra: str) -> DataFrame:
    """What a priced line is made of, and the columns ``extra`` of the items."""
    p = products.select(F.col("ID_Producto").alias("product_id"), "PrecioFinalUni",
                        F.col("Stock").alias("stock_open"), F.lit(True).alias("found"))
    x = items.join(p, "product_id", "left")
    given = F.col("unit_price").try_cast(MONEY)
    price = F.when(_falsy(items, "unit_price"), F.col("PrecioFinalUni").cast(MONEY)).otherwise(given)
    return x.select("request_id", "pos", "product_id", F.col("quantity").try_cast(MONEY).alias("quantity"), price.alias("unit_price"),
                    F.coalesce(F.col("found"), F.lit(False)).alias("found"), "stock_open", *extra)


def _amounts(priced: DataFrame, *extra: str) -> DataFrame:
    """The lines of ``_priced`` with what follows from them: amount, vat, Item and bad_number."""
    q, price = F.col("quantity"), F.col("unit_price")
    amount = (price * q).cast("decimal(18,4)")
    return priced.select(
        "request_id", "pos", "product_id",
        "quantity", "unit_price",
        amount.alias("amount"),
        (amount * F.lit(VAT_RATE)).alias("vat"),
        item_number(F.col("pos")).alias("Item"),
        "found",
        (q.isNull() | price.isNull()).alias("bad_number"),
        "stock_open", *extra,
    )


# ---- P3 -------------------------------------------------------------------
def _line_failure(stock: Column, need: Column) -> Column:
    """A product without a stock figure has none to sell."""
    return (F.when(~F.col("found"), F.lit("unknown_product"))
            .when(F.coalesce(stock, F.lit(0)) < need, F.lit("insufficient_stock")))


def _need(lines: DataFrame, check: str) -> DataFrame:
    """``need``: what the stock is compared with on each line. ``per_line``
    (the reference) compares each line alone; ``per_product`` the order's
    total of that product."""
    if check == "per_line":
        return lines.withColumn("need", F.col("quantity"))
    tot = lines.groupBy("request_id", "product_id").agg(F.sum("quantity").alias("need"))
    return lines.join(tot, ["request_id", "product_id"], "left")


def decide(headers: DataFrame, lines: DataFrame, stock_before: Column, late: str | None = None) -> DataFrame:
    """Per request: accepted flag, reason and total, given each line's stock
    before the order. The reason is the header's, else the failing line of
    lowest position, else ``late`` (a header column of failures met only
    when writing), else a bad number."""
    fails = lines.withColumn("_fail", _line_failure(stock_before, F.col("need")))
    per = fails.groupBy("request_id").agg(
        F.min_by("_fail", F.when(F.col("_fail").isNotNull(), F.col("pos"))).alias("line_reason"),
        F.max(F.col("bad_number").cast("int")).alias("_bad"),
        F.sum("amount").alias("total"))
    out = headers.join(per, "request_id", "left")
    late_col = F.col(late) if late else F.lit(None).cast("string")
    reason = F.coalesce(F.col("reject_reason"), F.col("line_reason"), late_col,
                        F.when(F.col("_bad") == 1, F.lit("bad_number")))
    return out.withColumn("reason", reason).withColumn("accepted", reason.isNull()).drop("_bad", "line_reason")


def check_stock(headers: DataFrame, items: DataFrame, products: DataFrame, check: str = "per_line",
                parties: dict | None = None) -> DataFrame:
    """P3 against the opening stock: one row per request with ``accepted``,
    ``reason`` and ``total`` (``parties``: see ``check_parties``)."""
    v = check_parties(validate_requests(headers, items), headers, parties)
    lines = _need(price_lines(items, products), check)
    return decide(v, lines, F.col("stock_open"), late="late_reason")


# ---- P4 / P5 ----------------------------------------------------------------
def order_totals(lines: DataFrame) -> DataFrame:
    """Order total (also the amount to pay) = sum of the line amounts."""
    return lines.groupBy("request_id").agg(F.sum("amount").alias("total"))


def take(q: Column) -> Column:
    """Stock taken by a line: ``Stock - q`` truncated to INT, i.e. ceil(q)
    while the result stays >= 0."""
    return F.ceil(q).cast("long")


def give_back(q: Column) -> Column:
    """Stock returned by a removed line: ``Stock + q`` truncated, i.e. floor(q)."""
    return F.floor(q).cast("long")


def stock_movements(lines: DataFrame) -> DataFrame:
    """P5: net stock change per product of the given (accepted) lines."""
    return lines.groupBy("product_id").agg((-F.sum(take(F.col("quantity")))).alias("delta"))


def apply_stock(products: DataFrame, moves: DataFrame) -> DataFrame:
    """Products with ``Stock + delta``; untouched products keep their stock.
    ``moves`` has one row per product (it is an aggregate)."""
    m = moves.select(F.col("product_id").alias("ID_Producto"), "delta")
    j = products.join(m, "ID_Producto", "left")
    return j.select(*[(F.col("Stock") + F.coalesce(F.col("delta"), F.lit(0))).cast("int").alias("Stock")
                      if c == "Stock" else F.col(c) for c in products.columns])


# ---- P6 -------------------------------------------------------------------
class OnDemand(Mapping):
    """Named outputs, each built when it is first asked for."""

    def __init__(self, **makers: Callable[[], DataFrame]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def post_orders(d: dict, headers: DataFrame, items: DataFrame, as_of, mode: str = "sequential",
                check: str = "per_line") -> Mapping[str, DataFrame]:
    """Post a batch of order requests.

    Returns ``orders`` (new headers with new ids), ``lines`` (their lines),
    ``products`` (the snapshot with stock taken), ``rejects`` (request_id,
    reason), ``decisions`` (every request with accepted/reason/total),
    ``moves`` (net stock change per product) and ``overdrafts`` (products
    left below zero, where fractional quantities can make the reference's
    per-line truncation differ from ``ceil``; ``stock.walk_stock`` follows it
    exactly). Requests are decided at once, the outputs are built when asked for."""
    products = d["productos"]
    if mode == "sequential":
        from bodega.operators.order_log import decide_log
        log = headers.withColumns({"method": F.lit("POST"), "created_by": F.lit(None).cast("long")})
        out = decide_log(d, log, items, check)
        dec, lines = out["decisions"], out["lines"]
    elif mode == "opening_stock":
        v = check_parties(validate_requests(headers, items), headers, d)
        lines = _need(price_lines(items, products), check)
        dec = stored(decide(v, lines, F.col("stock_open"), late="late_reason"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    acc = dec.where(F.col("accepted"))

    def orders() -> DataFrame:
        new = assign_ids(d["pedidos"], acc.select(
            "request_id", F.lit(None).cast("long").alias("ID_TomaPedido"), "client_id", "delivery_type",
            "delivery_date", "repartidor_id", "total"), "ID_TomaPedido", ["request_id"])
        return new.select(
            "ID_TomaPedido", "request_id",
            F.lit("A").alias("Letra"), F.lit(1).alias("ID_Comprobante"),
            F.col("client_id").alias("ID_Cliente"),
            ts(as_of).alias("Fecha"),
            F.coalesce(F.col("delivery_date"), shift_days(as_of, DEFAULT_DELIVERY_DAYS)).alias("FechaEntrega"),
            F.lit(0).cast(MONEY).alias("Dto"),
            F.col("total").alias("Total"), F.col("total").alias("Apagar"),
            F.lit(0).cast(MONEY).alias("CtaCte"),
            F.lit(STATE_PENDING).alias("Estado"),
            deposit_flag(F.col("delivery_type")).alias("bDeposito"),
            F.when(_falsy(new, "repartidor_id"), F.lit(None)).otherwise(F.col("repartidor_id"))
             .cast("int").alias("ID_Repartidor"))

    def new_lines() -> DataFrame:
        ids = made["orders"].select("request_id", "ID_TomaPedido")
        return lines.join(unsent(ids), "request_id").select(
            "ID_TomaPedido", "request_id", F.col("product_id").alias("ID_Producto"),
            F.col("vat").alias("IVA"), F.col("unit_price").alias("PrecioUnitario"),
            F.col("quantity").alias("Cantidad"),
            F.lit(0).cast(MONEY).alias("RestoIVA"), F.lit(0).cast(MONEY).alias("Dto"),
            F.col("amount").alias("ImporteconDto"), "Item")

    def overdrafts() -> DataFrame:
        touched = made["moves"].where(F.col("delta") != 0).select(F.col("product_id").alias("ID_Producto"))
        return made["products"].join(touched, "ID_Producto", "left_semi").where(F.col("Stock") < 0).select("ID_Producto", "Stock")

    made = OnDemand(
        orders=orders, lines=new_lines, overdrafts=overdrafts, decisions=lambda: dec,
        moves=lambda: stock_movements(lines.join(unsent(acc.select("request_id")), "request_id", "left_semi")),
        products=lambda: apply_stock(products, made["moves"]),
        rejects=lambda: dec.where(~F.col("accepted")).select("request_id", "reason"))
    return made


# ---- P7 -------------------------------------------------------------------
@contextmanager
def _joined_in_place(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside join a side by several keys where it lies if it is dealt by one of
    them: only the other side crosses a shuffle."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def replace_orders(d: dict, headers: DataFrame, items: DataFrame, as_of, check: str = "per_line",
                   mode: str = "sequential") -> Mapping[str, DataFrame]:
    """Full edit of existing orders.

    Old lines give their stock back, new lines are priced and checked; an accepted
    edit replaces the lines and updates client, delivery date, totals, delivery type
    and driver, keeping the date and state; a rejected edit changes nothing. An unknown
    order id is rejected (its new lines would have no order).

    ``sequential``: edits apply one after another in request_id order, any number per
    order, each checked against the stock the accepted ones before it left plus what
    its order holds by then. ``opening_stock``: one edit per order, the latest request
    (earlier ones are rejected as ``superseded``), each checked against the opening stock
    plus the order's own give-back, whatever the other edits take."""
    if mode == "sequential":
        from bodega.operators.order_log import apply_log
        log = headers.withColumns({"method": F.lit("PUT"), "created_by": F.lit(None).cast("long"), "status": F.lit(None).cast("string")})
        return apply_log(d, log, items, as_of, check)
    if mode != "opening_stock":
        raise ValueError(f"unknown mode {mode!r}")
    orders, old_lines, products = d["pedidos"], d["detalle"], d["productos"]
    latest = headers.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(
        F.max("request_id").alias("request_id")).withColumn("_latest", F.lit(True))
    sent = stored(headers.join(latest, ["order_id", "request_id"], "left").select(*headers.columns, "_latest"))
    h = sent.where("_latest").drop("_latest")
    it = items.select("request_id", "pos", "product_id", "quantity", "unit_price").join(h.select("request_id"), "request_id", "left_semi")
    v = validate_requests(h, items)  # items of other requests are counted, but join none
    known = orders.select(F.col("ID_TomaPedido").alias("order_id"), F.lit(True).alias("_known"))
    v = check_parties(v, h, d).join(known, "order_id", "left").withColumn(
        "late_reason", F.when(F.col("_known").isNull(), F.lit("not_found")).otherwise(F.col("late_reason"))).drop("_known")
    back = (old_lines.join(h.select(F.col("order_id").alias("ID_TomaPedido"), "request_id"), "ID_TomaPedido")
            .select("request_id", F.col("ID_Producto").alias("product_id"), give_back(F.col("Cantidad")).alias("back"))
            .repartition("request_id").groupBy("request_id", "product_id").agg(F.sum("back").alias("back")))
    # Read by the decision, the stock and the new lines: the lines and what the old ones give
    # back, in one table, as narrow as they cross a shuffle; the amounts follow from it.
    both = it.withColumn("_line", F.lit(True)).join(back, ["request_id", "product_id"], "full")
    with _joined_in_place(both.sparkSession):
        both = stored(_priced(both, products, "back", "_line"))
    priced = both.where("_line").drop("_line")
    lines = _need(_amounts(priced, "back"), check)
    dec = decide(v, lines, F.coalesce(F.col("stock_open"), F.lit(0)) + F.coalesce(F.col("back"), F.lit(0)), late="late_reason")
    passed_over = sent.where("_latest IS NULL").select(
        "request_id", "order_id", F.lit(False).alias("accepted"),
        F.when(F.col("order_id").isNull(), F.lit("not_found")).otherwise(F.lit("superseded")).alias("reason"))
    dec = stored(dec.unionByName(passed_over, allowMissingColumns=True))
    acc = dec.where(F.col("accepted")).select("request_id", "order_id", "client_id", "delivery_type",
                                              "delivery_date", "repartidor_id", "total")
    upd = acc.select(
        F.col("order_id").alias("ID_TomaPedido"), F.col("client_id").alias("_c"),
        F.coalesce(F.col("delivery_date"), shift_days(as_of, DEFAULT_DELIVERY_DAYS)).alias("_fe"),
        F.col("total").alias("_t"), deposit_flag(F.col("delivery_type")).alias("_dep"),
        F.when(_falsy(acc, "repartidor_id"), F.lit(None)).otherwise(F.col("repartidor_id")).cast("int").alias("_rep"),
        F.lit(True).alias("_hit"))
    j = orders.join(upd, "ID_TomaPedido", "left")
    hit = F.col("_hit").isNotNull()
    repl = {"ID_Cliente": "_c", "FechaEntrega": "_fe", "Total": "_t", "Apagar": "_t", "bDeposito": "_dep",
            "ID_Repartidor": "_rep"}
    new_orders = j.select(*[F.when(hit, F.col(repl[c])).otherwise(F.col(c)).cast(orders.schema[c].dataType).alias(c)
                            if c in repl else F.col(c) for c in orders.columns])
    edited = acc.select(F.col("order_id").alias("ID_TomaPedido"), "request_id")
    kept_lines = old_lines.join(edited.select("ID_TomaPedido"), "ID_TomaPedido", "left_anti")
    added = _amounts(priced.join(edited, "request_id"), "ID_TomaPedido").select(
        "ID_TomaPedido", F.col("product_id").alias("ID_Producto"), F.col("quantity").alias("Cantidad"),
        F.col("unit_price").alias("PrecioUnitario"), F.col("amount").alias("ImporteconDto"),
        F.col("vat").alias("IVA"), F.lit(0).cast(MONEY).alias("RestoIVA"), F.lit(0).cast(MONEY).alias("Dto"), "Item")
    # per order and product first: what the old lines give back counts once, not per new line
    per = both.join(edited, "request_id", "left_semi").groupBy("request_id", "product_id").agg(
        F.max("back").alias("b"), F.sum(take(F.col("quantity"))).alias("t"))
    moves = per.groupBy("product_id").agg(
        (F.coalesce(F.sum("b"), F.lit(0)) - F.coalesce(F.sum("t"), F.lit(0))).alias("delta"))
    rejects = dec.where(~F.col("accepted")).select("request_id", "order_id", "reason")
    return {"orders": new_orders, "kept_lines": kept_lines, "added_lines": added,
            "products": apply_stock(products, moves), "rejects": rejects, "decisions": dec,
            # for stores that rewrite only what changed (a partition overwrite, or MERGE
            # on a catalog with row-level operations): the orders whose lines were replaced
            "replaced": edited.select("ID_TomaPedido"), "moves": moves}


# ---- P8 -------------------------------------------------------------------
def status_updates(orders: DataFrame, changes: DataFrame) -> DataFrame:
    """P8 as row changes only: (ID_TomaPedido, Estado) for the orders whose
    state the batch sets, for a MERGE or a partition rewrite."""
    latest = changes.groupBy(F.col("order_id").alias("ID_TomaPedido")).agg(
        F.max_by("status", "change_seq").alias("Estado"))
    return latest.join(orders.select("ID_TomaPedido"), "ID_TomaPedido", "left_semi")


def set_order_status(orders: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State-only change (any text). The latest change per order wins;
    changes for unknown orders are returned as rejects."""
    latest = changes.groupBy("order_id").agg(F.max_by("status", "change_seq").alias("_new"))
    j = orders.join(latest.withColumnRenamed("order_id", "ID_TomaPedido"), "ID_TomaPedido", "left")
    snap = j.select(*[F.coalesce(F.col("_new"), F.col("Estado")).alias("Estado") if c == "Estado" else F.col(c)
                      for c in orders.columns])
    rejects = changes.join(orders.select(F.col("ID_TomaPedido").alias("order_id")), "order_id", "left_anti")
    return snap, rejects

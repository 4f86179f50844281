"""Posts, edits and status changes as one log, applied in order of arrival.

The reference handles one request after another: an order posted now takes stock that
a later one does not find, an edit gives back what its order holds at that moment, and
a request may name an order that an earlier one created. Here the whole log is one
batch job with the same result: ``settle`` finds the accepted events without walking
the log one by one, and the tables follow from them.

A log row has request_id (its place in the order of arrival), method ('POST' or 'PUT'),
the order it names (order_id of one that exists, or created_by: the request_id of the
POST in the same log that creates it), and the fields of a request. A PUT with a status
and no items changes the state only; any other PUT is a full edit.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bodega.functions.exprs import (DEFAULT_DELIVERY_DAYS, STATE_PENDING, deposit_flag, falsy_text, shift_days, ts)
from bodega.functions.sequence import stored, unsent
from bodega.functions.settlement import ACCEPTED, BASE_TIME, OPEN, Hot, settle, stock_bounds
from bodega.operators import posting as P
from bodega.operators.changes import assign_ids

POST, EDIT, STATUS = "post", "edit", "status"


def classify(log: DataFrame, items: DataFrame, orders: DataFrame, parties: dict | None) -> DataFrame:
    """The log with kind, o (the key of its order), n_items, reject_reason and
    late_reason (met when writing: an order, client or driver that does not exist)."""
    v = P.check_parties(P.validate_requests(log, items), log, parties)
    kind = (F.when(F.col("method") == "POST", F.lit(POST))
            .when(~falsy_text(F.col("status")) & (F.col("n_items") == 0), F.lit(STATUS)).otherwise(F.lit(EDIT)))
    o = (F.when(F.col("kind") == POST, F.concat(F.lit("n"), F.col("request_id").cast("string")))
         .when(F.col("order_id").isNotNull(), F.concat(F.lit("o"), F.col("order_id").cast("string")))
         .otherwise(F.concat(F.lit("n"), F.col("created_by").cast("string"))))
    v = v.withColumn("kind", kind).withColumn("o", o)
    old = orders.select(F.concat(F.lit("o"), F.col("ID_TomaPedido").cast("string")).alias("o"), F.lit(BASE_TIME).alias("_since"))
    # an id sent twice names no single order
    made = v.where((F.col("kind") == POST) & ~F.coalesce(F.col("reject_reason") == "duplicate_request", F.lit(False)))
    known = old.unionByName(made.select("o", F.col("request_id").alias("_since")))
    named = v.where((F.col("kind") != POST) & F.col("o").isNotNull()).select("o").distinct().join(known, "o")
    v = v.join(named, "o", "left")
    lost = (F.col("kind") != POST) & ~F.coalesce(F.col("_since") < F.col("request_id"), F.lit(False))
    reject = F.when(F.col("kind") != STATUS, F.col("reject_reason")).when(F.col("reject_reason") == "duplicate_request", F.col("reject_reason"))
    late = F.when(lost, F.lit("not_found")).when(F.col("kind") != STATUS, F.col("late_reason"))
    return v.withColumn("reject_reason", reject).withColumn("late_reason", late).drop("_since")


def _versions(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """Per event and product: take, give, need, stock_open. A product without a stock
    figure has none to sell and keeps none."""
    counted = F.col("stock_open").isNotNull()
    take = F.when(counted, P.take(F.col("quantity"))).otherwise(F.lit(0))
    give = F.when(counted, P.give_back(F.col("quantity"))).otherwise(F.lit(0))
    return (lines.join(keys, "request_id").groupBy("o", F.col("request_id").alias("t"), F.col("product_id").alias("p"))
            .agg(F.sum(take).cast("long").alias("take"), F.sum(give).cast("long").alias("give"), F.max("need").alias("need"), F.first("stock_open").alias("stock_open")))


def _base_versions(old_lines: DataFrame, products: DataFrame, named: DataFrame) -> DataFrame:
    """What orders that the log edits hold before it. ``named``: o, ID_TomaPedido."""
    stock = products.select(F.col("ID_Producto"), F.col("Stock").alias("stock_open"))
    # the key of the order is made last: it is longer than the number
    held = (old_lines.select("ID_TomaPedido", "ID_Producto", "Cantidad").join(named, "ID_TomaPedido", "left_semi").groupBy("ID_TomaPedido", "ID_Producto")
            .agg(F.sum(P.give_back(F.col("Cantidad"))).cast("long").alias("give")).join(stock, "ID_Producto"))
    o = F.concat(F.lit("o"), F.col("ID_TomaPedido").cast("string")).alias("o")
    return held.select(o, F.lit(BASE_TIME).alias("t"), F.col("ID_Producto").alias("p"), F.lit(0).cast("long").alias("take"),
                       F.when(F.col("stock_open").isNotNull(), F.col("give")).otherwise(F.lit(0)).cast("long").alias("give"),
                       F.lit(None).cast("decimal(18,2)").alias("need"), "stock_open")


def _single(rows: DataFrame, key: str) -> bool:
    """Whether no value of ``key`` repeats."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty()


def decide_log(d: dict, log: DataFrame, items: DataFrame, check: str = "per_line", progress=None) -> dict[str, DataFrame]:
    """Who is accepted. Returns ``decisions`` (the classified log with accepted, reason,
    total), ``lines`` (priced items), ``versions`` and ``live`` (o, t, st of the accepted
    events and of the base versions of edited orders)."""
    v = stored(classify(log, items, d["pedidos"], d))
    stocked = v.where(F.col("kind") != STATUS)
    keys = stocked.where(~F.coalesce(F.col("reject_reason") == "duplicate_request", F.lit(False))).select("request_id", "o")
    # stored as narrow as they cross a shuffle: the amounts follow from the lines
    priced = stored(P._need(P._priced(items.join(keys.select("request_id"), "request_id", "left_semi"), d["productos"]), check))
    lines = P._amounts(priced, "need")
    # enough of everything: the reasons that do not depend on stock
    static = stored(P.decide(stocked, lines, F.col("need"), late="late_reason"))
    candidates = static.where(F.col("accepted")).select("request_id", "o", "kind")
    edits = not candidates.where(F.col("kind") == EDIT).isEmpty()
    versions = _versions(lines, candidates.select("request_id", "o"))
    events = candidates.select("o", F.col("request_id").alias("t"), F.lit(OPEN).alias("st"), "kind")
    if edits:
        # of edits that fall for another reason too: what they would have found is part of the answer
        named = keys.where(F.col("o").startswith("o")).select("o", F.substring("o", 2, 30).cast("long").alias("ID_TomaPedido")).distinct()
        versions = versions.unionByName(_base_versions(d["detalle"], d["productos"], named))
        events = events.unionByName(named.select("o", F.lit(BASE_TIME).alias("t"), F.lit(ACCEPTED).alias("st"), F.lit("base").alias("kind")))
    versions, events = stored(versions), stored(events)
    passed = settle(versions, events, edits, progress)
    live = stored(passed.unionByName(events.where(F.col("kind") == "base").select("o", "t")).select("o", "t", F.lit(ACCEPTED).alias("st")))

    states = not v.where(F.col("kind") == STATUS).isEmpty()

    def fated(rows: DataFrame) -> DataFrame:
        """``rows`` with _fell: a request for an order that the log was to create falls with it."""
        if not edits and not states:
            return rows.withColumn("_fell", F.lit(False))
        made = live.where(F.col("o").startswith("n")).select("o", F.lit(True).alias("_made")).distinct()
        fell = (F.col("kind") != POST) & F.col("o").startswith("n") & F.col("_made").isNull()
        fate = {"_fell": F.coalesce(fell, F.lit(False)), "late_reason": F.when(fell, F.lit("not_found")).otherwise(F.col("late_reason"))}
        return rows.join(made, "o", "left").withColumns(fate).drop("_made")

    # what the lines found, now that the accepted events are known, for the reasons
    if _single(d["productos"], "ID_Producto") and (not edits or _single(candidates.where(F.col("kind") == EDIT), "request_id")):
        passed = live.where(F.col("t") != BASE_TIME).select(F.col("t").alias("request_id"), F.lit(True).alias("_passed"))
        said = stored(fated(static.join(passed, "request_id", "left")))
        # what passes all but the stock is settled: it is accepted, or found too little; so is what its header rejects
        waits = F.col("reject_reason").isNull() & ~(F.col("accepted") & ~F.col("_fell"))
        short = F.when(F.col("accepted") & F.col("_passed").isNull(), F.lit("insufficient_stock"))
        settled = said.where(~waits).withColumn("reason", F.coalesce("reason", short)).withColumn("accepted", F.col("reason").isNull())
        state = fated(v.where(F.col("kind") == STATUS)).withColumns({
            "total": F.lit(None).cast(static.schema["total"].dataType), "reason": F.coalesce("reject_reason", "late_reason")})
        settled = settled.unionByName(state.withColumn("accepted", F.col("reason").isNull()), allowMissingColumns=True)
        rest = said.where(waits).select(v.columns)
        checked = ["request_id", "pos", "product_id", "need", "found", "stock_open", "bad_number", "amount"]
        lines_left = stored(lines.select(*checked).join(rest.select("request_id"), "request_id", "left_semi"))
        edited = rest.where(F.col("kind") == EDIT).select("o").distinct() if edits else None
        of = rest.select("request_id", "o")
    else:
        # where keys repeat, lines are checked one by one against the rows they meet
        settled, rest, lines_left, of = None, fated(v).select(v.columns), lines, keys
        edited = stocked.where(F.col("kind") == EDIT).select("o").distinct() if edits else None
    asked = lines_left.where(F.col("found")).select("request_id", F.col("product_id").alias("p")).distinct().join(of, "request_id")
    asked = asked.select(F.coalesce("o", F.lit("")).alias("o"), F.col("request_id").alias("t"), "p")
    found = stock_bounds(versions.join(live, ["o", "t"], "left_semi").select("o", "t", "p", "take", "give"), live, asked, edits, edited,
                         Hot.of(versions, events, edited))
    lines_found = lines_left.join(found.select(F.col("t").alias("request_id"), F.col("p").alias("product_id"), "lo"), ["request_id", "product_id"], "left")
    dec = P.decide(rest, lines_found, F.coalesce(F.col("stock_open"), F.lit(0)) + F.coalesce(F.col("lo"), F.lit(0)), late="late_reason")
    if settled is not None:
        dec = dec.unionByName(settled.select(dec.columns))
    return {"decisions": stored(dec), "lines": lines, "versions": versions, "live": live}


def stock_moves(versions: DataFrame, live: DataFrame) -> DataFrame:
    """Net stock change per product: every live version takes, and gives back when another
    of its order follows it (``live``: o, t)."""
    last = live.groupBy("o").agg(F.max("t").alias("_last"))
    held = versions.join(unsent(live.select("o", "t")), ["o", "t"], "left_semi").join(unsent(last), "o")
    back = F.when(F.col("t") < F.col("_last"), F.col("give")).otherwise(F.lit(0))
    return held.groupBy(F.col("p").alias("product_id")).agg(F.sum(back - F.col("take")).alias("delta"))


def apply_log(d: dict, log: DataFrame, items: DataFrame, as_of, check: str = "per_line", progress=None) -> Mapping[str, DataFrame]:
    """Apply a log to the tables ``d`` (productos, pedidos, detalle and, to be checked,
    clientes and repartidores).

    Returns ``orders`` (the next snapshot: edited, changed and new orders; request_id of
    the POST for new ones), ``kept_lines`` and ``added_lines`` (of the orders whose lines
    the log sets, as their last accepted version has them), ``products``, ``moves``,
    ``rejects`` (request_id, order_id, reason), ``decisions`` (every row of the log),
    ``replaced`` (existing orders whose lines changed) and ``posts`` (new ids). The log is
    decided at once, the outputs are built when asked for."""
    out = decide_log(d, log, items, check, progress)
    dec, lines, live = out["decisions"], out["lines"], out["live"]
    acc = dec.where(F.col("accepted"))
    last = live.groupBy("o").agg(F.max("t").alias("request_id"))
    stocked = acc.where(F.col("kind") != STATUS)
    current = stocked.join(unsent(last), ["o", "request_id"], "left_semi").select(
        "o", F.col("request_id").alias("_version"), F.col("client_id").alias("ID_Cliente"),
        F.coalesce(F.col("delivery_date"), shift_days(as_of, DEFAULT_DELIVERY_DAYS)).alias("FechaEntrega"),
        F.col("total").alias("Total"), deposit_flag(F.col("delivery_type")).alias("bDeposito"),
        F.when(P._falsy(stocked, "repartidor_id"), F.lit(None)).otherwise(F.col("repartidor_id")).cast("int").alias("ID_Repartidor"))
    replaced = current.where(F.col("o").startswith("o")).select(
        F.substring("o", 2, 30).cast("long").alias("ID_TomaPedido"), F.col("_version").alias("request_id"))

    def posts() -> DataFrame:
        """The accepted posts (request_id, o) with their new ids."""
        new = acc.where(F.col("kind") == POST).select("request_id", "o", F.lit(None).cast("long").alias("ID_TomaPedido"))
        return stored(assign_ids(d["pedidos"], new, "ID_TomaPedido", ["request_id"]))

    def orders() -> DataFrame:
        base = d["pedidos"]
        state = acc.where(F.col("kind") == STATUS).groupBy("o").agg(F.max_by("status", "request_id").alias("_state"))
        given = {"ID_Cliente": "ID_Cliente", "FechaEntrega": "FechaEntrega", "Total": "Total", "Apagar": "Total",
                 "bDeposito": "bDeposito", "ID_Repartidor": "ID_Repartidor"}
        fresh = current.select("o", "_version", *[F.col(c).alias(f"_{c}") for c in dict.fromkeys(given.values())])
        old = base.withColumn("o", F.concat(F.lit("o"), F.col("ID_TomaPedido").cast("string")))
        j = old.join(unsent(fresh.where(F.col("o").startswith("o"))), "o", "left").join(unsent(state), "o", "left")
        edited = F.col("_version").isNotNull()
        kept = j.select(*[F.when(edited, F.col(f"_{given[c]}")).otherwise(F.col(c)).cast(base.schema[c].dataType).alias(c) if c in given
                          else F.coalesce("_state", c).alias(c) if c == "Estado" else F.col(c) for c in base.columns],
                        F.lit(None).cast("long").alias("request_id"))
        constant = {"Letra": F.lit("A"), "ID_Comprobante": F.lit(1), "Fecha": ts(as_of), "Dto": F.lit(0), "CtaCte": F.lit(0),
                    "Estado": F.coalesce("_state", F.lit(STATE_PENDING))}
        n = made["posts"].join(unsent(fresh), "o").join(unsent(state), "o", "left")
        new = n.select(*[(F.col(f"_{given[c]}") if c in given else F.col(c) if c == "ID_TomaPedido" else constant.get(c, F.lit(None)))
                         .cast(base.schema[c].dataType).alias(c) for c in base.columns], "request_id")
        return kept.unionByName(new)

    def added_lines() -> DataFrame:
        ids = replaced.unionByName(made["posts"].select("o", "ID_TomaPedido").join(unsent(current), "o").select("ID_TomaPedido", F.col("_version").alias("request_id")))
        return lines.join(unsent(ids), "request_id").select(
            "ID_TomaPedido", "request_id", F.col("product_id").alias("ID_Producto"), F.col("quantity").alias("Cantidad"),
            F.col("unit_price").alias("PrecioUnitario"), F.col("amount").alias("ImporteconDto"), F.col("vat").alias("IVA"),
            F.lit(0).cast(P.MONEY).alias("RestoIVA"), F.lit(0).cast(P.MONEY).alias("Dto"), "Item")

    made = P.OnDemand(
        posts=posts, orders=orders, added_lines=added_lines, decisions=lambda: dec,
        kept_lines=lambda: d["detalle"].join(unsent(made["replaced"]), "ID_TomaPedido", "left_anti"),
        replaced=lambda: replaced.select("ID_TomaPedido"),
        moves=lambda: stock_moves(out["versions"], live),
        products=lambda: P.apply_stock(d["productos"], made["moves"]),
        rejects=lambda: dec.where(~F.col("accepted")).select("request_id", "order_id", "reason"))
    return made

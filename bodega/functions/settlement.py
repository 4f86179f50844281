"""Which events of an ordered log are accepted, when each sees what the accepted ones
before it left.

An event (an order posted or edited) brings a *version* of its order: what it takes of
each product, what it needs to find, and what comes back when a later accepted event
of the same order replaces it. An edit is checked against the stock with its order's
current version given back; an accepted one replaces that version. An order that
existed before the log has a base version that took nothing from the opening stock.

Whether an event passes depends on all events before it that touch one of its
products, and what an edit gives back depends on which earlier edits of its order
passed, so neither a window along the product nor one along the order is enough.
``settle`` guesses first (``_guess``). What guesses leave, and logs with products or orders of
very many rows, go through rounds of bounds. Of each product an event moves the stock by what it takes and
what the version it replaces gives back, or by nothing: known figures, or bounds over the
versions that undecided events before it may have left. Every product's rows are followed
in order of time with the least and the most stock there can be: an event is rejected
where the most is too little, passes where the least is enough, and otherwise both bounds
are carried through its two outcomes, so a chain of events of one product takes one round.
It is accepted when it passes everywhere; one that waits for a single product only is
decided there in the next round's pass, and what follows sees it. Many products share a
task; one with very many rows is range-split and bounded by running sums alone. So are the
events of an order that has many since its first undecided one: every version has bounds
of its effect at any later time, taken or not while its event is undecided, given back or
not between the first event that may replace it and the first accepted one. The earliest
undecided event has no undecided one before it, so every round settles some. Rows of
rejected events and of products that nothing undecided needs are dropped after each round.

A log whose rows fit a task (``bodega.walkRows``) is walked there in order, without
rounds; so is what rounds leave of a larger one. What is still too much after a few
rounds falls into groups of orders linked by products: groups that fit a task are
walked, many in parallel, and only a larger one goes through another round; they are
looked for when rounds settle little. So a chain
of events that each wait for the one before costs one walk, not one round each.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bodega.functions.groups import connected_groups
from bodega.functions.sequence import (following, hot_keys, may_have_hot_groups, prefix_sums_staged, reliable_checkpoint,
                                       stage_ranges, stored, window_sums)

BASE_TIME = -(1 << 63)     # when base versions stand: before every event
ROUNDS_BEFORE_GROUPS = 3   # rounds in a row that leave most events undecided; looking for groups costs a few rounds
SLOW = 0.9  # such a round leaves more than this share
WALK_ROWS = 1_000_000      # version rows that one task walks, in some 400 MB

ACCEPTED, OPEN = "A", "U"


def _walk_rows(spark) -> int:
    return int(spark.conf.get("bodega.walkRows", str(WALK_ROWS)))


@dataclass(frozen=True)
class Hot:
    """Groups with very many rows, which are range-split: products, products of one order, orders."""
    products: DataFrame | None = None
    held: DataFrame | None = None
    orders: DataFrame | None = None

    @classmethod
    def of(cls, versions: DataFrame, events: DataFrame, edited: DataFrame | None) -> Hot:
        if not may_have_hot_groups(versions.sparkSession, versions.count()):
            return cls()
        if edited is None:
            return cls(hot_keys(versions, ["p"]))
        # an order that is not edited has one row of a product
        return cls(hot_keys(versions, ["p"]), hot_keys(versions, ["o", "p"]), hot_keys(events, ["o"]))


def _running(rows: DataFrame, group: list[str], names: list[str], hot: DataFrame | None) -> DataFrame:
    """``rows`` with the sums ``s_<name>`` of what precedes each in its group, by (t, kind)."""
    sums = {f"s_{n}": F.col(n) for n in names}
    order = ["t", "kind"]
    if hot is None:
        return window_sums(rows, group, order, sums, inclusive=False)
    keys = F.broadcast(hot)
    cold = window_sums(rows.join(keys, group, "left_anti"), group, order, sums, inclusive=False)
    warm = prefix_sums_staged(stage_ranges(rows.join(keys, group, "left_semi"), group, order), group, order, sums, inclusive=False)
    return cold.select(*rows.columns, *sums).unionByName(warm.select(*rows.columns, *sums))


def _steps(versions: DataFrame, events: DataFrame, edits: bool, hot: Hot) -> DataFrame:
    """How the bounds of each version's effect change over time: (o, p, t, lo, hi), counted
    after t; and (z_lo, z_hi), the effect once given back, at the version's own time."""
    took, back = -F.col("take"), F.col("give") - F.col("take")
    v = versions.join(following(events, ["o"], "t", {"sure": F.col("st") == ACCEPTED, "maybe": F.lit(True)}, hot.orders) if edits
                      else events.withColumns({"sure": F.lit(None).cast("long"), "maybe": F.lit(None).cast("long")}), ["o", "t"])
    zero = F.when(F.col("st") == OPEN, F.lit(0).cast("long"))  # NULL, skipped by least and greatest, where it is certain
    if not edits:
        return v.select("o", "p", "t", F.least(took, zero, took).alias("lo"), F.greatest(took, zero, took).alias("hi"),
                        F.lit(0).cast("long").alias("z_lo"), F.lit(0).cast("long").alias("z_hi"))
    stages = [(F.least(took, zero), F.greatest(took, zero)),
              (F.least(took, back, zero), F.greatest(took, back, zero)),
              (F.least(back, zero), F.greatest(back, zero))]
    none = F.lit(0).cast("long")
    steps = [F.struct(F.col("t").alias("t"), stages[0][0].alias("lo"), stages[0][1].alias("hi"), stages[2][0].alias("z_lo"), stages[2][1].alias("z_hi"))]
    for i, at in ((1, "maybe"), (2, "sure")):
        steps.append(F.struct(F.col(at).alias("t"), (stages[i][0] - stages[i - 1][0]).alias("lo"), (stages[i][1] - stages[i - 1][1]).alias("hi"),
                              none.alias("z_lo"), none.alias("z_hi")))
    return (v.select("o", "p", F.explode(F.array(*steps)).alias("s")).select("o", "p", "s.*")
            .where("t IS NOT NULL AND (lo <> 0 OR hi <> 0 OR z_lo <> 0 OR z_hi <> 0)"))


def stock_bounds(versions: DataFrame, events: DataFrame, queries: DataFrame, edits: bool, edited: DataFrame | None = None,
                 hot: Hot = Hot()) -> DataFrame:
    """``queries`` (o, t, p, ...) with lo, hi: by how much the stock of p has changed, at
    least and at most, when the event at t looks at it with its order's current version
    given back. ``versions``: o, t, p, take, give of the events in ``events`` (o, t, st; base
    versions at BASE_TIME). ``edited``: the orders (o) that queries may share with versions."""
    extra = [c for c in queries.columns if c not in ("o", "t", "p")]
    none = F.lit(0).cast("long")
    steps = _steps(versions, events, edits, hot).withColumn("kind", F.lit(1))
    for c in extra:
        steps = steps.withColumn(c, F.lit(None).cast(queries.schema[c].dataType))
    asked = queries.select("*", F.lit(0).alias("kind"), *[none.alias(c) for c in ("lo", "hi", "z_lo", "z_hi")])
    rows = steps.select(*asked.columns).unionByName(asked)
    if edited is not None:
        many, single = rows.join(edited, "o", "left_semi"), rows.join(edited, "o", "left_anti")
        own = _running(many, ["o", "p"], ["lo", "hi", "z_lo", "z_hi"], hot.held)
        own = own.select(*rows.columns, (F.col("s_z_lo") - F.col("s_lo")).alias("own_lo"), (F.col("s_z_hi") - F.col("s_hi")).alias("own_hi"))
        rows = own.unionByName(single.select(*rows.columns, none.alias("own_lo"), none.alias("own_hi")))
    else:
        rows = rows.withColumns({"own_lo": none, "own_hi": none})
    run = _running(rows, ["p"], ["lo", "hi"], hot.products).where("kind = 0")
    return run.select("o", "t", "p", *extra, (F.col("s_lo") + F.col("own_lo")).alias("lo"), (F.col("s_hi") + F.col("own_hi")).alias("hi"))


BUCKET_ROWS = 100_000  # rows of the products that are followed together, in some 20 MB

TAIL_EVENTS = 4        # of an order, from its first undecided one, that are followed with every version they may replace

# kinds of rows along a product, in their order at one moment: what an event of an order with a
# longer tail asks (a, a_hi: what its own order gives back, at least and at most), a step of the
# bounds (a, a_hi), an event (a, a_hi given back, b taken), the same of an accepted event
ASKED, STEP, MOVE, MOVED = 0, 1, 2, 3


def _follow(table: pa.Table) -> pa.Table:
    """Along each product: p, t, kind, n (what the stock must have changed by, at least;
    NULL asks for nothing), a, a_hi, b, sure (passes everywhere else)."""
    cols = {c: table.column(c).combine_chunks() for c in ("p", "t", "kind", "n", "a", "a_hi", "b", "sure")}
    asks = cols["n"].is_valid().to_numpy(zero_copy_only=False)
    num = {c: (v.fill_null(-(1 << 62)) if c == "n" else v).to_numpy(zero_copy_only=False) for c, v in cols.items()}
    order = np.lexsort((num["kind"], num["t"], num["p"]))
    oks, bads = [False] * len(order), [False] * len(order)
    last, lo, hi, sum_lo, sum_hi = None, 0, 0, 0, 0
    for i, (p, kind, n, a, a_hi, b, sure) in enumerate(zip(*(num[c][order].tolist() for c in ("p", "kind", "n", "a", "a_hi", "b", "sure")), strict=True)):
        if p != last:
            last, lo, hi, sum_lo, sum_hi = p, 0, 0, 0, 0
        if kind == ASKED:
            oks[i], bads[i] = sum_lo + a >= n, sum_hi + a_hi < n
            continue
        ok = True
        if kind == MOVE:
            bads[i] = hi + a_hi < n
            ok = oks[i] = lo + a >= n
            if bads[i]:
                continue
        down, up = a - b, a_hi - b
        if kind != MOVE or (ok and sure):
            lo, hi, sum_lo, sum_hi = lo + down, hi + up, sum_lo + down, sum_hi + up
        else:
            sum_lo, sum_hi = sum_lo + min(down, 0), sum_hi + max(up, 0)
            refused = min(hi, n - a - 1) if sure else hi
            lo, hi = max(min(lo, max(lo + a, n) - b), sum_lo), min(max(refused, hi + up), sum_hi)
    keep = asks[order]
    return pa.table({"t": pa.array(num["t"][order][keep], pa.int64()), "p": pa.array(num["p"][order][keep], pa.int64()),
                     "ok": pa.array(np.array(oks, bool)[keep]), "bad": pa.array(np.array(bads, bool)[keep])})


def _follow_split(rows: DataFrame) -> DataFrame:
    """The same for products with very many rows, by running sums of the bounds."""
    none, open_move = F.lit(0).cast("long"), F.col("kind") == MOVE
    down, up = F.col("a") - F.col("b"), F.col("a_hi") - F.col("b")
    asked = rows.where(F.col("n").isNotNull()).select("p", "t", F.lit(ASKED).alias("kind"), "n", "a", "a_hi", none.alias("lo"), none.alias("hi"))
    steps = rows.where(F.col("kind") != ASKED).select(
        "p", "t", F.lit(STEP).alias("kind"), F.lit(None).cast("long").alias("n"), "a", "a_hi",
        F.when(open_move, F.least(down, none)).otherwise(down).alias("lo"), F.when(open_move, F.greatest(up, none)).otherwise(up).alias("hi"))
    order = ["t", "kind"]
    run = prefix_sums_staged(stage_ranges(asked.unionByName(steps), ["p"], order), ["p"], order,
                             {"s_lo": F.col("lo"), "s_hi": F.col("hi")}, inclusive=False)
    return run.where(F.col("kind") == ASKED).select(
        "t", "p", (F.col("s_lo") + F.col("a") >= F.col("n")).alias("ok"), (F.col("s_hi") + F.col("a_hi") < F.col("n")).alias("bad"))


def _tails(events: DataFrame) -> DataFrame:
    """The events from the first undecided one of their order on, in orders with few such: o,
    t, st, only, held (times of the versions that each may replace), lone (whether there may
    be none)."""
    first = events.where(F.col("st") == OPEN).groupBy("o").agg(F.min("t").alias("first"))
    seen = events.join(first, "o")
    base = seen.groupBy("o").agg(F.max(F.when(F.col("t") < F.col("first"), F.col("t"))).alias("base"), F.count_if(F.col("t") >= F.col("first")).alias("n"))
    tail = seen.where(F.col("t") >= F.col("first")).join(base.where(F.col("n") <= TAIL_EVENTS).select("o", "base"), "o")
    listed = tail.groupBy("o", "base").agg(F.sort_array(F.collect_list(F.struct("t", "st", "only"))).alias("tail"))
    each = listed.select("o", "base", "tail", F.posexplode("tail").alias("i", "e"))
    before = F.expr("concat(if(base IS NULL, array(), array(base)), transform(slice(tail, 1, i), x -> x.t))")
    sure = F.expr(f"array_max(transform(filter(slice(tail, 1, i), x -> x.st = '{ACCEPTED}'), x -> x.t))")
    return each.select("o", "e.*", before.alias("before"), sure.alias("since"), F.col("base").isNull().alias("lone")).select(
        "o", "t", "st", "only", F.expr("filter(before, x -> since IS NULL OR x >= since)").alias("held"), (F.col("lone") & F.col("since").isNull()).alias("lone"))


def _verdicts(versions: DataFrame, events: DataFrame, edits: bool, hot: Hot, size: int) -> DataFrame:
    """Per undecided event (t): ok (passes everywhere), bad (fails somewhere), waits (products
    that it may fail at) and _only (one of them)."""
    none, nothing, undecided = F.lit(0).cast("long"), F.lit(None).cast("long"), F.col("st") == OPEN
    need = (F.ceil("need") - F.coalesce("stock_open", F.lit(0))).cast("long")
    sure = F.coalesce(F.col("only") == F.col("p"), F.lit(False)).alias("sure")
    asks = F.when(undecided, need).alias("n")
    if edits:
        tails = stored(_tails(events))
        rest = events.join(tails.select("o", "t"), ["o", "t"], "left_anti")
        own = versions.join(tails.select("o", "t", "st", "only"), ["o", "t"]).select("o", "t", "p", "st", "only", asks, F.col("take").alias("b"), nothing.alias("give"))
        held = tails.select("o", F.col("t").alias("_t"), "st", "only", F.explode("held").alias("t"))
        back = versions.join(held, ["o", "t"]).select("o", F.col("_t").alias("t"), "p", "st", "only", nothing.alias("n"), none.alias("b"), "give")
        moves = own.unionByName(back).groupBy("o", "t", "p").agg(
            *[F.max(c).alias(c) for c in ("st", "only", "n")], F.sum("b").alias("b"), F.min("give").alias("a"), F.max("give").alias("a_hi"), F.count("give").alias("_have"))
        # where one of the versions that may be there, or none of them, does not hold the product
        moves = moves.join(tails.select("o", "t", (F.size("held") + F.col("lone").cast("int")).alias("_may")), ["o", "t"])
        lacks = F.col("_have") < F.col("_may")
        moves = moves.withColumns({"a": F.when(lacks, F.least("a", none)).otherwise(F.coalesce("a", none)),
                                   "a_hi": F.when(lacks, F.greatest("a_hi", none)).otherwise(F.coalesce("a_hi", none))})
    else:
        tails, rest = events.where(undecided), events.where(~undecided)
        moves = versions.join(tails.select("o", "t", "st", "only"), ["o", "t"]).select(
            "t", "p", "st", "only", asks, none.alias("a"), none.alias("a_hi"), F.col("take").alias("b"))
    rows = moves.select("p", "t", F.when(undecided, F.lit(MOVE)).otherwise(F.lit(MOVED)).alias("kind"), "n", "a", "a_hi", "b", sure)

    steps = _steps(versions, rest, edits, Hot(orders=hot.orders))
    later = rest.where(undecided).select("o", "t") if edits else None
    if edits and not later.isEmpty():
        asked = versions.join(later, ["o", "t"], "left_semi").select("o", "t", "p", need.alias("n"), F.lit(ASKED).alias("kind"), *[none.alias(c) for c in ("lo", "hi", "z_lo", "z_hi")])
        own = steps.join(later.select("o").distinct(), "o", "left_semi").select("o", "t", "p", nothing.alias("n"), F.lit(STEP).alias("kind"), "lo", "hi", "z_lo", "z_hi")
        found = _running(own.unionByName(asked), ["o", "p"], ["lo", "hi", "z_lo", "z_hi"], hot.held).where(F.col("kind") == ASKED)
        rows = rows.unionByName(found.select("p", "t", "kind", "n", (F.col("s_z_lo") - F.col("s_lo")).alias("a"), (F.col("s_z_hi") - F.col("s_hi")).alias("a_hi"),
                                             none.alias("b"), F.lit(False).alias("sure")))
    rows = rows.unionByName(steps.select("p", "t", F.lit(STEP).alias("kind"), nothing.alias("n"), F.col("lo").alias("a"), F.col("hi").alias("a_hi"),
                                         none.alias("b"), F.lit(False).alias("sure")))
    cold, parts = rows, []
    if hot.products is not None:
        cold = rows.join(F.broadcast(hot.products), "p", "left_anti")
        parts.append(_follow_split(rows.join(F.broadcast(hot.products), "p", "left_semi")))
    tasks = max(min(int(versions.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // 20_000 + 1), size // 500_000)
    buckets = max(4 * tasks, size // BUCKET_ROWS)
    cold = cold.withColumn("part", F.pmod(F.xxhash64("p"), F.lit(buckets)).cast("int")).repartition(tasks, "part")
    seen = cold.groupBy("part").applyInArrow(_follow, "t long, p long, ok boolean, bad boolean")
    for more in parts:
        seen = seen.unionByName(more)
    return seen.groupBy("t").agg(F.bool_and("ok").alias("ok"), F.bool_or("bad").alias("bad"), F.count_if(~F.col("ok")).alias("waits"),
                                 F.max(F.when(~F.col("ok"), F.col("p"))).alias("_only"))


GUESS_ROUNDS = 40      # of guesses, at most; changes fall to about a half from round to round
FEW = 20               # products are picked out once fewer than one event in so many changed
SENT = 100_000         # changed events or products that are sent to every task (some MB)


def _passing(p: np.ndarray, asks: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, go: np.ndarray) -> np.ndarray:
    """Which rows pass at their product, in order of (p, t). Only rows that pass everywhere
    else (go) move the stock, so only they are gone through one by one."""
    moving, after, passes = np.flatnonzero(go), [], []
    last, net = None, 0
    for q, ask, need, back, out in zip(*(x[moving].tolist() for x in (p, asks, n, a, b)), strict=True):
        if q != last:
            last, net = q, 0
        ok = not ask or net + back >= need
        if ok:
            net += back - out
        passes.append(ok)
        after.append(net)
    here = ~asks
    if len(moving):
        nets, before = np.array(after, np.int64), np.cumsum(go) - go - 1
        found = np.where((before >= 0) & (p[moving[before]] == p), nets[before], 0)
        here |= found + a >= n
        here[moving] = passes
    else:
        here |= a >= n
    return here


def _replay(table: pa.Table, first: bool = False) -> pa.Table:
    """Along each product, as the last guess and this one have it: p, t, n (see ``_follow``),
    a, a0 (given back), b (taken), go, go0 (passes everywhere else). The rows where what
    passes here differs: t, p, and by how much it adds to the products that t fails at.
    ``first``: there was no guess before, all passed."""
    num = {c: table.column(c).combine_chunks() for c in ("p", "t", "n", "a", "a0", "b", "go", "go0")}
    asks = num["n"].is_valid().to_numpy(zero_copy_only=False)
    num = {c: (v.fill_null(-(1 << 62)) if c == "n" else v).to_numpy(zero_copy_only=False) for c, v in num.items()}
    order = np.lexsort((num["t"], num["p"]))
    num, asks = {c: v[order] for c, v in num.items()}, asks[order]
    # what an event takes, finds and gives back at one product comes in up to three rows
    other = (num["p"][1:] != num["p"][:-1]) | (num["t"][1:] != num["t"][:-1])
    at = np.flatnonzero(np.concatenate([[True], other])) if len(order) else np.zeros(0, np.int64)
    if len(at) < len(order):
        asks = np.logical_or.reduceat(asks, at)
        num = {c: np.add.reduceat(v, at) if c in ("a", "a0", "b") else np.maximum.reduceat(v, at) if c == "n" else v[at] for c, v in num.items()}
    here = _passing(num["p"], asks, num["n"], num["a"], num["b"], num["go"])
    if first:
        here0 = np.ones(len(here), bool)
    else:
        here0 = _passing(num["p"], asks, num["n"], num["a0"], num["b"], num["go0"])
    rows = np.flatnonzero(here != here0)
    more = np.where(here0[rows], 1, -1)
    return pa.table({"t": pa.array(num["t"][rows], pa.int64()), "p": pa.array(num["p"][rows], pa.int64()), "d": pa.array(more, pa.int32())})


def _guessed(events: DataFrame, edits: bool) -> DataFrame:
    """``events`` (o, t, st, kind, fails, x: how many of its products an event fails at, and
    those joined by xor) with what follows from them: sees (0 if it passes everywhere, 1 if
    at all but ``only``, else 2), only, alive (its order exists) and prev (the version that
    it replaces)."""
    base, passes = F.col("t") == BASE_TIME, F.col("fails") == 0
    out = events.withColumns({"sees": F.least("fails", F.lit(2)).cast("int"), "only": F.when(F.col("fails") == 1, F.col("x"))})
    if not edits:
        return out.withColumns({"alive": F.lit(True), "prev": F.lit(None).cast("long")})
    order = Window.partitionBy("o")
    posted = F.max((F.col("kind") == "post") & passes).over(order)
    out = out.withColumn("alive", ~F.col("o").startswith("n") | (F.col("kind") == "post") | F.coalesce(posted, F.lit(False)))
    before = order.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("prev", F.max(F.when(base | (F.col("alive") & passes), F.col("t"))).over(before))


GUESS = ["sees", "only", "alive", "prev"]


def _guess_rows(versions: DataFrame, events: DataFrame, edits: bool) -> tuple[DataFrame, DataFrame | None]:
    """What the walks of a guess read, by the event alone: what it takes and asks, and the
    base version it may give back (t, p, n, b, g); and what later events of its order may
    give back of it (v, p, give)."""
    none, base = F.lit(0).cast("long"), F.col("t") == BASE_TIME
    n = (F.ceil("need") - F.coalesce("stock_open", F.lit(0))).cast("long").alias("n")
    own = versions.where(~base).select("t", "p", n, F.col("take").alias("b"), none.alias("g"))
    if not edits:
        return stored(own), None
    held = versions.where(base & (F.col("give") != 0)).select("o", "p", "give").join(events.where(~base).select("o", "t"), "o")
    rows = own.unionByName(held.select("t", "p", F.lit(None).cast("long").alias("n"), none.alias("b"), F.col("give").alias("g")))
    last = Window.partitionBy("o").orderBy(F.desc("t"))
    replaced = events.where(~base).select(F.col("t").alias("v"), (F.row_number().over(last) > 1).alias("_more")).where("_more").select("v")
    gives = versions.where(~base & (F.col("give") != 0)).select(F.col("t").alias("v"), "p", "give").join(replaced, "v", "left_semi")
    return stored(rows), stored(gives)


def _replayed(rows: DataFrame, gives: DataFrame | None, guess: DataFrame, first: bool, size: int) -> DataFrame:
    """What the products in ``rows`` and ``gives`` (``_guess_rows``) add to the events'
    failures (t, d, x) when they are walked by this guess instead of the last one."""
    none = F.lit(0).cast("long")

    def go(k: str):
        return F.col(f"alive{k}") & ((F.col(f"sees{k}") == 0) | F.coalesce((F.col(f"sees{k}") == 1) & (F.col(f"only{k}") == F.col("p")), F.lit(False)))

    said = [f"{c}{k}" for k in ("", "0") for c in ("sees", "only", "alive")]
    if gives is None:
        seen = rows.join(guess.select("t", *said), "t").select("p", "t", "n", "b", none.alias("a"), none.alias("a0"), go("").alias("go"), go("0").alias("go0"))
    else:
        def based(k: str):
            return F.when(F.coalesce(F.col(f"prev{k}") == BASE_TIME, F.lit(False)), F.col("g")).otherwise(none)

        now = guess.where(F.col("t") != BASE_TIME).select("t", *said, "prev", "prev0")
        seen = rows.join(now, "t").select("p", "t", "n", "b", based("").alias("a"), based("0").alias("a0"), go("").alias("go"), go("0").alias("go0"))
        # a base version that neither guess gives back moves nothing
        seen = seen.where(F.col("n").isNotNull() | (F.col("b") != 0) | (F.col("a") != 0) | (F.col("a0") != 0))
        held = now.select(F.col("t").alias("_t"), *said, F.explode(F.array(
            F.struct(F.col("prev").alias("v"), F.lit(1).alias("new"), F.col("prev").eqNullSafe(F.col("prev0")).cast("int").alias("old")),
            F.struct(F.when(~F.col("prev").eqNullSafe(F.col("prev0")), F.col("prev0")).alias("v"), F.lit(0).alias("new"), F.lit(1).alias("old")))).alias("h"))
        held = held.where(F.col("h.v").isNotNull() & (F.col("h.v") != BASE_TIME)).select("_t", *said, "h.*")
        seen = seen.unionByName(gives.join(held, "v").select(
            "p", F.col("_t").alias("t"), F.lit(None).cast("long").alias("n"), none.alias("b"), (F.col("give") * F.col("new")).alias("a"),
            (F.col("give") * F.col("old")).alias("a0"), go("").alias("go"), go("0").alias("go0")))
    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield from _replay(pa.Table.from_batches(held), first).to_batches()

    # a task holds the rows of its products, which need no sorting before: about 250,000 in some 60 MB
    tasks = max(min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // 20_000 + 1), size // 250_000)
    out = seen.repartition(tasks, "p").mapInArrow(replay, "t long, p long, d int")
    return out.groupBy("t").agg(F.sum("d").alias("d"), F.bit_xor("p").alias("dx"))


def _guess(versions: DataFrame, events: DataFrame, edits: bool, size: int, told: Callable[[int, int, int], None]) -> tuple[DataFrame, int | None]:
    """The events (o, t, st, kind) with the guess of who is accepted that confirms itself,
    and None; or with what is certain of it, and the rounds it took.

    Every event is taken to pass, then each product is walked with what the others said in
    the round before, and only products of events about which that changed are walked again.
    A guess that no product changes is the outcome: what the first event finds is right, so
    what the second finds is, and so on. For the same reason all is right before the first
    event that changed, if changes do not die out."""
    all_rows, all_gives = _guess_rows(versions, events, edits)
    zero = F.lit(0).cast("long")
    start = _guessed(events.select("o", "t", "st", "kind", zero.alias("fails"), zero.alias("x")), edits)
    now = stored(start.select("*", *[F.col(c).alias(f"{c}0") for c in GUESS]))
    total = now.count()
    rounds, slow, before, rows, gives, read = 0, 0, total, all_rows, all_gives, size
    while rounds < GUESS_ROUNDS:
        rounds += 1
        delta = _replayed(rows, gives, now, rounds == 1, read)
        new = now.drop(*[f"{c}0" for c in GUESS]).join(delta, "t", "left").select(
            "o", "t", "st", "kind", (F.col("fails") + F.coalesce("d", zero)).alias("fails"), F.col("x").bitwiseXOR(F.coalesce("dx", zero)).alias("x"),
            *[F.col(c).alias(f"{c}0") for c in GUESS])
        now = stored(_guessed(new, edits))
        other = [~F.col(c).eqNullSafe(F.col(f"{c}0")) for c in GUESS]
        changed = now.where(other[0] | other[1] | other[2] | other[3])
        n = changed.count()
        told(rounds, read, n)
        if not n:
            passes = F.when((F.col("st") == ACCEPTED) | (F.col("alive") & (F.col("fails") == 0)), F.lit(ACCEPTED)).otherwise(F.lit("R"))
            return now.select("o", "t", passes.alias("st"), "kind"), None
        slow, before = slow + 1 if n > SLOW * before else 0, n
        if slow >= ROUNDS_BEFORE_GROUPS:
            break
        rows, gives, read = all_rows, all_gives, size
        if n * FEW < total:
            def touched(table: DataFrame, at: DataFrame, key: str, times: int) -> DataFrame:
                return table.join(F.broadcast(at) if n * times <= SENT else at, key, "left_semi").select("p")

            products = touched(all_rows, changed.select("t"), "t", 1)
            if edits:
                held = changed.select(F.explode(F.array("prev", "prev0")).alias("v")).where(F.col("v").isNotNull() & (F.col("v") != BASE_TIME)).distinct()
                products = products.unionByName(touched(all_gives, held, "v", 2))
            products = stored(products.distinct())
            products = F.broadcast(products) if products.count() <= SENT else products
            rows = stored(all_rows.join(products, "p", "left_semi"))
            read = rows.count()
            if edits:
                gives = stored(all_gives.join(products, "p", "left_semi"))
                read += gives.count()
    since = changed.agg(F.min("t")).first()[0]
    sure = F.col("t") < since
    st = (F.when(F.col("st") == ACCEPTED, F.lit(ACCEPTED)).when(~sure, F.lit(OPEN))
          .when(F.col("alive") & (F.col("fails") == 0), F.lit(ACCEPTED)).otherwise(F.lit("R")))
    return now.select("o", "t", st.alias("st"), "kind"), rounds


def _walk(table: pa.Table) -> pa.Table:
    """One by one through the rows of some groups: o, t, p, st, needs (rounded up: stock is
    whole), take, give, found (the stock before t that the rest of the log leaves). An event of which no product
    is needed any more has one row without a product: it still replaces a version."""
    cols = {c: table.column(c).to_pylist() for c in table.column_names}
    order = sorted(range(table.num_rows), key=lambda r: (cols["t"][r], cols["o"][r]))
    net: dict[int, int] = {}
    current: dict[str, list[tuple[int, int]]] = {}
    made = {o for o in cols["o"] if o[0] == "n"}
    times, verdicts, i = [], [], 0
    while i < len(order):
        j, t, o = i, cols["t"][order[i]], cols["o"][order[i]]
        while j < len(order) and cols["t"][order[j]] == t and cols["o"][order[j]] == o:
            j += 1
        rows, i = [r for r in order[i:j] if cols["p"][r] is not None], j
        back = dict(current.get(o, ()))
        passes = cols["st"][order[j - 1]] == ACCEPTED
        if not passes:
            # an order that the log creates has to have been created
            passes = (o not in made or o in current or f"n{t}" == o) and all(
                cols["found"][r] + net.get(cols["p"][r], 0) + back.get(cols["p"][r], 0) >= cols["needs"][r] for r in rows)
            times.append(t)
            verdicts.append(passes)
        if passes:
            for p, g in back.items():
                net[p] = net.get(p, 0) + g
            for r in rows:
                net[cols["p"][r]] = net.get(cols["p"][r], 0) - cols["take"][r]
            current[o] = [(cols["p"][r], cols["give"][r]) for r in rows]
    return pa.table({"t": pa.array(times, pa.int64()), "passes": pa.array(verdicts, pa.bool_())})


WALK_COLUMNS = ["o", "t", "p", "st", "take", "give", "needs", "found"]


def _walk_all(versions: DataFrame, events: DataFrame) -> DataFrame:
    """(t, passes) of every undecided event, in one task."""
    rows = events.join(versions, ["o", "t"], "left").select(
        "o", "t", "p", "st", "take", "give", F.ceil("need").cast("long").alias("needs"), F.coalesce("stock_open", F.lit(0)).cast("long").alias("found"))
    return rows.groupBy(F.lit(0).alias("part")).applyInArrow(_walk, "t long, passes boolean")


def _walk_small_groups(versions: DataFrame, events: DataFrame, edits: bool, limit: int, hot: Hot) -> DataFrame:
    """(t, passes) of the undecided events in groups of at most ``limit`` rows."""
    spark = versions.sparkSession
    open_orders = events.where(F.col("st") == OPEN).select("o").distinct()
    moving = events.join(open_orders, "o", "left_semi").join(versions, ["o", "t"], "left")
    # what orders without an undecided event did is settled: it is the ground the walk stands on
    still = events.join(open_orders, "o", "left_anti")
    ground = stock_bounds(versions.join(still, ["o", "t"], "left_semi"), still,
                          moving.where((F.col("st") == OPEN) & F.col("p").isNotNull()).select("o", "t", "p", "stock_open"), edits, hot=hot)
    found = ground.select("o", "t", "p", (F.coalesce("stock_open", F.lit(0)) + F.col("lo")).cast("long").alias("found"))
    rows = reliable_checkpoint(moving.select("o", "t", "p", "st", "take", "give", F.ceil("need").cast("long").alias("needs")).join(found, ["o", "t", "p"], "left"))
    node = F.xxhash64(F.lit("o"), F.col("o"))  # a clash of hashes joins two groups, which changes nothing but their size
    groups = connected_groups(rows.where("p IS NOT NULL").select(node.alias("a"), F.xxhash64(F.lit("p"), F.col("p")).alias("b")))
    grouped = rows.withColumn("node", node).join(groups, "node")
    small = grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= limit).select("grp")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * rows.count() // limit)
    parts = grouped.join(small, "grp", "left_semi").withColumn("part", F.pmod(F.xxhash64("grp"), F.lit(buckets)).cast("int"))
    return parts.select("part", *WALK_COLUMNS).groupBy("part").applyInArrow(_walk, "t long, passes boolean")


def settle(versions: DataFrame, events: DataFrame, edits: bool, progress: Callable[[int, int, int], None] | None = None) -> DataFrame:
    """The accepted events (o, t) of a log.

    ``events``: o, t (unique), st, kind of the events that pass every check but that of
    the stock, with st 'U', and of the base versions of edited orders (BASE_TIME, 'A'). An
    order created in the log has the key 'n' + the t of the event that posts it.
    ``versions``: o, t, p, take, give, need, stock_open, one row per event and product.
    Both are read every round, so they should be checkpointed.
    ``edits``: whether any event may follow another of its order. ``progress`` is told
    after every step the rounds so far, the rows it read and the events still undecided."""
    limit = _walk_rows(versions.sparkSession)
    events = events.withColumn("only", F.lit(None).cast("long"))
    undecided = F.col("st") == OPEN
    edited = events.groupBy("o").count().where("count > 1").select("o") if edits else None
    hot = Hot.of(versions, events, edited)
    told = progress or (lambda *_: None)
    rounds, left, size = 0, events.where(undecided).count(), versions.count()
    slow, before = 0, left

    def walked(passes: DataFrame) -> DataFrame:
        st = F.when(F.col("passes").isNull(), F.col("st")).when(F.col("passes"), F.lit(ACCEPTED)).otherwise(F.lit("R"))
        return stored(events.join(passes, "t", "left").select("o", "t", st.alias("st"), "kind", "only").where(F.col("st") != "R"))

    if size > limit and left and hot == Hot():
        guessed, taken = _guess(versions, events, edits, size, told)
        rounds = taken or 0
        events = stored(guessed.where(F.col("st") != "R").withColumn("only", F.lit(None).cast("long")))
        left = events.where(undecided).count()
        if left:
            versions, size = _still_needed(versions, events)
        before = left
    while left:
        if size <= limit:
            events = walked(_walk_all(versions, events.select("o", "t", "st")))
            told(rounds, size, 0)
            break
        rounds += 1
        now = events.join(_verdicts(versions, events, edits, hot, size), "t", "left")
        if edits:
            # an edit of an order that the log creates waits for the order, and falls with it
            posts = events.where(F.col("kind") == "post").select("o", F.col("st").alias("post_st"))
            now = now.join(posts, "o", "left").withColumn(
                "post_st", F.when(F.col("o").startswith("n") & (F.col("kind") != "post"), F.coalesce("post_st", F.lit("R"))).otherwise(F.lit(ACCEPTED)))
        else:
            now = now.withColumn("post_st", F.lit(ACCEPTED))
        st = (F.when(F.col("st") == ACCEPTED, F.lit(ACCEPTED)).when(F.col("bad") | (F.col("post_st") == "R"), F.lit("R"))
              .when(F.col("ok") & (F.col("post_st") == ACCEPTED), F.lit(ACCEPTED)).otherwise(F.lit(OPEN)))
        only = F.when((F.col("waits") == 1) & (F.col("post_st") == ACCEPTED), F.col("_only"))
        events = stored(now.select("o", "t", st.alias("st"), "kind", only.alias("only")).where(F.col("st") != "R"))
        left = events.where(undecided).count()
        told(rounds, size, left)
        slow, before = slow + 1 if left > SLOW * before else 0, left
        if left and slow >= ROUNDS_BEFORE_GROUPS:
            slow = 0
            versions, size = _still_needed(versions, events)
            if size > limit:
                events = walked(reliable_checkpoint(_walk_small_groups(versions, events.select("o", "t", "st"), edits, limit, hot)))
                left = events.where(undecided).count()
                told(rounds, size, left)
        if left:
            versions, size = _still_needed(versions, events)
    return events.where((F.col("st") == ACCEPTED) & (F.col("t") != BASE_TIME)).select("o", "t")


def _still_needed(versions: DataFrame, events: DataFrame) -> tuple[DataFrame, int]:
    """The rows of events that were not rejected, of products that an undecided one needs."""
    needed = versions.join(events.where(F.col("st") == OPEN).select("o", "t"), ["o", "t"], "left_semi").select("p").distinct()
    kept = stored(versions.join(events.select("o", "t"), ["o", "t"], "left_semi").join(needed, "p", "left_semi"))
    return kept, kept.count()

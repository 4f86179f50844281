"""The log of posts, edits and status changes against one-by-one handling."""
import datetime as dt
import random
from collections import Counter, defaultdict
from decimal import Decimal as D
from math import ceil, floor

import pytest

from bodega.functions.settlement import settle
from bodega.operators import order_log as L

AS_OF = dt.datetime(2001, 8, 1)
LOG = ("request_id long, method string, order_id long, created_by long, client_id long, delivery_type string, "
       "delivery_date timestamp_ntz, repartidor_id int, status string")
ITEMS = "request_id long, pos int, product_id long, quantity decimal(18,2), unit_price decimal(18,2)"
ORDERS = ("ID_TomaPedido long, ID_Cliente long, Fecha timestamp_ntz, FechaEntrega timestamp_ntz, Total decimal(18,2), Apagar decimal(18,2), "
          "Dto decimal(18,2), CtaCte decimal(18,2), Estado string, bDeposito smallint, ID_Repartidor int, Letra string, ID_Comprobante int")
HELD = "ID_TomaPedido long, ID_Producto long, Cantidad decimal(18,2)"


def simulate(log, items, stock, orders, held, clients, drivers):
    """One request after the other. Returns reasons, stock, order -> (client, lines, state),
    where orders of the log have the key ('n', request_id). A product's stock is whole and
    takes ceil, gives floor; one without a figure keeps none."""
    stock, book = dict(stock), {o: [c, [(p, q) for k, p, q in held if k == o], "P"] for o, c in orders}
    by = defaultdict(list)
    for r, pos, p, q, u in items:
        by[r].append((pos, p, q, u))
    sent = Counter(r[0] for r in log)
    reasons = {}

    def move(p, n):
        if stock.get(p) is not None:
            stock[p] += n

    for r, method, oid, made, client, delivery, _, driver, status in sorted(log, key=lambda x: x[0]):
        its = sorted(by[r])
        key = ("n", r) if method == "POST" else oid if oid is not None else ("n", made)
        if sent[r] > 1:
            reasons[r] = "duplicate_request"
        elif method == "PUT" and status and not its:
            if key in book and (method == "PUT"):
                book[key][2] = status
            else:
                reasons[r] = "not_found"
        elif not client or not its:
            reasons[r] = "missing_data"
        elif delivery == "por reparto" and not driver:
            reasons[r] = "missing_driver"
        else:
            old = book[key][1] if method == "PUT" and key in book else []
            for p, q in old:
                move(p, floor(q))
            why = next(("unknown_product" if p not in stock else "insufficient_stock" for _, p, q, _ in its
                        if p not in stock or q is not None and (stock[p] or 0) < q), None)
            if why is None and method == "PUT" and key not in book:
                why = "not_found"
            if why is None and client not in clients:
                why = "unknown_client"
            if why is None and driver and driver not in drivers:
                why = "unknown_driver"
            if why is None and any(q is None for _, _, q, _ in its):
                why = "bad_number"
            if why:
                reasons[r] = why
                for p, q in old:
                    move(p, -floor(q))
                continue
            for _, p, q, _ in its:
                move(p, -ceil(q))
            book[key] = [client, [(p, q) for _, p, q, _ in its], book[key][2] if key in book else "Pendiente"]
    return reasons, stock, book


def random_log(seed, n, products=12, orders=8, mostly=None):
    rnd = random.Random(seed)
    stock = {p: rnd.choice([None, 0, 3, 10, 40]) if p % 5 else 15 for p in range(products)}
    base = [(o, rnd.randrange(1, 5)) for o in range(orders)]
    held = [(o, rnd.randrange(products + 1), D(rnd.choice(["1", "2", "5", "2.5"]))) for o in range(orders) for _ in range(rnd.randrange(4))]
    log, items, posts = [], [], []
    for r in range(n):
        kind = mostly or rnd.choice(["post", "post", "edit", "edit", "made", "status"])
        method = "POST" if kind == "post" else "PUT"
        oid = rnd.choice([*range(orders), 99, None]) if kind in ("edit", "status") and rnd.random() < 0.8 else None
        made = rnd.choice(posts) if posts and method == "PUT" and oid is None and rnd.random() < 0.9 else r + 3 if kind == "made" else None
        if kind == "post":
            posts.append(r)
        rid = r if rnd.random() > 0.02 else max(0, r - 1)
        log.append((rid, method, oid, made, rnd.choice([1, 2, 3, 4, 4, 7, None]) if rnd.random() < 0.3 else 1, rnd.choice(["deposito", "por reparto"]),
                    None, rnd.choice([1, 2, None, 9]) if rnd.random() < 0.3 else 1, "Entregado" if kind == "status" else None))
        for pos in range(0 if kind == "status" else rnd.choice([0, 1, 2, 3]) if rnd.random() < 0.2 else rnd.choice([1, 2, 3])):
            q = D(rnd.choice(["1", "2", "3", "6", "-1", "1.5"])) if rnd.random() < 0.97 else None
            items.append((rid, pos + 1, rnd.randrange(products + (rnd.random() < 0.1)), q, D("1.00")))
    return log, items, stock, base, held


def run(spark, log, items, stock, orders, held, progress=None):
    def rows(data, schema, parts=3):
        return spark.createDataFrame(data, schema).repartition(parts)

    d = {"productos": rows([(p, s, D("2.00")) for p, s in stock.items()], "ID_Producto long, Stock int, PrecioFinalUni decimal(18,2)"),
         "pedidos": rows([(o, c, AS_OF, AS_OF, D(1), D(1), D(0), D(0), "P", 0, None, "A", 1) for o, c in orders], ORDERS),
         "detalle": rows(held, HELD), "clientes": rows([(c,) for c in (1, 2, 3, 4)], "ID_Cliente long"),
         "repartidores": rows([(c,) for c in (1, 2)], "ID_Repartidor int")}
    return L.apply_log(d, rows(log, LOG), rows(items, ITEMS), AS_OF, progress=progress)


def compare(spark, data, progress=None):
    log, items, stock, orders, held = data
    out = run(spark, *data, progress=progress)
    reasons, left, book = simulate(*data, clients={1, 2, 3, 4}, drivers={1, 2})
    got = {}
    for r in out["rejects"].collect():
        got[r.request_id] = r.reason
    assert got == reasons
    assert out["decisions"].count() == len(log)
    assert {r.ID_Producto: r.Stock for r in out["products"].collect()} == left
    snap = out["orders"].collect()
    name = {r.ID_TomaPedido: r.ID_TomaPedido if r.request_id is None else ("n", r.request_id) for r in snap}
    assert {name[r.ID_TomaPedido]: (r.ID_Cliente, r.Estado) for r in snap} == {k: (c, s) for k, (c, _, s) in book.items()}
    made = sorted((r.request_id, r.ID_TomaPedido) for r in snap if r.request_id is not None)
    assert [i for _, i in made] == list(range(max(o for o, _ in orders) + 1, max(o for o, _ in orders) + 1 + len(made)))
    lines = [(name[r.ID_TomaPedido], r.ID_Producto, r.Cantidad) for k in ("kept_lines", "added_lines") for r in out[k].collect()]
    assert Counter(lines) == Counter((k, p, q) for k, (_, ls, _) in book.items() for p, q in ls)


@pytest.fixture
def conf(spark):
    def put(**kv):
        for k, v in kv.items():
            spark.conf.set(f"bodega.{k}", str(v))
    yield put
    for k in ("walkRows", "hotGroupRows"):
        spark.conf.unset(f"bodega.{k}")


@pytest.mark.parametrize("seed,walk,hot", [(1, 200_000, 10 ** 6), (2, 1, 10 ** 6), (3, 12, 10 ** 6), (4, 1, 4), (5, 200_000, 4)])
def test_mixed_log_equals_one_by_one(spark, conf, seed, walk, hot):
    """All left to the walk, to the rounds, or some of both; with products range-split."""
    conf(walkRows=walk, hotGroupRows=hot)
    compare(spark, random_log(seed, 90))


@pytest.mark.parametrize("kind", ["edit", "post"])
def test_one_kind(spark, kind):
    compare(spark, random_log(8, 80, mostly=kind))


def test_edits_of_one_product_take_one_round(spark, conf):
    """Every edit gives back as much as it takes: none has to wait for the one before it."""
    conf(walkRows=1)
    n, rounds = 40, []
    log = [(r, "PUT", r, None, 1, "deposito", None, None, None) for r in range(n)]
    data = (log, [(r, 1, 1, D(5), D("1.00")) for r in range(n)], {1: 3}, [(o, 1) for o in range(n)], [(o, 1, D(5)) for o in range(n)])
    compare(spark, data, progress=lambda r, size, left: rounds.append((r, left)))
    assert rounds == [(1, 0)]


def test_posts_waiting_for_each_other_at_one_product(spark, conf):
    """Whether a post passes at product 1 hangs on the one before, at product 1 alone."""
    conf(walkRows=1)
    n, rounds = 30, []
    log = [(r, "POST", None, None, 1, "deposito", None, None, None) for r in range(n)]
    data = (log, [(r, 1, 1, D(1 + r % 7), D("1.00")) for r in range(n)], {1: 40}, [(0, 1)], [])
    compare(spark, data, progress=lambda r, size, left: rounds.append((r, left)))
    assert rounds[-1][1] == 0 and rounds[-1][0] <= 2


def test_posts_waiting_for_each_other_across_products(spark, conf):
    """Rounds settle events that wait for others at several products, not a few at a time."""
    conf(walkRows=1)
    rnd, n, products, rounds = random.Random(5), 400, 60, []
    log = [(r, "POST", None, None, 1, "deposito", None, None, None) for r in range(n)]
    items = [(r, i + 1, p, D(rnd.randrange(1, 50)), D("1.00")) for r in range(n) for i, p in enumerate(rnd.sample(range(products), 4))]
    data = (log, items, {p: rnd.randrange(3, 450) for p in range(products)}, [(0, 1)], [])
    compare(spark, data, progress=lambda r, size, left: rounds.append((r, size, left)))
    assert rounds[-1][2] == 0 and rounds[-1][0] <= 16
    assert rounds[-1][1] < rounds[0][1]  # only what may change is walked again


def test_edits_waiting_for_each_other_across_products(spark, conf):
    conf(walkRows=1)
    rnd, n, products, rounds = random.Random(6), 200, 40, []
    log = [(r, "PUT", rnd.randrange(80), None, 1, "deposito", None, None, None) for r in range(n)]
    items = [(r, i + 1, p, D(rnd.randrange(1, 50)), D("1.00")) for r in range(n) for i, p in enumerate(rnd.sample(range(products), 3))]
    held = [(o, p, D(rnd.randrange(1, 50))) for o in range(80) for p in rnd.sample(range(products), 3)]
    data = (log, items, {p: rnd.randrange(3, 150) for p in range(products)}, [(o, 1) for o in range(80)], held)
    compare(spark, data, progress=lambda r, size, left: rounds.append((r, size, left)))
    assert rounds[-1][2] == 0 and rounds[-1][0] <= 16


def test_outputs_join_stored_rows_without_sending_them_to_every_task(spark):
    """A stored table is small as a file and large as rows: sides that grow with the log are
    not sent to all tasks by the size of their files."""
    out = run(spark, *random_log(11, 60))
    for name in ("orders", "kept_lines", "added_lines", "moves"):
        assert "BroadcastHashJoin" not in out[name]._jdf.queryExecution().sparkPlan().toString(), name


def test_stored_rows_are_joined_by_measured_size(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from bodega.functions import sequence
    names, seen = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"), []
    before, write = [spark.conf.get(n, None) for n in names], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda *a, **k: (seen.append([spark.conf.get(n, None) for n in names]), write(*a, **k))[1])
    assert sequence.stored(spark.range(5)).count() == 5
    assert seen == [["-1", before[0] if before[1] is None else before[1]]]
    assert [spark.conf.get(n, None) for n in names] == before


def test_log_stores_lines_without_what_follows_from_them(spark, monkeypatch):
    stored, kept = L.stored, []
    monkeypatch.setattr(L, "stored", lambda df: (kept.append(df.columns), stored(df))[1])
    run(spark, *random_log(12, 40))["added_lines"].count()
    assert kept and not any({"vat", "Item"} & set(c) for c in kept)


def test_products_are_walked_as_one_by_one():
    """Rows of one event at one product are joined; rows that fail elsewhere move nothing."""
    import pyarrow as pa

    from bodega.functions.settlement import _replay
    rnd = random.Random(3)
    rows = [(rnd.randrange(4), rnd.randrange(30), rnd.choice([None, -4, -1, 2]), rnd.randrange(3), rnd.randrange(3), rnd.randrange(4)) for _ in range(160)]
    goes = {(p, t): (rnd.random() < 0.5, rnd.random() < 0.5) for p, t, *_ in rows}

    def walk(give, which):
        net, here = Counter(), {}
        for p, t in sorted(goes):
            own = [r for r in rows if r[:2] == (p, t)]
            asks = [r[2] for r in own if r[2] is not None]
            back = sum(r[give] for r in own)
            here[p, t] = not asks or net[p] + back >= max(asks)
            if here[p, t] and goes[p, t][which]:
                net[p] += back - sum(r[5] for r in own)
        return here

    table = pa.table({**{c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(("p", "t", "n", "a", "a0", "b"))},
                      "go": [goes[r[:2]][0] for r in rows], "go0": [goes[r[:2]][1] for r in rows]})
    now, before = walk(3, 0), walk(4, 1)
    for first, old in ((False, before), (True, dict.fromkeys(goes, True))):
        got = {(r["p"], r["t"]): r["d"] for r in _replay(table, first).to_pylist()}
        assert got == {k: 1 if old[k] else -1 for k in goes if now[k] != old[k]}
    assert _replay(table.slice(0, 0)).num_rows == 0


def test_a_product_that_repeats_is_checked_line_by_line(spark):
    """With two rows of a product a line meets both: it takes twice, and is checked against
    what is left in each."""
    log = [(r, "POST", None, None, 1, "deposito", None, None, None) for r in range(3)]
    items = [(r, 1, 1, D(2), D("1.00")) for r in range(3)]
    out = run(spark, log, items, {1: 5}, [(0, 1)], [])
    assert [r.reason for r in out["rejects"].collect()] == ["insufficient_stock"]
    d = {"productos": spark.createDataFrame([(1, 5, D("2.00"))] * 2, "ID_Producto long, Stock int, PrecioFinalUni decimal(18,2)"),
         "pedidos": spark.createDataFrame([(0, 1, AS_OF, AS_OF, D(1), D(1), D(0), D(0), "P", 0, None, "A", 1)], ORDERS), "detalle": spark.createDataFrame([], HELD)}
    twice = L.apply_log(d, spark.createDataFrame(log, LOG), spark.createDataFrame(items, ITEMS), AS_OF)
    assert sorted(r.request_id for r in twice["decisions"].where("NOT accepted").collect()) == [1, 2]

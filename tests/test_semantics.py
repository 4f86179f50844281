import pytest
"""The reference's semantics on hand-made rows: reports, listings,
maintenance and migration."""
import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from bodega.functions.exprs import full_name, trimmed_full_name
from bodega.operators import changes as W
from bodega.operators import constraints as C
from bodega.operators import migration as M
from bodega.operators import reports as R

AS_OF = dt.datetime(2001, 8, 1)


def test_names_concat_like_plus(spark):
    df = spark.createDataFrame([("Ana", None), (None, "Paz"), ("Juan ", "Gil\t")], "a string, b string")
    got = [r.n for r in df.select(full_name(F.col("a"), F.col("b")).alias("n")).collect()]
    assert got == ["Ana ", None, "Juan  Gil\t"]                   # NULL first name -> NULL (S1)
    got = [r.n for r in df.select(trimmed_full_name(F.col("a"), F.col("b")).alias("n")).collect()]
    assert got == ["Ana ", None, "Juan Gil\t"]                    # RTRIM keeps a trailing tab (S2)


def _report_tables(spark):
    pedidos = spark.createDataFrame([
        (1, 10, dt.datetime(2001, 7, 2), Decimal("100.00")),      # exactly 30 days before: inside (S3)
        (2, 10, dt.datetime(2001, 7, 1, 23, 59, 59), Decimal("50.00")),  # one second earlier: outside
        (3, 11, dt.datetime(2002, 1, 1), Decimal("10.00")),       # future order counts
        (4, 11, dt.datetime(2001, 7, 20), Decimal("70.00")),      # no lines: vanishes
    ], "ID_TomaPedido long, ID_Cliente long, Fecha timestamp_ntz, Total decimal(18,2)")
    detalle = spark.createDataFrame([
        (1, 100, Decimal("2.00"), Decimal("1.50")), (1, 101, Decimal("1.00"), Decimal("3.00")),
        (2, 100, Decimal("5.00"), Decimal("1.00")), (3, 100, Decimal("1.00"), Decimal("2.00")),
    ], "ID_TomaPedido long, ID_Producto long, Cantidad decimal(18,2), PrecioUnitario decimal(18,2)")
    productos = spark.createDataFrame([(100, "vino", "001", 7), (101, "agua", "002", 7)],
                                      "ID_Producto long, Descripcion string, Pr_Ean13 string, ID_Proveedor long")
    clientes = spark.createDataFrame([(10, "Ana", None, "1", "a@x"), (11, "Luis", "Paz", "2", "l@x")],
                                     "ID_Cliente long, Nombre string, Apellido string, Telefono string, correo string")
    return {"pedidos": pedidos, "detalle": detalle, "productos": productos, "clientes": clientes}


def test_report_window_and_fan_out(spark):
    d = _report_tables(spark)
    top = {r.id: r for r in R.top_products(d, AS_OF).collect()}
    assert top[100].total_quantity == 3.0 and top[100].order_count == 2 and top[100].total_revenue == 5.0
    assert list(r.id for r in R.top_products(d, AS_OF, n=1).collect()) == [100]
    cli = {r.id: r for r in R.top_clients(d, AS_OF).collect()}
    assert cli[10].total_amount == 200.0                          # header total counted per line (S4)
    assert cli[11].total_amount == 10.0 and cli[11].name == "Luis Paz"
    exact = {r.id: r.total_amount for r in R.top_clients_exact(d, AS_OF).collect()}
    assert exact == {10: 100.0, 11: 10.0}


def _clients(spark):
    return spark.createDataFrame([(1, "Ana", "Gil", 3), (2, "Luis", None, 4)],
                                 "ID_Cliente long, Nombre string, Apellido string, ID_Zona int")


def test_update_latest_wins_explicit_null_overwrites(spark):
    base = _clients(spark)
    ch = spark.createDataFrame([(1, 1, "A1", None, 5), (1, 2, "A2", None, 6), (9, 3, "X", "Y", 1)],
                               "ID_Cliente long, change_seq long, Nombre string, Apellido string, ID_Zona int")
    snap, rej = W.update_rows(base, ch, "ID_Cliente", ["Nombre", "Apellido", "ID_Zona"])
    assert sorted(snap.collect()) == [(1, "A2", None, 6), (2, "Luis", None, 4)]
    assert [(r.ID_Cliente, r.reason) for r in rej.collect()] == [(9, "not_found")]


def test_partial_update_keeps_latest_supplied_field(spark):
    base = _clients(spark)
    ch = spark.createDataFrame([(1, 1, "A1", "G1", None), (1, 2, None, "G2", None), (2, 3, None, None, None)],
                               "ID_Cliente long, change_seq long, Nombre string, Apellido string, ID_Zona int")
    snap, rej = W.partial_update(base, ch, "ID_Cliente", ["Nombre", "Apellido", "ID_Zona"])
    assert sorted(snap.collect()) == [(1, "A1", "G2", 3), (2, "Luis", None, 4)]
    assert [r.reason for r in rej.collect()] == ["nothing_to_update"]


def test_insert_ids_and_insert_if_absent_idempotent(spark):
    base = spark.createDataFrame([(5, "111"), (9, "222")], "ID_Repartidor int, DNI string")
    new = spark.createDataFrame([(None, 3, "333"), (None, 1, "222"), (None, 2, "333"), (None, 4, "444")],
                                "ID_Repartidor int, change_seq long, DNI string")
    snap, ins = W.insert_if_absent(base, new, ["DNI"], "ID_Repartidor")
    assert sorted((r.ID_Repartidor, r.DNI, r.change_seq) for r in ins.collect()) == [(10, "333", 2), (11, "444", 4)]
    snap2, ins2 = W.insert_if_absent(snap, new, ["DNI"], "ID_Repartidor")
    assert ins2.count() == 0 and sorted(snap2.collect()) == sorted(snap.collect())


def test_guarded_and_cascade_delete(spark):
    drivers = spark.createDataFrame([(1,), (2,), (3,)], "ID_Repartidor int")
    orders = spark.createDataFrame([(10, 1), (11, 1), (12, None)], "ID_TomaPedido long, ID_Repartidor int")
    kept, rej = W.guarded_delete(drivers, spark.createDataFrame([(1,), (2,)], "ID_Repartidor int"),
                                 "ID_Repartidor", orders, "ID_Repartidor")
    assert sorted(r.ID_Repartidor for r in kept.collect()) == [1, 3]
    assert [(r.ID_Repartidor, r.ref_count) for r in rej.collect()] == [(1, 2)]
    lines = spark.createDataFrame([(10, 1), (10, 2), (12, 3)], "ID_TomaPedido long, ID_Producto long")
    o, li = W.cascade_delete(orders, lines, spark.createDataFrame([(10,)], "ID_TomaPedido long"))
    assert sorted(r.ID_TomaPedido for r in o.collect()) == [11, 12]
    assert [r.ID_Producto for r in li.collect()] == [3]


def test_product_defaults(spark):
    ch = spark.createDataFrame(
        [(1, 1, "x", "", None, 0, 7, None, 0, None, None, None, None, None, None, None, None, None, "", None, None, False),
         (2, 2, None, "s", None, None, 7, 3, 1, 1, None, None, None, None, None, None, None, 2, "CJ", 6, "Baja", None)],
        "ID_Producto long, change_seq long, Descripcion string, Pr_Ean13 string, PrecioFinalUni decimal(18,2), "
        "Stock int, ID_Proveedor long, ID_Rubro int, idMarca int, IdAlicIva int, Costo decimal(18,2), "
        "CostoUnit decimal(18,2), margen decimal(18,2), PrecioFinalPack decimal(18,2), PrecioNetoPack decimal(18,2), "
        "PrecioNetoUni decimal(18,2), MontoIVA decimal(18,2), PMR int, Pr_Pack string, Pr_UniXPack int, "
        "Estado string, PermiteDescuento boolean")
    good, bad = W.normalise_products(ch)
    g = good.first()
    assert (g.Pr_Ean13, g.PrecioFinalUni, g.Stock, g.ID_Rubro, g.idMarca, g.PMR, g.Pr_Pack, g.Pr_UniXPack,
            g.Estado, g.PermiteDescuento) == (None, 0, 0, 1, None, 1, "UN", 1, "Activo", False)
    assert [(r.ID_Producto, r.reason) for r in bad.collect()] == [(2, "missing_name")]


def test_migration_repairs_and_loads_without_orphans(spark, fx):
    src = {"productos": fx.productos_src, "pedidos": fx.pedidos_src, "detalle": fx.detalle_items,
           "marca": fx.marca, "alicuotas": fx.alicuotas}
    dst = fx.tables("proveedores", "rubros", "marca", "alicuotas", "clientes", "condicion_pago")
    out = M.migrate(src, dst, 1000)
    report = C.check_constraints({"productos": out["productos"], "pedidos": out["pedidos"],
                                  "detalle": out["detalle"], **{k: v for k, v in dst.items()}})
    fk = {(r.table_name, r.columns): r.violations for r in report.collect() if r.rule.startswith("foreign_key")}
    assert fk[("productos", "ID_Proveedor")] == 0 and fk[("productos", "idMarca")] == 0
    assert fk[("pedidos", "ID_Cliente")] == 0 and fk[("pedidos", "ID_Condicion")] == 0
    assert out["pedidos"].count() <= 1000
    orphans = out["detalle"].join(out["pedidos"], "ID_TomaPedido", "left_anti").count()
    assert orphans == 0
    stock = out["productos"].agg(F.min("Stock"), F.max("Stock")).first()
    assert stock[0] >= 0 and stock[1] < 500
    again = M.load_products(fx.productos_src, dict(dst)).select("ID_Producto", "Stock")
    assert sorted(again.collect()) == sorted(out["productos"].select("ID_Producto", "Stock").collect())
    twice = M.ensure_column(M.ensure_column(fx.productos, "PermiteDescuento", "boolean", True),
                            "PermiteDescuento", "boolean", True)
    assert twice.columns == fx.productos.columns


def test_catalog_sort_with_collation(spark):
    from bodega.operators import listings as L
    zona = spark.createDataFrame([(1, "beta"), (2, "Alfa  "), (3, "alfa")], "ID_Zona int, Descripcion string")
    binary = [r.id for r in L.zone_list({"zona": zona}).collect()]
    assert binary == [2, 3, 1]                                    # 'A' < 'a' < 'b' in binary order
    ci = [r.descripcion for r in L.zone_list({"zona": zona}, collation="UNICODE_CI_RTRIM").collect()]
    assert ci[2] == "beta" and sorted(ci[:2]) == ["Alfa", "alfa"]


def test_rows_without_a_key_are_answered(spark):
    from bodega.operators import changes as W
    base = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "id int, name string, dni int")
    edits = spark.createDataFrame([(1, "x", 1), (None, "lost", 2), (9, "y", 3)], "id int, name string, _seq int").withColumnRenamed("_seq", W.SEQ)
    snapshot, rejects = W.partial_update(base, edits, "id", ["name"])
    assert {r.id: r.name for r in snapshot.collect()} == {1: "x", 2: "b"}
    assert sorted(r.reason for r in rejects.collect()) == ["missing_key", "not_found"]
    new = spark.createDataFrame([("n1", None, 1), ("n2", None, 2), ("n3", 5, 3), ("n4", 6, 4), ("n5", 6, 5)], "name string, dni int, _seq int").withColumnRenamed("_seq", W.SEQ)
    _, inserted = W.insert_if_absent(base, new, ["dni"], "id")
    assert sorted(r.name for r in inserted.collect()) == ["n1", "n2", "n4"]


@pytest.mark.parametrize("n", [0, 1, 3, 1000, 1001, 1500, 2400, 2500, 2600, 2610, 9000, None])
def test_newest_by_ranges(spark, n):
    """The n largest keys: ties cut to the number asked for, rows without a key last."""
    from bodega.operators.migration import newest
    keys = [i * 7919 % 100_003 - 50_000 for i in range(2400)] + [5] * 150 + [10 ** 15] * 50 + [None] * 10
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(3)
    got = [r.k for r in newest(df, "k", n).collect()]
    want = sorted(keys, key=lambda k: (k is not None, k or 0), reverse=True)[:n]
    assert sorted(got, key=lambda k: (k is not None, k or 0)) == sorted(want, key=lambda k: (k is not None, k or 0))


def test_change_log_equals_one_by_one(spark):
    import random
    from bodega.operators.changes import apply_change_log
    rnd = random.Random(2)
    base = {k: (f"a{k}", k, "x") for k in range(30)}
    log = [(rnd.choice([None, *range(40), 7, 7, 7]), s, rnd.choice(["insert", "replace", "partial", "delete", "merge"]),
            rnd.choice([None, f"n{s}"]), rnd.choice([None, s])) for s in rnd.sample(range(-500, 500), 400)]
    state, rejects = dict(base), set()
    for k, s, op, a, b in sorted(log, key=lambda r: r[1]):
        why = ("missing_key" if k is None else "unknown_op" if op == "merge" else "nothing_to_update" if op == "partial" and a is None and b is None
               else "exists" if op == "insert" and k in state else "not_found" if op != "insert" and k not in state else None)
        if why:
            rejects.add((k, s, why))
        elif op == "delete":
            del state[k]
        elif op == "insert":
            state[k] = (a, b, None)
        else:
            old = state[k]
            state[k] = (a, b, old[2]) if op == "replace" else (old[0] if a is None else a, old[1] if b is None else b, old[2])
    for hot in ("1000000", "5"):
        spark.conf.set("bodega.hotGroupRows", hot)
        try:
            snap, bad = apply_change_log(spark.createDataFrame([(k, *v) for k, v in base.items()], "k long, a string, b long, c string"),
                                         spark.createDataFrame(log, "k long, change_seq long, op string, a string, b long"), "k", ["a", "b"])
            assert {r.k: (r.a, r.b, r.c) for r in snap.collect()} == state
            assert {tuple(r) for r in bad.collect()} == rejects
        finally:
            spark.conf.unset("bodega.hotGroupRows")

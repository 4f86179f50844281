"""Stock below zero, line by line."""
import random
from decimal import Decimal

import pytest

from bodega.operators.stock import Steps, walk_stock


def one_by_one(stock, hundredths):
    for q in hundredths:
        stock = int((Decimal(stock) * 100 - q) / 100)  # cut toward zero
    return stock


@pytest.mark.parametrize("seed", range(4))
def test_composed_steps(seed):
    rnd = random.Random(seed)
    for _ in range(200):
        lines = [rnd.choice([100, 250, 50, 1, 99, 700, -50, -150, -300, 0, rnd.randrange(-900, 900)]) for _ in range(rnd.randrange(25))]
        steps = Steps()
        for q in lines:
            steps.add(q)
        for s in range(-40, 60):
            assert s - steps.base - sum(c <= s for c in steps.cuts) == one_by_one(s, lines)


@pytest.mark.parametrize("hot", ["1000000", "5"])
def test_walk_stock(spark, hot):
    rnd = random.Random(6)
    stock = {p: rnd.choice([None, 0, 5, -3, 60]) for p in range(12)}
    lines = [(rnd.choice([0, 0, 0, *range(14)]), Decimal(rnd.choice(["1", "2.5", "0.01", "-1.5", "7", "0.5"])) if rnd.random() < 0.95 else None, r, r % 3)
             for r in range(300)]
    spark.conf.set("bodega.hotGroupRows", hot)
    try:
        products = spark.createDataFrame([(p, s, "x") for p, s in stock.items()], "ID_Producto long, Stock int, Descripcion string")
        got = walk_stock(products, spark.createDataFrame(lines, "product_id long, quantity decimal(18,2), request_id long, pos int").repartition(4),
                         ["request_id", "pos"])
        assert got.columns == products.columns
        want = {p: None if s is None else one_by_one(s, [int(q * 100) for k, q, *_ in sorted(lines, key=lambda x: x[2:]) if k == p and q is not None])
                for p, s in stock.items()}
        assert {r.ID_Producto: r.Stock for r in got.collect()} == want
        assert min(v for v in want.values() if v is not None) < 0
    finally:
        spark.conf.unset("bodega.hotGroupRows")

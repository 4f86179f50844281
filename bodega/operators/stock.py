"""Stock after lines taken one by one, exact also below zero.

``Stock = Stock - q`` is computed as a real number and cut toward zero, so a line takes
ceil(q) while the result stays at or above zero and floor(q) below it. A whole line is
the same step for every stock; a fractional one is a map with one threshold:
    s -> s - floor(q) - (1 if s >= ceil(q) else 0).
Any sequence of such maps is of the form s -> s - base - (number of cuts <= s): every
fractional line adds one cut, the least s that arrives at its threshold. So the lines
of a product can be composed in slices, apart from each other and before the stock at
the start of a slice is known, and only the composed slices are applied in order.
"""
from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bodega.functions.sequence import hot_keys, stage_ranges


class Steps:
    """A composed sequence of lines: s -> s - base - (number of cuts <= s)."""

    def __init__(self):
        self.base, self.cuts = 0, []

    def add(self, hundredths: int) -> None:
        """Then a line of so many hundredths is taken."""
        low, rest = divmod(hundredths, 100)
        if rest:
            insort(self.cuts, self._least(low + 1))
        self.base += low

    def _least(self, value: int) -> int:
        """The least s from which the sequence arrives at ``value`` or above."""
        want, lo, hi = value + self.base, 0, len(self.cuts)
        while lo < hi:  # with k cuts at or below it, s arrives at s - base - k
            mid = (lo + hi) // 2
            if self.cuts[mid] - mid > want:
                hi = mid
            else:
                lo = mid + 1
        return want + lo


def walk_stock(products: DataFrame, lines: DataFrame, order: Sequence[str]) -> DataFrame:
    """The snapshot of ``products`` after ``lines`` (product_id, quantity and the columns of
    ``order``, in whose order they are taken, smaller quantities first where they tie;
    give-backs are negative quantities). A line without
    a quantity, or of a product that does not exist, takes nothing; a product without a
    stock figure keeps none. Products with very many lines are range-split; a slice's
    lines are composed in one task, and slices are applied in a stream."""
    order = [*order, "_q"]
    used = lines.where(F.col("quantity").isNotNull()).select(
        "product_id", (F.col("quantity").cast("decimal(18,2)") * 100).cast("long").alias("_q"), *order[:-1])
    hot = hot_keys(used, ["product_id"])
    slices = used.withColumn("_seq_pid", F.lit(0))
    if hot is not None:
        keys = F.broadcast(hot)
        slices = slices.join(keys, "product_id", "left_anti").unionByName(
            stage_ranges(used.join(keys, "product_id", "left_semi"), ["product_id"], list(order)))
    key = used.schema["product_id"].dataType.simpleString()

    def compose(table: pa.Table) -> pa.Table:
        steps = Steps()
        for q in table.sort_by([(c, "ascending") for c in order]).column("_q").to_pylist():
            steps.add(q)
        return pa.table({"product_id": table.column("product_id").slice(0, 1), "part": table.column("_seq_pid").slice(0, 1),
                         "base": pa.array([steps.base], pa.int64()), "cuts": pa.array([steps.cuts], pa.list_(pa.int64()))})

    composed = slices.groupBy("product_id", "_seq_pid").applyInArrow(compose, f"product_id {key}, part int, base long, cuts array<long>")
    stock = products.select(F.col("ID_Producto").alias("product_id"), F.col("Stock").cast("long").alias("stock"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, now, out = None, 0, []
        for b in batches:
            for p, start, base, cuts in zip(*(b.column(i).to_pylist() for i in range(4))):
                if p != product:
                    if product is not None:
                        out.append((product, now))
                    product, now = p, start
                now = now - base - bisect_right(cuts, now)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["ID_Producto", "after"])
                out = []
        if product is not None:
            out.append((product, now))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["ID_Producto", "after"])

    after = (composed.join(stock.where("stock IS NOT NULL"), "product_id").repartition("product_id").sortWithinPartitions("product_id", "part")
             .select(F.col("product_id").cast("long"), "stock", "base", "cuts").mapInArrow(apply, "ID_Producto long, after long"))
    moved = products.join(after, "ID_Producto", "left")
    return moved.select(*[F.coalesce(F.col("after"), F.col("Stock")).cast(products.schema["Stock"].dataType).alias("Stock") if c == "Stock" else F.col(c)
                          for c in products.columns])

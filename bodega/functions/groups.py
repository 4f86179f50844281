"""Connected groups of a link table, by alternating star steps.

A round moves every node's larger neighbours to its smallest one, then every node's
smaller neighbours likewise, until nothing changes: about log^2 rounds in the longest
chain. Each round is one shuffle of the links with map-side minimums, checkpointed to
the shared folder; only a count and a checksum reach the driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bodega.functions.sequence import reliable_checkpoint


def _toward_smallest(links: DataFrame, larger: bool) -> DataFrame:
    """``links`` (a > b): from both ends the larger neighbours, or from the larger end
    the smaller ones, are linked to the smallest of the node and its neighbours."""
    seen = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else links
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = seen.join(least, "a")
    if larger:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_groups(links: DataFrame) -> DataFrame:
    """``links``: a, b (longs). Returns node, grp (the smallest node of its group) for
    every node that is linked to another."""
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    while True:
        now = reliable_checkpoint(_toward_smallest(_toward_smallest(now, True), False))
        state = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == before:
            break
        before = state
    found = now.select(F.col("a").alias("node"), F.col("b").alias("grp"))
    return found.unionByName(found.select(F.col("grp").alias("node"), "grp")).distinct()

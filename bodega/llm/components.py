"""Connected components of a link table by alternating star steps.

Each round rewires every node's larger neighbours to its smallest one (large
star), then every node's smaller neighbours to the smallest (small star);
O(log^2) rounds reach stars around each component's smallest node. A round is
a shuffle of the links with a map-side minimum, and is written to the shared
folder, so lineage stays short and a lost executor repeats one round at most.
Only a count and a checksum reach the driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bodega.llm.common import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links``: u, v with u > v. Large star looks from both ends, small star from the
    larger end only."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: u, v (longs). Returns node, component (its smallest node) for every
    node that has a link to another."""
    current = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    sign = None
    while True:
        current = stored(_star(_star(current, True), False), "components")
        now = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == sign:
            break
        sign = tuple(now)
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component")).distinct()

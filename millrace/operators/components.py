"""Connected components by alternating large-star and small-star contractions.

Every round is a grouped minimum and a join back, both on plain shuffles: the minimum is pre-aggregated before it
shuffles, and the join's edge side is what adaptive execution splits when one hub holds many edges. No edge, node or
component ever reaches the driver; a round returns a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

MAX_ROUNDS = 60


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for every node that some edge joins to another node, the least node of its component.

    Nodes are of any orderable type. Self loops, repeated edges and edges with a null end have no effect; a node
    without edges isn't returned (it is its own root). An empty input gives an empty result.
    """
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    e = settle(e.filter(edges[a].isNotNull() & edges[b].isNotNull() & (F.col("hi") != F.col("lo"))).distinct())
    before = _checksum(e)
    if before[0] == 0:
        return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    for _ in range(MAX_ROUNDS):
        # Large star: neighbours above u go to the least neighbour.
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # Small star: neighbours below u, and u, go to the least of them.
        down = large.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        small = joined.select(F.col("v").alias("hi"), F.col("m").alias("lo")).unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
        e = settle(small.filter(F.col("hi") != F.col("lo")).distinct())
        now = _checksum(e)
        if now == before:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = now
    raise RuntimeError(f"no fixed point in {MAX_ROUNDS} rounds")

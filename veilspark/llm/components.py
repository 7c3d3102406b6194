"""Connected components by alternating large-star and small-star steps on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime as R


#: A node with more neighbours than this, and than a HUB_SHARE-th of all edges, is a hub; so there are 2 * HUB_SHARE hubs at most. Fewer edges in all make no hub.
HUB, HUB_SHARE = 100_000, 500


def _star(edges: DataFrame, large: bool, hub: int | None) -> DataFrame:
    """One step on edges (u, v) with v < u: neighbours are tied to the least of a node's neighbourhood.

    The minimum of each node is a partial aggregate and is joined back to the
    edges on the node; those of hubs, few by their definition, are broadcast, so that a hub's edges stay where they are.
    """
    at = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = at.groupBy("u").agg(F.min("v").alias("w"), F.count("*").alias("n")).select("u", F.least("u", "w").alias("m"), "n")
    if hub is None:
        return _ends(at.join(least.select("u", "m"), "u"), least, large)
    hubs = F.broadcast(least.where(F.col("n") > hub).select("u", F.col("m").alias("of_hub")))
    sorted_out = at.join(hubs, "u", "left")
    of_hubs = sorted_out.where("of_hub IS NOT NULL").select("u", "v", F.col("of_hub").alias("m"))
    tied = sorted_out.where("of_hub IS NULL").select("u", "v").join(least.where(F.col("n") <= hub).select("u", "m"), "u").unionByName(of_hubs)
    return _ends(tied, least, large)


def _ends(tied: DataFrame, least: DataFrame, large: bool) -> DataFrame:
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("v < u").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (u, v): the least node reachable.

    Loops, repeated and reversed edges are fine. Each round is a table in the
    shared folder, so lineage stays short; rounds grow with the logarithm of the
    longest chain. Only two numbers a round reach the driver.
    """
    spark = edges.sparkSession
    at, path = R.stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("v < u").distinct())
    state = None
    while True:
        now = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == state or not now[0]:
            break
        state = now
        before, hub = path, max(HUB, now[0] // HUB_SHARE) if now[0] > HUB else None
        at, path = R.stored(_star(_star(at, True, hub), False, hub))
        R.drop(spark, before)
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

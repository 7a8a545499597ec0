"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from repoquarry.operators.grouping import spread_join
from repoquarry.plans.storage import settle


def _joined_to_least(links: DataFrame, near: Column) -> DataFrame:
    """Rows (u, v, m): both directions of the links kept by `near`, with the least of u and its kept neighbours."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return spread_join(both.where(near), least, ["u"], "v")


def connected_components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) for every node of `links (u, v)`, the component being its smallest node.

    Each round is two shuffle aggregations and joins over the links, in which the links of a hub are dealt over several
    tasks; they are written to shared storage after every round, so lineage stays short and a lost executor costs one
    round.  Rows with a null end are left out.
    The number of rounds grows with the logarithm of the longest chain; running out of them is an error.
    """
    links = links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = settle(links, "links")
    before = None
    for _ in range(rounds):
        large = _joined_to_least(links, F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every link now points from a larger to a smaller node; small-star: smaller neighbours of u, and u, to their least
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, least, ["u"], "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        # counted and summed up while they are written: links equal to those of the last round are the result
        watched = Observation()
        links = settle(small.observe(watched, F.count("u").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "links")
        state = watched.get
        if before == state:
            roots = links.select(F.col("v").alias("node")).distinct()
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                roots.select("node", F.col("node").alias("component"))
            )
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")

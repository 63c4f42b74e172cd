"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.sources.store import settle


def _sum(links: DataFrame) -> tuple:
    """Count and hash sums of a set of edges: equal for equal sets."""
    return tuple(links.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64(F.lit(i), "low", "high").cast("decimal(20,0)")) for i in (0, 1)]).first())


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` to ``node, component``: the smallest node reachable from each node that has an edge.

    Alternating large and small stars (each node links its larger, then its smaller neighbours to the least
    of them) until nothing changes: a number of rounds that grows with the logarithm of the graph, each two
    aggregates and joins over a table that never has more edges than at the start. Every round is written
    to the shared folder; only a count and a checksum come to the driver. Self links and repeated
    edges are allowed; nulls are not edges.
    """
    low, high = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    links = edges.where("a is not null and b is not null and a <> b").select(low, high).distinct()
    links = settle(links, "links")
    now = _sum(links)
    while now[0]:
        both = links.select(F.col("high").alias("at"), F.col("low").alias("to")).unionByName(links.select(F.col("low").alias("at"), F.col("high").alias("to")))
        least = both.groupBy("at").agg(F.least(F.min("to"), F.col("at")).alias("least"))
        large = both.join(least, "at").where("to > at").select(F.col("least").alias("low"), F.col("to").alias("high")).where("low <> high").distinct()
        least = large.groupBy("high").agg(F.min("low").alias("least"))
        small = large.join(least, "high").select(F.explode(F.array(F.struct(F.col("least").alias("low"), F.col("high").alias("high")), F.struct(F.col("least").alias("low"), F.col("low").alias("high")))).alias("e"))
        small = settle(small.select("e.*").where("low <> high").distinct(), "links")
        before, now, links = now, _sum(small), small
        if now == before:
            break
    roots = links.select(F.col("low").alias("node")).distinct()
    return links.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))

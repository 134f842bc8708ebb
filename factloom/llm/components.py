"""Connected components over a table of links, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the least node reachable.

    Alternates large-star and small-star steps: every node hands its neighbours
    the least node it knows, until each remaining edge joins a node to its root.
    Edges never grow in number by more than the nodes, the rounds are about
    logarithmic, and each round's edges are checkpointed. Both ends must be
    non-null; self links are ignored. No links, no rows.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        edges = saved(small.distinct())
        if edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

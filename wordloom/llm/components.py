"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import discard, settle


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge; component: the smallest node reachable.

    Alternating large-star and small-star rounds: the first links a node's larger
    neighbours to its smallest one, the second its smaller ones; both keep the
    components and end in stars around their smallest nodes, after about the
    logarithm of the longest path. Each is a minimum per node, combined before
    the shuffle, and a join back that may be split where a node is hot. Edges
    with a null end or from a node to itself link nothing.
    """
    now = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(f"{a} IS NOT NULL AND {b} IS NOT NULL AND u <> v").distinct())
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state["n"] == 0 or (state["n"], state["s"]) == seen:
            break
        seen = (state["n"], state["s"])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, settle(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        discard(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

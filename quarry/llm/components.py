"""Connected components of a graph of links, as Spark jobs of a fixed shape."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """node, component (smallest node reachable) for every node of ``links`` (a, b).

    Alternating large-star and small-star steps: in a large-star step each node sends its larger
    neighbours to its smallest one, in a small-star step its smaller neighbours and itself. Both
    keep components whole, and a few rounds, logarithmic in the size, leave stars around the
    smallest nodes. A step is one aggregate and one join on a node; every round is written out. Null
    ends and links of a node with itself are no links; no links give no rows.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.write(edges, f"{name}_0")
    before = None
    for k in itertools.count(1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        new = scratch.write(small.where(F.col("u") != F.col("v")).distinct(), f"{name}_{k}")
        # a round that changes nothing leaves the same edges: compare count and hash sums
        after = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(f"{name}_{k - 1}")
        edges = new
        if after == before:
            break
        before = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""Connected components of an edge table, without collecting it: each round every node takes the smallest label it can see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import dropped, staged


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): for each node of ``edges`` (long columns a, b), the smallest node it is connected to.

    Alternates large-star and small-star steps (Kiveris et al., 2014): the edges of each node are re-hung on its smallest neighbour, until
    every edge leads to a root. Rounds grow with the logarithm of the longest chain. A hub's edges are never gathered: its smallest
    neighbour is a pre-aggregated minimum, joined back.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), name)
    while True:
        # Large star: larger neighbours of a node hang on its smallest neighbour (or itself).
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)  # a table: a hub's partition of the join can then be split
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # Small star: smaller neighbours of a node, and the node, hang on the smallest of them.
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        next_ = staged(large.join(small, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*").where("hi <> lo").distinct(), name)
        dropped(now, least)
        # Done when each node hangs on one root, and no root hangs on another.
        split = next_.groupBy("hi").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        deep = next_.select(F.col("lo").alias("hi")).distinct().join(next_, "hi", "left_semi")
        now = next_
        if split.isEmpty() and deep.isEmpty():
            break
    leaves = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())

"""Connected components of links between long identifiers, on DataFrames.

Alternating large-star and small-star rounds: every round hangs a node's larger neighbours on its smallest one, until
each node hangs on the smallest node of its component. A round's links are written to the shared folder, so lineage
stays short and a lost executor costs one round at most. Nothing is collected but a count and a checksum of a round. The
links of a node that has many are joined where they lie, so a large star doesn't gather in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import join_spread, stored


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to (node, label): label is the smallest node reachable; nodes without links don't appear."""
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), "links")
    total, mark = now.count(), None
    while total:  # every round leaves fewer links or hangs nodes lower; a round that changes nothing is the last
        both = now.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(now.select(F.col("y").alias("u"), F.col("x").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_spread(both, least, ["u"], "n", 2 * total).where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct()
        large = stored(large, "links")
        least = large.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_spread(large, least, ["x"], "n", 2 * total).where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(least.select("x", F.col("m").alias("y"))).distinct()
        now = stored(small, "links")
        found = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).collect()[0]
        if found == mark:
            break
        total, mark = found["n"], found
    return now.select(F.col("x").alias("node"), F.col("y").alias("label")).unionByName(now.select(F.col("y").alias("node"), F.col("y").alias("label")).distinct())

"""Connected components of an edge table, by alternating star contractions.

Each round is a few aggregations and joins over the edges; nothing but a count
and a checksum reaches the driver, and each round's edges are written to the
shared folder. The number of rounds grows with the logarithm of the longest
chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sparkmalt.llm.store import written


def counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, with their number and a checksum, which are taken while they are written."""
    seen = Observation()
    out = written(edges.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("sum")), "edges")
    return out, (seen.get["n"], seen.get["sum"])


def large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours get its smallest neighbour (or itself)."""
    both = edges.select(F.explode(F.array(F.struct(F.col("v").alias("x"), F.col("u").alias("y")), F.struct(F.col("u").alias("x"), F.col("v").alias("y")))).alias("e")).select("e.x", "e.y")
    # written, so that the join reads two plain sides and the edges of a hot node can be split
    least = written(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "least")
    return both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u"))


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours get the smallest of them."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    lower = edges.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return lower.union(least.select("v", F.col("m").alias("u"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that isn't the smallest of its component, the root."""
    now, seen = counted(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    while seen[0]:
        now, found = counted(small_star(large_star(now)))
        if found == seen:
            break
        seen = found
    return now.select(F.col("v").alias("node"), F.col("u").alias("root"))

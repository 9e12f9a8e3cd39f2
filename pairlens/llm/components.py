"""Connected components of a link table, by alternating large and small stars.

Each step is an aggregate to the least neighbour (combined on the map side) and a
join back, so a node with a third of all links is split like any skewed join. The
links are rewritten to the shared folder every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's least neighbour."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    j = both.where("b > a").join(least, F.col("a") == F.col("n"))
    return j.select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    least = e.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("n"), "m")
    j = e.join(least, F.col("b") == F.col("n"))
    return (j.select(F.col("m").alias("a"), F.col("a").alias("b"))
            .unionByName(least.select(F.col("m").alias("a"), F.col("n").alias("b")))
            .where("a < b").distinct())


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: bigint) to (node, root): every node that has a link, and the least node it reaches."""
    e = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    e = stored(e, "links")
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
        e = stored(_small(_large(e)), "links")
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())

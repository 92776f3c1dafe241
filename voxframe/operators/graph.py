"""Groups of what is linked, directly or not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_table


def components(edges: DataFrame) -> DataFrame:
    """``c, root``: every end of an edge (``a, b``) with the smallest end it is linked to; a root itself is not listed.

    Alternating stars: a round ties all larger neighbours of an end to its smallest one, then all smaller ones, so a chain of any length takes a
    number of rounds that grows with its logarithm.  Only minima are aggregated, no neighbourhood is collected; each round is
    written to the shared folder.  Null ends and ends tied to themselves take no part.
    """
    state = edges.where("a <> b").select("a", "b")
    mark = None
    while True:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        state = shared_table(small.unionByName(low.withColumnRenamed("m", "b")).distinct())
        after = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if after == mark:
            return state.select(F.col("a").alias("c"), F.col("b").alias("root"))
        mark = after

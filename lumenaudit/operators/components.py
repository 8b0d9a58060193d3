"""Connected components of a link table by alternating stars: large neighbours, then small ones, hang on the least node in reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored


def _hang(links: DataFrame, large: bool) -> DataFrame:
    """(a, b), a > b: of each node's neighbours the larger (or the smaller) ones take its least neighbour, itself included, for theirs."""
    near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    hung = near.join(least, "a").where((F.col("b") > F.col("a")) if large else F.lit(True)).select(F.col("b").alias("x"), "m")
    if not large:
        hung = hung.unionByName(least.select(F.col("a").alias("x"), "m"))
    return hung.where("x <> m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links(a, b): the least node of its component. Rounds are written to the shared folder; the driver sees two numbers a round."""
    now, seen = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), None
    while True:
        now = stored(_hang(_hang(now, True), False), "links")
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        seen = state

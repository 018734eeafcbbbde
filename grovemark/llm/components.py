"""Connected components of a graph given as a table of edges, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovemark.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable; only nodes with an edge to another node have a row.

    edges has the columns a and b of one type. Large-star and small-star steps alternate, each a minimum for every node
    (combined before the shuffle) and a join that Spark may split at a hub. A round is written as a table, so a lost
    executor costs a read. The number of rounds grows with the logarithm of the longest path.
    """
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
    now = cut(ordered.distinct())
    before = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())
        if mark == before:
            return now.select(F.col("high").alias("node"), F.col("low").alias("root")).union(
                now.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
            )
        before = mark
        both = now.unionByName(now.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = both.groupBy("high").agg(F.least("high", F.min("low")).alias("least"))
        large = (
            now.select(F.col("low").alias("high"), F.col("high").alias("other"))
            .join(least, "high")
            .select(F.col("other").alias("high"), F.col("least").alias("low"))
        )
        large = cut(large.filter("high <> low").distinct())
        first = large.groupBy("high").agg(F.min("low").alias("least"))
        small = large.join(first, "high").filter("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
        now = cut(small.unionByName(first.withColumnRenamed("least", "low")).distinct())

"""Average linkage over a given table of pairwise distances: pairs(a, b, distance), every pair once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovemark.operators.linkage import EVENT_COLUMNS, Linkage, number_merges
from grovemark.operators.sampling import dense_ids
from grovemark.session import cut


def _merge_mutual(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """The merges of clusters that are nearest to each other; equal distances go to the smaller name."""
    ends = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("end"), "total", "weight")
    ends = ends.select(
        F.col("end.a").alias("low"), F.struct((F.col("total") / F.col("weight")).alias("distance"), F.col("end.b").alias("mate")).alias("to")
    )
    nearest = ends.groupBy("low").agg(F.min("to").alias("to")).select("low", "to.mate", "to.distance")
    back = nearest.select(F.col("low").alias("mate"), F.col("mate").alias("low"))
    sizes = clusters.select("low", "size", "height")
    others = sizes.select(
        F.col("low").alias("mate"), F.col("size").alias("mate_size"), F.col("height").alias("mate_height")
    )
    return (
        nearest.filter("low < mate")
        .join(back, ["low", "mate"])
        .join(sizes, "low")
        .join(others, "mate")
        .select(
            "low",
            F.col("size").alias("left_size"),
            F.col("mate").alias("right_low"),
            F.col("mate_size").alias("right_size"),
            (F.col("size") + F.col("mate_size")).alias("size"),
            F.greatest("distance", "height", "mate_height").alias("height"),
        )
    )


def average_linkage_of_pairs(points: DataFrame, pairs: DataFrame, key: str) -> Linkage:
    """Merge all points; pairs name points by the key. The distance of two clusters is the mean over pairs."""
    leaves = cut(dense_ids(points.select(key), [key], "leaf"))
    n_leaves = leaves.count()
    if pairs.count() * 2 != n_leaves * (n_leaves - 1):
        raise ValueError("every pair of points must have exactly one distance")
    first = leaves.select(F.col(key).alias("a"), F.col("leaf").alias("leaf_a"))
    second = leaves.select(F.col(key).alias("b"), F.col("leaf").alias("leaf_b"))
    state = cut(
        pairs.join(first, "a")
        .join(second, "b")
        .select(
            F.col("leaf_a").alias("a"),
            F.col("leaf_b").alias("b"),
            F.col("distance").cast("double").alias("total"),
            F.lit(1).cast("long").alias("weight"),
        )
    )
    clusters = leaves.select(F.col("leaf").alias("low"), F.lit(1).cast("long").alias("size"), F.lit(0.0).alias("height"))
    n_clusters, events, rounds = n_leaves, [], 0
    while n_clusters > 1:
        merged = cut(_merge_mutual(state, clusters))
        events.append(merged.select(*EVENT_COLUMNS))
        into = merged.select(F.col("right_low").alias("name"), F.col("low").alias("into"))

        def renamed(side: str) -> DataFrame:
            return into.select(F.col("name").alias(side), F.col("into").alias(f"into_{side}"))

        moved = state.join(renamed("a"), "a", "left").join(renamed("b"), "b", "left").select(
            F.coalesce("into_a", "a").alias("x"), F.coalesce("into_b", "b").alias("y"), "total", "weight"
        )
        state = cut(
            moved.filter("x != y")
            .groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))
        )
        grown = merged.select("low", "size", "height")
        gone = merged.select(F.explode(F.array("low", "right_low")).alias("low"))
        clusters = cut(clusters.join(gone, "low", "left_anti").unionByName(grown))
        n_clusters = clusters.count()
        rounds += 1
    merges = number_merges(reduce(DataFrame.unionByName, events), n_leaves)
    return Linkage(leaves, merges, n_leaves, rounds, [])

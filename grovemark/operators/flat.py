"""Flat clusterings: bisecting k-means and the assignment of phrases to the leaves of an external tree."""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovemark.functions.text import tokens_in_class, tokens_outside
from grovemark.operators.vectors import sum_vectors, unit_vectors


def bisecting_k_means(
    documents: DataFrame, vec: str, k: int, seed: int = 0, distance: str = "cosine", max_iter: int = 20
) -> DataFrame:
    """Add prediction, the cluster of each document.

    By cosine a zero vector belongs nowhere: its prediction is null, and it does not take part. Null vectors do not either.
    """
    taken = F.col(vec).isNotNull()
    if distance == "cosine":
        taken = taken & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))
    apart = documents.filter(~taken).withColumn("prediction", F.lit(None).cast("int"))
    features = documents.filter(taken).withColumn("_features", array_to_vector(F.col(vec).cast("array<double>")))
    learner = BisectingKMeans(
        k=k, seed=seed, distanceMeasure=distance, maxIter=max_iter, featuresCol="_features", predictionCol="prediction"
    )
    if features.isEmpty():
        return apart
    return learner.fit(features).transform(features).drop("_features").unionByName(apart)


def partition_costs(documents: DataFrame, parent: str, cluster: str, vec: str, dimensions: int) -> DataFrame:
    """(parent, cluster, n, cost): the sum of cosine distances of a cluster's vectors to the mean of their unit vectors.

    The row with a null cluster is the parent as one cluster, so what a split has gained is its cost less that of the
    others. Rows with a null or zero vector have no part.
    """
    units = unit_vectors(documents.select(parent, cluster, vec).filter(F.exists(vec, lambda x: x != 0)), vec)
    n = F.count(F.lit(1)).alias("n")
    parts = sum_vectors(units, [parent, cluster], vec, dimensions, n)
    # The parent's sum is that of its parts.
    whole = sum_vectors(parts, [parent], vec, dimensions, F.sum("n").alias("n")).withColumn(cluster, F.lit(None).cast(documents.schema[cluster].dataType))
    length = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda total, x: total + x * x))
    return parts.unionByName(whole).select(parent, cluster, "n", (F.col("n") - length).alias("cost"))


def seen_classes(phrases: DataFrame) -> DataFrame:
    """(class): every class that occurs in the index of some phrase."""
    return phrases.select(F.explode(F.map_keys("index")).alias("class")).distinct()


def keys_among(index: Column, leaves: DataFrame) -> Column:
    """The class keys of an index that are leaf labels.

    The labels form one short array: a tree is grown to a fixed number of leaves.
    """
    return F.array_intersect(F.map_keys(index), leaves.agg(F.collect_set("cluster_id")).scalar())


def assign_to_leaves(phrases: DataFrame, leaves: DataFrame) -> DataFrame:
    """Add cluster_id: the leaf label among the phrase's classes, the smallest of several, null without one."""
    return phrases.withColumn("cluster_id", F.array_min(keys_among(F.col("index"), leaves)))


def with_true_class(phrases: DataFrame, documents: DataFrame, key: str, document_key: str, label: str) -> DataFrame:
    """Left join of phrases to the documents' classes; the phrase key may be text. Repeated documents repeat rows."""
    classes = documents.select(F.col(document_key).cast("long").alias("_key"), label)
    return phrases.join(classes, F.col(key).cast("long") == F.col("_key"), "left").drop("_key")


def out_of_scope_words(phrases: DataFrame, class_id: int = 1) -> DataFrame:
    """(word): every token that some phrase does not list under the class."""
    inside = tokens_in_class(F.col("tokens"), F.col("index"), class_id)
    return phrases.select(F.explode(tokens_outside(F.col("tokens"), inside)).alias("word")).distinct()

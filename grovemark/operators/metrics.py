"""Scores of cluster trees and flat clusterings.

All of them work on counts(node, class, n), the documents of a class at or below a node (or in a flat cluster),
and totals(class, n), all documents of a class whether in the tree or not. A null class counts as documents but
is no class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovemark.operators.vectors import sum_vectors, unit_vectors
from grovemark.session import cut


def class_totals(documents: DataFrame, label: str) -> DataFrame:
    return documents.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def totals_of_counts(counts: DataFrame) -> DataFrame:
    """(class, n): class totals of a contingency table, without another look at the documents."""
    return counts.groupBy("class").agg(F.sum("n").alias("n"))


def node_precision(counts: DataFrame) -> DataFrame:
    """(node, n, majority, precision): the share of the largest class in each node with documents."""
    named = F.when(F.col("class").isNotNull(), F.col("n"))
    return (
        counts.groupBy("node")
        .agg(F.sum("n").alias("n"), F.coalesce(F.max(named), F.lit(0)).alias("majority"))
        .withColumn("precision", F.col("majority") / F.col("n"))
    )


def precision(counts: DataFrame) -> DataFrame:
    """Mean over all nodes (macro) and over all documents of all nodes (micro), the root included."""
    return node_precision(counts).agg(
        F.avg("precision").alias("precision_macro"),
        F.try_divide(F.sum("majority"), F.sum("n")).alias("precision_micro"),
    )


def majority_classes(counts: DataFrame) -> DataFrame:
    """The largest class of each node, all of them on a tie."""
    top = F.max("n").over(Window.partitionBy("node"))
    return counts.filter(F.col("class").isNotNull()).withColumn("top", top).filter("n = top").drop("top")


def class_recall(counts: DataFrame, totals: DataFrame, root) -> DataFrame:
    """(class, n, recall): the most documents of a class in one node below the root where it is a majority."""
    best = majority_classes(counts.filter(F.col("node") != root)).groupBy("class").agg(F.max("n").alias("best"))
    return (
        totals.filter(F.col("class").isNotNull())
        .join(best, "class", "left")
        .select("class", "n", (F.coalesce("best", F.lit(0)) / F.col("n")).alias("recall"))
    )


def recall(counts: DataFrame, totals: DataFrame, root) -> DataFrame:
    weighted = F.sum(F.col("recall") * F.col("n"))
    return class_recall(counts, totals, root).agg(
        F.avg("recall").alias("recall_macro"), F.try_divide(weighted, F.sum("n")).alias("recall_micro")
    )


def harmonic_mean(a, b):
    return F.coalesce(F.try_divide(2 * a * b, a + b), F.lit(0.0))


def class_f(counts: DataFrame, totals: DataFrame, closure: DataFrame) -> DataFrame:
    """(class, n_class, best_f): the best F-score any node reaches for a class and its descendants.

    closure(ui, descendant_ui). With k documents of the class's subtree in a node of n(v) documents and N_D in
    all, F is 2k / (n(v) + N_D). A class outside the hierarchy does not appear.
    """
    occurring = totals.filter(F.col("class").isNotNull()).select(F.col("class").alias("ui"))
    wanted = closure.join(occurring, "ui", "left_semi").withColumnRenamed("descendant_ui", "class")
    sizes = counts.groupBy("node").agg(F.sum("n").alias("n_node"))
    inside = counts.join(wanted, "class").groupBy("ui", "node").agg(F.sum("n").alias("k"))
    whole = totals.join(wanted, "class").groupBy("ui").agg(F.sum("n").alias("n_class"))
    scored = inside.join(sizes, "node").join(whole, "ui").select(
        "ui", (2 * F.col("k") / (F.col("n_node") + F.col("n_class"))).alias("f")
    )
    best = scored.groupBy("ui").agg(F.max("f").alias("best_f"))
    return whole.join(best, "ui", "left").select(
        F.col("ui").alias("class"), "n_class", F.coalesce("best_f", F.lit(0.0)).alias("best_f")
    )


def hierarchical_f(counts: DataFrame, totals: DataFrame, closure: DataFrame) -> DataFrame:
    """One row with f: the sum over classes of N_D / N times the best F-score. It can exceed 1."""
    n_all = totals.agg(F.sum("n")).scalar()
    return class_f(counts, totals, closure).agg(
        F.coalesce(F.sum(F.col("n_class") * F.col("best_f")) / n_all, F.lit(0.0)).alias("f")
    )


def flat_closure(totals: DataFrame) -> DataFrame:
    """The closure of a hierarchy without levels: every class is only itself."""
    named = totals.filter(F.col("class").isNotNull())
    return named.select(F.col("class").alias("ui"), F.col("class").alias("descendant_ui"))


def plain_f(counts: DataFrame, totals: DataFrame) -> DataFrame:
    return hierarchical_f(counts, totals, flat_closure(totals))


def tree_hierarchical_f(
    counts: DataFrame, totals: DataFrame, closure: DataFrame, root, leaves: DataFrame | None = None
) -> DataFrame:
    """The hierarchical F-score over all nodes below the root, or over the leaves only when they are given."""
    scored = counts.filter(F.col("node") != root)
    if leaves is not None:
        scored = counts.join(leaves.select("node"), "node", "left_semi")
    return hierarchical_f(scored, totals, closure)


def tree_report(
    counts: DataFrame, totals: DataFrame, closure: DataFrame, root, leaves: DataFrame | None = None
) -> DataFrame:
    """One row with precision, recall and F1, macro and micro, and the hierarchical F-score."""
    counts, totals = cut(counts), cut(totals)
    recalls = recall(counts, totals, root).select(F.struct("recall_macro", "recall_micro")).scalar()
    score = tree_hierarchical_f(counts, totals, closure, root, leaves).scalar()
    row = precision(counts).select("precision_macro", "precision_micro", recalls.alias("r"), score.alias("hierarchical_f"))
    return row.select(
        "precision_macro",
        "precision_micro",
        F.col("r.recall_macro").alias("recall_macro"),
        F.col("r.recall_micro").alias("recall_micro"),
        harmonic_mean(F.col("precision_macro"), F.col("r.recall_macro")).alias("f1_macro"),
        harmonic_mean(F.col("precision_micro"), F.col("r.recall_micro")).alias("f1_micro"),
        "hierarchical_f",
    )


def adjusted_rand_index(counts: DataFrame) -> DataFrame:
    """One row with ari; a null class is a group of its own."""

    def pairs(n):
        n = n.cast("double")
        return n * (n - 1) / 2

    by_node = counts.groupBy("node").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n")))).scalar()
    by_class = counts.groupBy("class").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n")))).scalar()
    sums = counts.agg(F.sum(pairs(F.col("n"))).alias("both"), F.sum("n").alias("n")).select(
        "both", by_node.alias("rows"), by_class.alias("cols"), pairs(F.col("n")).alias("all_pairs")
    )
    expected = F.coalesce(F.try_divide(F.col("rows") * F.col("cols"), F.col("all_pairs")), F.lit(0.0))
    highest = (F.col("rows") + F.col("cols")) / 2
    return sums.select(
        F.coalesce(F.try_divide(F.col("both") - expected, highest - expected), F.lit(1.0)).alias("ari")
    )


def internal_similarity(
    documents: DataFrame, cluster: str, vec: str, dimensions: int, leaves: DataFrame, below: DataFrame
) -> DataFrame:
    """(node, n, similarity): the mean cosine over all pairs of documents at or below a node.

    It equals the squared length of the mean unit vector. Sums are formed per cluster, then per node.
    """
    units = unit_vectors(documents.select(F.col(cluster).alias("cluster_id"), F.col(vec).alias("vec")), "vec")
    by_cluster = sum_vectors(units, ["cluster_id"], "vec", dimensions, F.count(F.lit(1)).alias("n"))
    placed = by_cluster.join(leaves.withColumnRenamed("node", "leaf"), "cluster_id").join(below, "leaf")
    by_node = sum_vectors(placed, ["node"], "vec", dimensions, F.sum("n").alias("n"))
    length = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x * x)
    return by_node.select("node", "n", (length / (F.col("n") * F.col("n"))).alias("similarity"))


def best_cluster_per_class(counts: DataFrame) -> DataFrame:
    """(class, node, n): the node with most documents of a class; the smallest node on a tie."""
    return counts.filter(F.col("class").isNotNull()).groupBy("class").agg(
        F.max_by("node", F.struct("n", -F.col("node"))).alias("node"), F.max("n").alias("n")
    )


def confusion(predictions: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row with tp, fp, fn and tn for 0/1 columns."""
    is_true, is_called = F.col(actual) == 1, F.col(predicted) == 1
    return predictions.agg(
        F.count_if(is_true & is_called).alias("tp"),
        F.count_if(~is_true & is_called).alias("fp"),
        F.count_if(is_true & ~is_called).alias("fn"),
        F.count_if(~is_true & ~is_called).alias("tn"),
    )


def binary_scores(counts: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall and f1 to confusion counts; 0 where nothing was found."""
    tp, fp, fn, tn = (F.col(name) for name in ("tp", "fp", "fn", "tn"))

    def share(part, whole):
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    return counts.select(
        "*",
        share(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )

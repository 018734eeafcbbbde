"""Scores of a cut merge tree, an external tree and a flat clustering against a class hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame

from grovemark.operators import flat, metrics, tree
from grovemark.session import cut


def score_merge_tree(
    documents: DataFrame,
    cluster: str,
    label: str,
    merges: DataFrame,
    n_leaves: int,
    n_clusters: int,
    closure: DataFrame,
    leaves_only: bool = False,
) -> DataFrame:
    """One row of scores; cluster names a document's cluster by its smallest leaf."""
    edges = cut(tree.cut_edges(merges, n_leaves, n_clusters))
    leaves = tree.cut_leaves(merges, n_leaves, n_clusters)
    below = tree.under(edges, tree.tree_closure(edges))
    counted = cut(tree.contingency(documents, cluster, label))
    counts, totals = tree.counts_below(counted, leaves, below), metrics.totals_of_counts(counted)
    root = 2 * n_leaves - 2
    return metrics.tree_report(counts, totals, closure, root, leaves if leaves_only else None)


def score_external_tree(
    phrases: DataFrame,
    nodes: DataFrame,
    documents: DataFrame,
    document_key: str,
    label: str,
    closure: DataFrame,
    max_leaves: int = 32,
    root: int = 1,
    leaves_only: bool = False,
) -> DataFrame:
    """One row of scores of the tree an external clusterer made of phrases."""
    edges = cut(tree.grow_external_tree(nodes, flat.seen_classes(phrases), max_leaves, root))
    leaves = tree.leaf_labels(edges)
    below = tree.under(edges, tree.tree_closure(edges))
    placed = flat.assign_to_leaves(phrases, leaves)
    labelled = flat.with_true_class(placed, documents, "id", document_key, label)
    counted = cut(tree.contingency(labelled, "cluster_id", label))
    counts, totals = tree.counts_below(counted, leaves, below), metrics.totals_of_counts(counted)
    return metrics.tree_report(counts, totals, closure, root, leaves if leaves_only else None)


def score_flat_clusters(documents: DataFrame, cluster: str, label: str, closure: DataFrame | None = None) -> DataFrame:
    """One row with f: with a closure descendants count for their class, without one they do not."""
    counts = cut(tree.contingency(documents, cluster, label))
    totals = metrics.totals_of_counts(counts)
    if closure is None:
        return metrics.plain_f(counts, totals)
    return metrics.hierarchical_f(counts, totals, closure)

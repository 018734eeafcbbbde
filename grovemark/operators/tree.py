"""Trees as tables: edges(parent, child, position). Merge trees name leaves 0..n-1 and inner nodes from n on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovemark.session import HOT_ROWS, cut, cut_observed, fits, lookup_join

MAX_BROADCAST_CHILDREN = 50_000  # rows of two numbers and a position


def merge_edges(merges: DataFrame) -> DataFrame:
    """The edges of a merge table (node_id, left, right)."""
    return merges.select(
        F.col("node_id").alias("parent"), F.posexplode(F.array("left", "right")).alias("position", "child")
    ).select("parent", "child", "position")


def cut_edges(merges: DataFrame, n_leaves: int, n_clusters: int) -> DataFrame:
    """The tree above the cut into n_clusters: inner nodes are the last n_clusters-1 merges."""
    if not 2 <= n_clusters <= n_leaves:
        raise ValueError(f"cannot cut a tree of {n_leaves} leaves into {n_clusters}")
    return merge_edges(merges.filter(F.col("node_id") >= 2 * n_leaves - n_clusters))


def cut_leaves(merges: DataFrame, n_leaves: int, n_clusters: int) -> DataFrame:
    """(node, cluster_id) for the leaves of the cut tree; cluster_id is the smallest leaf below."""
    edges = cut_edges(merges, n_leaves, n_clusters)
    lows = merges.select(F.col("node_id").alias("child"), "low")
    return (
        edges.filter(F.col("child") < 2 * n_leaves - n_clusters)
        .join(lows, "child", "left")
        .select(F.col("child").alias("node"), F.coalesce("low", "child").alias("cluster_id"))
    )


def tree_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("parent", "child")).alias("node")).distinct()


def tree_leaves(edges: DataFrame) -> DataFrame:
    """Nodes without children."""
    parents = edges.select(F.col("parent").alias("node")).distinct()
    return edges.select(F.col("child").alias("node")).join(parents, "node", "left_anti")


def count_nodes_and_leaves(edges: DataFrame) -> DataFrame:
    leaves = tree_leaves(edges).agg(F.count(F.lit(1))).scalar()
    return tree_nodes(edges).agg(F.count(F.lit(1)).alias("n_nodes")).select("n_nodes", leaves.alias("n_leaves"))


def tree_closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, distance) for every proper ancestor.

    Each step doubles the distance covered, so a tree of depth h takes log2(h) joins.
    """
    reached = cut(
        edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    )
    reach = 1
    while True:
        edge_of_reach = reached.filter(F.col("distance") == reach)
        onward = reached.select(
            F.col("node").alias("ancestor"), F.col("ancestor").alias("further"), F.col("distance").alias("more")
        )
        farther = cut(
            edge_of_reach.join(onward, "ancestor").select(
                "node", F.col("further").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance")
            )
        )
        if not farther.head(1):
            return reached
        reached = reached.unionByName(farther)
        reach *= 2


def _climb(pointers: DataFrame) -> DataFrame:
    """Follow pointers (node, jump, distance, done) until all are done; the jump of a row that is not done is a node here.

    Each round doubles the distance, one row a node: log2 of the depth rounds, each written as a table.
    """
    while True:
        table, seen = cut_observed(pointers, n=F.count(F.lit(1)), waiting=F.count_if(~F.col("done")))
        if not seen["waiting"]:
            return table
        onward = table.select(F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("distance").alias("more"), F.col("done").alias("ended"))
        still = table.filter("NOT done").drop("done")
        # Many nodes may point at one, as below a node with many children.
        met = lookup_join(still, onward, "jump") if seen["n"] > HOT_ROWS else still.join(onward, "jump")
        moved = met.select("node", F.col("next").alias("jump"), (F.col("distance") + F.col("more")).alias("distance"), F.col("ended").alias("done"))
        pointers = moved.unionByName(table.filter("done"))


def _roots(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")


def depths(edges: DataFrame) -> DataFrame:
    """(node, depth), the root at depth 0."""
    at_root = _roots(edges).select("node", F.col("node").alias("jump"), F.lit(0).alias("distance"), F.lit(True).alias("done"))
    up = edges.select(F.col("child").alias("node"), F.col("parent").alias("jump"), F.lit(1).alias("distance"), F.lit(False).alias("done"))
    return _climb(at_root.unionByName(up)).select("node", F.col("distance").alias("depth"))


def nearest_marked(edges: DataFrame, marked: DataFrame) -> DataFrame:
    """(node, marked): the first of the marked nodes on the way from each node, itself included, to the root, if any."""
    stops = marked.select("node").distinct()
    at_stop = stops.select("node", F.col("node").alias("jump"), F.lit(0).alias("distance"), F.lit(True).alias("done"))
    none = F.lit(None).cast(edges.schema["child"].dataType).alias("jump")
    at_root = _roots(edges).join(stops, "node", "left_anti").select("node", none, F.lit(0).alias("distance"), F.lit(True).alias("done"))
    up = edges.select(F.col("child").alias("node"), F.col("parent").alias("jump"), F.lit(1).alias("distance"), F.lit(False).alias("done"))
    found = _climb(at_stop.unionByName(at_root).unionByName(up.join(stops, "node", "left_anti")))
    return found.filter("jump IS NOT NULL").select("node", F.col("jump").alias("marked"))


def subtree_extremes(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(node, least, most): the extremes of values(node, value) at and below each node that has any.

    What a node knows covers 2^k levels below it after k rounds: its own, and that of the nodes 2^k levels below, which
    they hand up by a pointer of that length. One row a node, and log2 of the depth rounds.
    """
    extremes = (F.min("least").alias("least"), F.max("most").alias("most"))
    known = cut(values.groupBy("node").agg(F.min("value").alias("least"), F.max("value").alias("most")))
    up = cut(edges.select(F.col("child").alias("node"), F.col("parent").alias("jump")))
    while True:
        handed = known.join(up, "node").select(F.col("jump").alias("node"), "least", "most")
        known = cut(known.unionByName(handed).groupBy("node").agg(*extremes))
        onward = up.select(F.col("node").alias("jump"), F.col("jump").alias("next"))
        up, seen = cut_observed(lookup_join(up, onward, "jump").select("node", F.col("next").alias("jump")), n=F.count(F.lit(1)))
        if not seen["n"]:
            return known


def under(edges: DataFrame, closure: DataFrame) -> DataFrame:
    """(node, leaf) for every node and each leaf at or below it."""
    leaves = tree_leaves(edges)
    above = closure.join(leaves, "node", "left_semi").select(F.col("ancestor").alias("node"), F.col("node").alias("leaf"))
    return above.unionByName(leaves.select("node", F.col("node").alias("leaf")))


def collapse_uniform(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Turn the topmost nodes whose leaves all carry one label into leaves; labels(leaf, label)."""
    own = labels.select(F.col("leaf").alias("node"), F.col("label").alias("value"))
    mixed = subtree_extremes(edges, own).filter("least != most").select(F.col("node").alias("parent"))
    return edges.join(mixed, "parent", "left_semi")


def trim_unary_chains(edges: DataFrame) -> DataFrame:
    """Take the children from every node that heads a chain of only children ending in a leaf.

    Pointers lead from nodes with one child to the first node below that has none or several; only such runs are followed.
    """
    only = edges.groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.min("child").alias("jump")).filter("n = 1")
    only = cut(only.select(F.col("parent").alias("node"), "jump"))
    runs_on = only.select(F.col("node").alias("jump"), F.lit(True).alias("on"))
    pointers = only.join(runs_on, "jump", "left").select("node", "jump", F.lit(1).alias("distance"), F.col("on").isNull().alias("done"))
    ends = _climb(pointers).select(F.col("node").alias("parent"), F.col("jump").alias("end"))
    inner = edges.select(F.col("parent").alias("end")).distinct()
    return edges.join(ends.join(inner, "end", "left_anti").select("parent"), "parent", "left_anti")


def present_edges(nodes: DataFrame, seen: DataFrame) -> DataFrame:
    """(parent, child, position, label) of an external tree, for children whose class occurs in the phrases.

    nodes(node_id, children, filter_value); seen(class).
    """
    children = nodes.select(
        F.col("node_id").alias("parent"), F.posexplode("children").alias("position", "child")
    )
    labels = nodes.select(F.col("node_id").alias("child"), F.get("filter_value", F.lit(0)).alias("label"))
    return (
        children.join(labels, "child")
        .join(seen.select(F.col("class").alias("label")).distinct(), "label", "left_semi")
        .select("parent", "child", "position", "label")
    )


def grow_external_tree(nodes: DataFrame, seen: DataFrame, max_leaves: int, root: int = 1) -> DataFrame:
    """Edges (with label) of the external tree, grown level by level from the left until max_leaves is reached.

    A node gives its children as long as the leaves made by all nodes before it are fewer than max_leaves. Only nodes on
    the levels reached are read: while leaves are to be had, a level has fewer than max_leaves nodes, which the driver holds.
    """
    stored = nodes.select("node_id", "children", "filter_value").repartitionByRange("node_id")
    stored = cut(stored.sortWithinPartitions("node_id"))  # so that a level's nodes are found by the files' statistics
    classes = cut(seen.select(F.col("class").alias("label")).distinct())
    frontier, passed, made, levels = [root], {root}, 1, []
    while frontier:
        opened = stored.filter(F.col("node_id").isin(frontier))
        children = opened.select(F.col("node_id").alias("parent"), F.posexplode("children").alias("position", "child"))
        labels = stored.select(F.col("node_id").alias("child"), F.get("filter_value", F.lit(0)).alias("label"))
        few = fits(children, MAX_BROADCAST_CHILDREN)
        level = labels.join(F.broadcast(children) if few else children, "child").join(classes, "label", "left_semi")
        level = cut(level.select("parent", "child", "position", "label"))
        gains = {row["parent"]: row["count"] - 1 for row in level.groupBy("parent").count().collect()}  # a row for each node of a level
        opening = []
        for node in frontier:
            if node in gains and made < max_leaves:
                opening.append(node)
                made += gains[node]
        grown = level.filter(F.col("parent").isin(opening))
        levels.append(grown)
        frontier = []
        if made < max_leaves and opening:  # so the opened nodes have fewer than max_leaves children
            place = {node: k for k, node in enumerate(opening)}
            found = grown.select("parent", "position", "child").collect()
            frontier = [row["child"] for row in sorted(found, key=lambda row: (place[row["parent"]], row["position"]))]
            if passed.intersection(frontier) or len(set(frontier)) < len(frontier):
                raise ValueError("a node has two parents")
            passed.update(frontier)
    return reduce(DataFrame.unionByName, levels)


def leaf_labels(edges: DataFrame) -> DataFrame:
    """(node, cluster_id) of the leaves of a grown external tree."""
    leaves = tree_leaves(edges)
    return edges.select(F.col("child").alias("node"), F.col("label").alias("cluster_id")).join(leaves, "node", "left_semi")


def node_class_counts(documents: DataFrame, cluster: str, label: str, leaves: DataFrame, below: DataFrame) -> DataFrame:
    """(node, class, n): documents of each class at or below each node.

    The documents are counted by cluster and class first, so only that small table meets the tree.
    leaves(node, cluster_id) names the leaf of each cluster, below(node, leaf) is the result of under().
    """
    return counts_below(contingency(documents, cluster, label), leaves, below)


def counts_below(counts: DataFrame, leaves: DataFrame, below: DataFrame) -> DataFrame:
    """node_class_counts from the contingency table of the clusters."""
    counted = counts.withColumnRenamed("node", "cluster_id")
    by_leaf = counted.join(leaves.withColumnRenamed("node", "leaf"), "cluster_id")
    return by_leaf.join(below, "leaf").groupBy("node", "class").agg(F.sum("n").alias("n"))


def contingency(documents: DataFrame, cluster: str, label: str) -> DataFrame:
    """(node, class, n): documents by cluster and class."""
    return documents.groupBy(F.col(cluster).alias("node"), F.col(label).alias("class")).agg(
        F.count(F.lit(1)).alias("n")
    )


def node_report(counts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Nodes at one depth with parent, number of documents and a class counter."""
    at_depth = depths(edges).filter(F.col("depth") == depth)
    parents = edges.select(F.col("child").alias("node"), "parent")
    counters = counts.groupBy("node").agg(
        F.sum("n").alias("n"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(F.col("class").isNotNull(), F.struct("class", "n"))))
        ).alias("classes"),
    )
    return at_depth.join(parents, "node", "left").join(counters, "node", "left")

"""Tree operators and tree scores over a merge tree of the vectors and an external tree of the customers."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovemark.catalog import sqlparts as S
from grovemark.catalog.labels import SQL_CUSTOMERS, SQL_PATHS, class_paths, people
from grovemark.catalog.registry import Entry, registrar, table
from grovemark.functions.text import joined
from grovemark.operators import classes, flat, metrics, sampling, tree
from grovemark.plans.scoring import score_external_tree
from grovemark.session import cut

ENTRIES: dict[str, Entry] = {}
query = registrar(ENTRIES)

MERGE_SQL = f"WITH RECURSIVE {S.MERGE_TREE}"
SCORE_SQL = f"""{MERGE_SQL}, {S.LABEL_CLOSURE}, leaf_nodes AS (SELECT node FROM cut_leaves), {S.SCORES}"""


class MergeTree(NamedTuple):
    """The vectors with leaf, class and cluster_id, and the tree over them cut into K clusters."""

    documents: DataFrame
    n_leaves: int
    merges: DataFrame
    edges: DataFrame
    leaves: DataFrame
    below: DataFrame

    @property
    def root(self) -> int:
        return 2 * self.n_leaves - 2

    def counts(self) -> DataFrame:
        return tree.node_class_counts(self.documents, "cluster_id", "class", self.leaves, self.below)

    def totals(self) -> DataFrame:
        return metrics.class_totals(self.documents, "class")


def merges_of(leaves: DataFrame, n_leaves: int) -> DataFrame:
    """Merge k joins nodes 2k and 2k+1."""
    merged = leaves.filter(F.col("leaf") < n_leaves - 1)
    return merged.select(
        (F.col("leaf") + n_leaves).alias("node_id"), (F.col("leaf") * 2).alias("left"), (F.col("leaf") * 2 + 1).alias("right")
    )


def numbered_vectors(spark, folder):
    vectors = table(spark, folder, "embeddings").select(
        "vec_id", F.col("label").cast("string").alias("class"), "embedding"
    )
    return cut(sampling.dense_ids(vectors, ["vec_id"], "leaf"))


def whole_tree(spark, folder):
    documents = numbered_vectors(spark, folder)
    n_leaves = documents.count()
    return documents, n_leaves, merges_of(documents, n_leaves)


def merge_tree(spark, folder) -> MergeTree:
    documents, n_leaves, merges = whole_tree(spark, folder)
    all_edges = tree.merge_edges(merges)
    own = documents.select(F.col("leaf").alias("node"), F.col("leaf").alias("value"))
    lows = tree.subtree_extremes(all_edges, own).select(F.col("node").alias("node_id"), F.col("least").alias("low"))
    merges = cut(merges.join(lows, "node_id"))
    edges = cut(tree.cut_edges(merges, n_leaves, S.K))
    leaves = cut(tree.cut_leaves(merges, n_leaves, S.K))
    below_cut = tree.nearest_marked(all_edges, leaves).select(F.col("node").alias("leaf"), F.col("marked").alias("node"))
    homes = below_cut.join(leaves, "node").select("leaf", "cluster_id")
    below = cut(tree.under(edges, tree.tree_closure(edges)))
    return MergeTree(cut(documents.join(homes, "leaf")), n_leaves, merges, edges, leaves, below)


def label_closure(spark, folder):
    label = table(spark, folder, "embeddings").select("label").distinct()
    own = F.col("label").cast("string")
    top = F.concat(F.lit("C."), (F.col("label") % 3).cast("string"))
    number = F.when(F.col("label") < 3, F.concat(F.lit("C."), own)).otherwise(F.concat(top, F.lit("."), own))
    return classes.class_closure(label.select(own.alias("ui"), number.alias("mn")))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


@query(
    f"""{MERGE_SQL} SELECT n_docs + leaf AS parent, 2 * leaf + p AS child, p AS position
    FROM base, size, (VALUES (0), (1)) v(p) WHERE leaf < n_docs - 1"""
)
def merge_tree_edges(spark, folder):
    _, _, merges = whole_tree(spark, folder)
    return tree.merge_edges(merges)


CUT_EDGES_SQL = f"""{MERGE_SQL} SELECT n_docs + leaf AS parent, 2 * leaf + p AS child, p AS position
    FROM base, size, (VALUES (0), (1)) v(p) WHERE leaf < n_docs - 1 AND n_docs + leaf >= 2 * n_docs - {S.K}"""


@query(CUT_EDGES_SQL)
def cut_tree_edges(spark, folder):
    _, n_leaves, merges = whole_tree(spark, folder)
    return tree.cut_edges(merges, n_leaves, S.K)


@query(CUT_EDGES_SQL)
def uniform_label_pruning(spark, folder):
    made = merge_tree(spark, folder)
    labels = made.documents.select("leaf", F.col("cluster_id").alias("label"))
    return tree.collapse_uniform(cut(tree.merge_edges(made.merges)), labels)


@query(f"{MERGE_SQL} SELECT node, cluster_id FROM cut_leaves")
def cut_tree_leaves(spark, folder):
    return merge_tree(spark, folder).leaves


@query(
    f"""{MERGE_SQL}, rise(node, ancestor, distance) AS (
      SELECT node, node, 0 FROM (SELECT DISTINCT node FROM up)
      UNION ALL SELECT node, n_docs + ancestor // 2, distance + 1 FROM rise, size WHERE ancestor < 2 * n_docs - 2)
    SELECT node, ancestor, distance FROM rise WHERE distance > 0"""
)
def ancestor_closure(spark, folder):
    _, _, merges = whole_tree(spark, folder)
    return tree.tree_closure(tree.merge_edges(merges))


@query(
    f"""{MERGE_SQL}, rise(node, place, depth) AS (
      SELECT node, node, 0 FROM (SELECT DISTINCT node FROM up)
      UNION ALL SELECT node, n_docs + place // 2, depth + 1 FROM rise, size WHERE place < 2 * n_docs - 2)
    SELECT node, max(depth) AS depth FROM rise GROUP BY node"""
)
def node_depths(spark, folder):
    _, _, merges = whole_tree(spark, folder)
    return tree.depths(cut(tree.merge_edges(merges)))


@query(f"{MERGE_SQL} SELECT leaf AS node FROM base")
def leaf_list(spark, folder):
    _, _, merges = whole_tree(spark, folder)
    return tree.tree_leaves(tree.merge_edges(merges))


@query(f"{MERGE_SQL} SELECT 2 * n_docs - 1 AS n_nodes, n_docs AS n_leaves FROM size")
def node_and_leaf_count(spark, folder):
    _, _, merges = whole_tree(spark, folder)
    return tree.count_nodes_and_leaves(tree.merge_edges(merges))


@query(f"{MERGE_SQL} SELECT node, class, n FROM counts")
def node_class_counts(spark, folder):
    return merge_tree(spark, folder).counts()


@query(
    f"""{MERGE_SQL}, tops AS (SELECT node FROM root),
    second AS (SELECT DISTINCT k.node FROM kept k, size WHERE n_docs + k.node // 2 <> 2 * n_docs - 2
      AND n_docs + (n_docs + k.node // 2) // 2 = 2 * n_docs - 2 AND k.node NOT IN (SELECT node FROM tops))
    SELECT s.node, any_value(n_docs + s.node // 2) AS parent, sum(n) AS n,
      string_agg(class || '=' || n, ';' ORDER BY class) AS classes
    FROM second s JOIN counts USING (node), size GROUP BY s.node"""
)
def node_report(spark, folder):
    made = merge_tree(spark, folder)
    report = tree.node_report(made.counts(), made.edges, 2)
    entries = F.transform(F.map_entries("classes"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return report.select("node", "parent", "n", joined(F.array_sort(entries)).alias("classes"))


@query(f"{SCORE_SQL} SELECT node, n, majority, round(majority / n, 6) AS precision FROM per_node")
def node_precision(spark, folder):
    return rounded(metrics.node_precision(merge_tree(spark, folder).counts()), "precision")


@query(
    f"""{SCORE_SQL} SELECT round({S.PRECISION_MACRO}, 6) AS precision_macro,
    round({S.PRECISION_MICRO}, 6) AS precision_micro"""
)
def precision_macro_micro(spark, folder):
    found = metrics.precision(merge_tree(spark, folder).counts())
    return rounded(found, "precision_macro", "precision_micro")


@query(f"{SCORE_SQL} SELECT node, class, n FROM largest")
def majority_classes(spark, folder):
    return metrics.majority_classes(merge_tree(spark, folder).counts())


@query(f"{SCORE_SQL} SELECT class, n, round(recall, 6) AS recall FROM recalls")
def class_recall(spark, folder):
    made = merge_tree(spark, folder)
    return rounded(metrics.class_recall(made.counts(), made.totals(), made.root), "recall")


@query(f"{SCORE_SQL} SELECT round({S.RECALL_MACRO}, 6) AS recall_macro, round({S.RECALL_MICRO}, 6) AS recall_micro")
def recall_macro_micro(spark, folder):
    made = merge_tree(spark, folder)
    return rounded(metrics.recall(made.counts(), made.totals(), made.root), "recall_macro", "recall_micro")


@query(f"{SCORE_SQL} SELECT round({S.f_score()}, 6) AS f")
def hierarchical_f(spark, folder):
    made = merge_tree(spark, folder)
    closure = label_closure(spark, folder)
    return rounded(metrics.tree_hierarchical_f(made.counts(), made.totals(), closure, made.root), "f")


@query(f"{SCORE_SQL} SELECT round({S.f_score('leaf_found')}, 6) AS f")
def hierarchical_f_of_leaves(spark, folder):
    made = merge_tree(spark, folder)
    closure = label_closure(spark, folder)
    return rounded(metrics.tree_hierarchical_f(made.counts(), made.totals(), closure, made.root, made.leaves), "f")


@query(f"{SCORE_SQL} {S.REPORT}")
def tree_report(spark, folder):
    made = merge_tree(spark, folder)
    report = metrics.tree_report(made.counts(), made.totals(), label_closure(spark, folder), made.root)
    return rounded(report, *report.columns)


@query(
    f"""{MERGE_SQL}, units AS (
      SELECT leaf, list_transform(embedding, lambda x: CAST(x AS DOUBLE)
        / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS unit FROM base),
    cells AS (SELECT leaf, unnest(unit) AS x, generate_subscripts(unit, 1) AS d FROM units),
    means AS (SELECT node, d, avg(x) AS m, count(*) AS n FROM kept JOIN cells USING (leaf) GROUP BY node, d)
    SELECT node, any_value(n) AS n, round(sum(m * m), 6) AS similarity FROM means GROUP BY node"""
)
def internal_similarity(spark, folder):
    made = merge_tree(spark, folder)
    found = metrics.internal_similarity(made.documents, "cluster_id", "embedding", 64, made.leaves, made.below)
    return rounded(found, "similarity")


EXTERNAL_SQL = f"WITH RECURSIVE {S.EXTERNAL_TREE}"


def external_nodes(spark, folder):
    node = table(spark, folder, "customer").select((F.col("c_custkey") + 1).cast("int").alias("node_id"))
    pair = F.array(F.col("node_id") * 2, F.col("node_id") * 2 + 1)
    bounded = node.withColumn("last", node.agg(F.max("node_id")).scalar())
    return bounded.select(
        "node_id", F.filter(pair, lambda c: c <= F.col("last")).alias("children"), F.array("node_id").alias("filter_value")
    )


def external_phrases(spark, folder):
    node = (F.col("o_custkey") + 1).cast("int")
    way = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda j: F.call_function("shiftright", node, j))
    keys = F.filter(way, lambda k: (k > 0) & (k % 5 != 4))
    inner = F.create_map(F.lit(0), F.lit(1.0))
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        "o_custkey",
        F.map_from_arrays(keys, F.transform(keys, lambda k: inner)).alias("index"),
    )


def external_tree(spark, folder):
    phrases = external_phrases(spark, folder)
    nodes = cut(external_nodes(spark, folder))
    return phrases, tree.grow_external_tree(nodes, flat.seen_classes(phrases), S.BUDGET)


@query(f"{EXTERNAL_SQL} SELECT parent, child FROM grown")
def grown_external_tree(spark, folder):
    return external_tree(spark, folder)[1].select("parent", "child")


@query(
    f"""{EXTERNAL_SQL}, degree AS (SELECT parent, count(*) AS n FROM edges GROUP BY parent),
    forks(node) AS (SELECT parent FROM degree WHERE n > 1 UNION SELECT parent FROM edges JOIN forks ON child = node)
    SELECT parent, child FROM edges WHERE parent IN (SELECT node FROM forks)"""
)
def unary_chain_trim(spark, folder):
    phrases = external_phrases(spark, folder)
    edges = cut(tree.present_edges(external_nodes(spark, folder), flat.seen_classes(phrases)))
    return tree.trim_unary_chains(edges).select("parent", "child")


@query(f"{EXTERNAL_SQL} SELECT o_orderkey, cluster_id FROM orders LEFT JOIN placed USING (o_orderkey)")
def cluster_assignment(spark, folder):
    phrases, edges = external_tree(spark, folder)
    placed = flat.assign_to_leaves(phrases, tree.leaf_labels(cut(edges)))
    return placed.select(F.col("id").cast("long").alias("o_orderkey"), "cluster_id")


@query(f"{EXTERNAL_SQL} SELECT count(DISTINCT cluster_id) AS n_clusters FROM placed")
def distinct_clusters(spark, folder):
    phrases, edges = external_tree(spark, folder)
    placed = flat.assign_to_leaves(phrases, tree.leaf_labels(cut(edges)))
    return placed.agg(F.countDistinct("cluster_id").alias("n_clusters"))


@query(
    f"""{EXTERNAL_SQL} SELECT o_orderkey, string_agg(k, ';' ORDER BY k) AS labels
    FROM keys JOIN grown_leaves ON k = node GROUP BY o_orderkey"""
)
def keys_among_leaf_labels(spark, folder):
    phrases, edges = external_tree(spark, folder)
    found = phrases.select(
        F.col("id").cast("long").alias("o_orderkey"),
        flat.keys_among(F.col("index"), tree.leaf_labels(cut(edges))).alias("labels"),
    ).withColumn("labels", F.array_sort("labels"))
    return found.filter(F.size("labels") > 0).select("o_orderkey", joined(F.col("labels").cast("array<string>")).alias("labels"))


@query(
    f"""{EXTERNAL_SQL}, {SQL_PATHS}, {SQL_CUSTOMERS},
    docs AS (SELECT class, cluster_id FROM orders LEFT JOIN placed USING (o_orderkey)
      JOIN people ON o_custkey = c_custkey),
    rise(leaf, node) AS (SELECT node, node FROM grown_leaves
      UNION ALL SELECT leaf, parent FROM rise JOIN grown ON child = node),
    counts AS (SELECT node, class, count(*) AS n FROM docs JOIN rise ON cluster_id = leaf GROUP BY node, class),
    totals AS (SELECT class, count(*) AS n FROM docs GROUP BY class),
    root AS (SELECT 1 AS node), leaf_nodes AS (SELECT node FROM grown_leaves), {S.SCORES} {S.REPORT}"""
)
def external_tree_report(spark, folder):
    phrases = external_phrases(spark, folder).drop("o_custkey")
    owners = people(spark, folder).select(F.col("c_custkey").alias("o_custkey"), "class")
    documents = table(spark, folder, "orders").select("o_orderkey", "o_custkey").join(owners, "o_custkey")
    report = score_external_tree(
        phrases,
        cut(external_nodes(spark, folder)),
        documents,
        "o_orderkey",
        "class",
        classes.class_closure(class_paths(spark, folder)),
        S.BUDGET,
    )
    return rounded(report, *report.columns)

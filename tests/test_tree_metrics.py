import math

import pytest
from pyspark.sql import functions as F

from grovemark.operators import flat, metrics, tree
from grovemark.plans.scoring import score_flat_clusters, score_merge_tree

# Six documents, five merges; the cut into four clusters keeps inner nodes from 8 on.
MERGES = [(6, 1, 3, 1), (7, 2, 6, 1), (8, 0, 4, 0), (9, 5, 7, 1), (10, 8, 9, 0)]
CLASSES = ["D016640", "D003924", "D003924", "D003923", "D016640", "D003922"]
CLUSTERS = [0, 1, 1, 1, 4, 5]
CLOSURE = [(c, c) for c in ("D016640", "D003924", "D003923", "D003922", "D014929")] + [
    ("D003924", "D003923"),
    ("D003922", "D014929"),
]


@pytest.fixture(scope="module")
def toy(spark):
    merges = spark.createDataFrame(MERGES, "node_id long, left long, right long, low long")
    docs = spark.createDataFrame(list(zip(range(6), CLUSTERS, CLASSES)), "id long, cluster_id long, class string")
    closure = spark.createDataFrame(CLOSURE, "ui string, descendant_ui string")
    return merges, docs, closure


def test_cut_and_counts(toy):
    merges, docs, _ = toy
    edges = tree.cut_edges(merges, 6, 4)
    leaves = tree.cut_leaves(merges, 6, 4)
    assert {(r.node, r.cluster_id) for r in leaves.collect()} == {(0, 0), (4, 4), (5, 5), (7, 1)}
    assert tuple(tree.count_nodes_and_leaves(edges).head()) == (7, 4)
    below = tree.under(edges, tree.tree_closure(edges))
    counts = tree.node_class_counts(docs, "cluster_id", "class", leaves, below)
    got = {r.node: (r.n, r.majority) for r in metrics.node_precision(counts).collect()}
    assert got == {0: (1, 1), 4: (1, 1), 5: (1, 1), 7: (3, 2), 8: (2, 2), 9: (4, 2), 10: (6, 2)}
    by_class = {r["class"]: r.recall for r in metrics.class_recall(counts, metrics.class_totals(docs, "class"), 10).collect()}
    assert by_class["D003923"] == 0
    report = {r.node: (r.parent, r.n, r.classes) for r in tree.node_report(counts, edges, 1).collect()}
    assert report[9] == (10, 4, {"D003922": 1, "D003923": 1, "D003924": 2})


def test_golden_report(toy):
    merges, docs, closure = toy
    report = score_merge_tree(docs, "cluster_id", "class", merges, 6, 4, closure).head().asDict()
    want = dict(precision_macro=0.785714, precision_micro=0.611111, recall_macro=0.75, recall_micro=0.833333,
                f1_macro=0.767442, f1_micro=0.705128, hierarchical_f=1.083333)
    assert {k: round(v, 6) for k, v in report.items()} == want
    leaves = score_merge_tree(docs, "cluster_id", "class", merges, 6, 4, closure, leaves_only=True).head()
    assert round(leaves.hierarchical_f, 6) == 0.972222


def test_scores_do_not_depend_on_row_order(spark, toy):
    merges, docs, closure = toy
    first = score_merge_tree(docs, "cluster_id", "class", merges, 6, 4, closure).head()
    second = score_merge_tree(docs.repartition(5).orderBy(F.rand(1)), "cluster_id", "class", merges, 6, 4, closure).head()
    assert first == second


def test_both_prunings_agree(toy):
    merges, docs, _ = toy
    labels = docs.select(F.col("id").alias("leaf"), F.col("cluster_id").alias("label"))
    a = tree.collapse_uniform(tree.merge_edges(merges), labels).collect()
    b = tree.cut_edges(merges, 6, 4).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_flat_hierarchy_equals_plain_f_and_null_class_counts_as_document(spark):
    rows = [(0, "a"), (0, "a"), (0, "b"), (1, "b"), (1, None)]
    docs = spark.createDataFrame(rows, "c long, class string")
    own = spark.createDataFrame([("a", "a"), ("b", "b")], "ui string, descendant_ui string")
    plain = score_flat_clusters(docs, "c", "class").head()[0]
    assert plain == score_flat_clusters(docs, "c", "class", own).head()[0]
    assert math.isclose(plain, 2 / 5 * (4 / 5) + 2 / 5 * (2 / 4))


def test_class_outside_the_hierarchy_adds_nothing(spark):
    docs = spark.createDataFrame([(0, "a"), (0, "zz")], "c long, class string")
    own = spark.createDataFrame([("a", "a")], "ui string, descendant_ui string")
    assert math.isclose(score_flat_clusters(docs, "c", "class", own).head()[0], 0.5 * (2 / 3))


def test_deep_chain_closure(spark):
    depth = 70
    edges = spark.createDataFrame([(i, i + 1, 0) for i in range(depth)], "parent long, child long, position int")
    closure = tree.tree_closure(edges)
    assert closure.count() == depth * (depth + 1) // 2
    assert closure.filter("distance != node - ancestor").count() == 0


CHAIN = 20_000


@pytest.fixture(scope="module")
def chain(spark):
    """A chain of inner nodes 0, 2, 4, ..., each with a leaf to its left; the last has two leaves."""
    inner = spark.range(CHAIN).select((F.col("id") * 2).alias("parent"), (F.col("id") * 2 + 1).alias("a"), (F.col("id") * 2 + 2).alias("b"))
    return inner.select("parent", F.posexplode(F.array("a", "b")).alias("position", "child")).select("parent", "child", "position")


def test_long_chain_depths(chain):
    found = tree.depths(chain)
    assert found.count() == 2 * CHAIN + 1
    assert found.filter("depth <> (node + 1) div 2").count() == 0


def test_long_chain_pruning(chain):
    leaves = tree.tree_leaves(chain)
    labels = leaves.select(F.col("node").alias("leaf"), (F.col("node") > 30_000).cast("int").alias("label"))
    kept = tree.collapse_uniform(chain, labels)
    assert kept.count() == 2 * 15_000 and kept.agg(F.max("parent")).head()[0] == 29_998


def test_long_chain_nearest_marked(chain, spark):
    marked = spark.createDataFrame([(10_000,), (30_001,)], "node long")
    found = tree.nearest_marked(chain, marked)
    assert found.filter("marked = 30001").collect() == [(30_001, 30_001)]
    assert found.filter("marked = 10000").count() == 2 * (CHAIN - 5_000)


def test_long_unary_chains(spark):
    down = spark.range(1, CHAIN).select(F.col("id").alias("parent"), (F.col("id") + 1).alias("child"), F.lit(0).alias("position"))
    fork = spark.createDataFrame([(0, 1, 0), (0, -1, 1), (-1, -2, 0), (-2, -3, 0), (-2, -4, 1)], "parent long, child long, position int")
    got = tree.trim_unary_chains(down.unionByName(fork)).collect()
    assert sorted((r.parent, r.child) for r in got) == [(-2, -4), (-2, -3), (-1, -2), (0, -1), (0, 1)]


def test_wide_tree(spark, monkeypatch):
    monkeypatch.setattr(tree, "HOT_ROWS", 10)
    edges = spark.range(1, 500).select((F.col("id") % 3).alias("parent"), (F.col("id") + 2).alias("child"), F.lit(0).alias("position"))
    edges = edges.filter("parent <> 2").unionByName(spark.createDataFrame([(0, 1, 0)], "parent long, child long, position int"))
    found = {r.node: r.depth for r in tree.depths(edges).collect()}
    assert found[0] == 0 and found[1] == 1 and set(found.values()) == {0, 1, 2}


def test_two_parents_are_refused(spark):
    seen = spark.createDataFrame([(c,) for c in range(8)], "class int")
    with pytest.raises(ValueError):
        tree.grow_external_tree(nodes(spark, {1: [2, 3], 2: [3]}), seen, 32)
    with pytest.raises(ValueError):
        tree.grow_external_tree(nodes(spark, {1: [2], 2: [1]}), seen, 32)


def test_root_without_children(spark):
    seen = spark.createDataFrame([(1,)], "class int")
    assert tree.grow_external_tree(nodes(spark, {1: [2, 3]}), seen, 32).count() == 0


def nodes(spark, children):
    rows = [(i, children.get(i, []), [i]) for i in range(8)]
    return spark.createDataFrame(rows, "node_id int, children array<int>, filter_value array<int>")


@pytest.mark.parametrize(
    "absent, budget, want",
    [((), 3, {4, 5, 3}), ((5,), 3, {4, 6, 7}), ((), 32, {4, 5, 6, 7}), ((2,), 32, {6, 7})],
)
def test_leaf_budget(spark, absent, budget, want):
    seen = spark.createDataFrame([(c,) for c in range(8) if c not in absent], "class int")
    edges = tree.grow_external_tree(nodes(spark, {1: [2, 3], 2: [4, 5], 3: [6, 7]}), seen, budget)
    assert {r.node for r in tree.tree_leaves(edges).collect()} == want


def test_unary_chains(spark):
    rows = [(1, 2, 0), (1, 3, 1), (2, 4, 0), (4, 5, 0), (3, 6, 0), (6, 7, 0), (6, 8, 1)]
    edges = spark.createDataFrame(rows, "parent long, child long, position int")
    got = {(r.parent, r.child) for r in tree.trim_unary_chains(edges).collect()}
    assert got == {(1, 2), (1, 3), (3, 6), (6, 7), (6, 8)}


def test_assignment_to_leaves(spark):
    schema = "id string, index map<int, map<int, double>>"
    phrases = spark.createDataFrame([("1", {1: {}, 7: {}}), ("2", {3: {}}), ("3", {9: {}, 7: {}})], schema)
    leaves = spark.createDataFrame([(1, 7), (2, 9)], "node int, cluster_id int")
    got = {r.id: r.cluster_id for r in flat.assign_to_leaves(phrases, leaves).collect()}
    assert got == {"1": 7, "2": None, "3": 7}
    assert {r["class"] for r in flat.seen_classes(phrases).collect()} == {1, 3, 7, 9}


def test_repeated_documents_repeat_phrases(spark):
    phrases = spark.createDataFrame([("1",), ("2",)], "id string")
    docs = spark.createDataFrame([(1, "a"), (1, "b")], "PMID long, class string")
    got = flat.with_true_class(phrases, docs, "id", "PMID", "class").collect()
    assert sorted((r.id, r["class"]) for r in got if r["class"]) == [("1", "a"), ("1", "b")] and len(got) == 3


def test_rand_index(spark):
    def ari(rows):
        counts = tree.contingency(spark.createDataFrame(rows, "c long, class string"), "c", "class")
        return metrics.adjusted_rand_index(counts).head()[0]

    assert ari([(0, "a"), (0, "a"), (1, "b"), (1, "b")]) == 1.0
    assert ari([(0, "a"), (0, "a")]) == 1.0
    assert math.isclose(ari([(0, "a"), (0, "a"), (0, None), (1, None), (1, "b"), (1, "b")]), 0.24242424242424243)


def test_internal_similarity_is_the_mean_pairwise_cosine(spark):
    vectors = [[1.0, 0.0], [1.0, 1.0], [0.0, 2.0]]
    docs = spark.createDataFrame([(0, v) for v in vectors], "cluster_id long, vec array<double>")
    leaves = spark.createDataFrame([(5, 0)], "node long, cluster_id long")
    below = spark.createDataFrame([(5, 5)], "node long, leaf long")
    got = metrics.internal_similarity(docs, "cluster_id", "vec", 2, leaves, below).head()
    cosines = [[1, 0.5**0.5, 0], [0.5**0.5, 1, 0.5**0.5], [0, 0.5**0.5, 1]]
    assert got.n == 3 and math.isclose(got.similarity, sum(map(sum, cosines)) / 9)


def test_binary_scores_without_hits(spark):
    df = spark.createDataFrame([(1, 0), (0, 1), (0, 0)], "y int, p int")
    row = metrics.binary_scores(metrics.confusion(df, "y", "p")).head()
    assert (row.tp, row.fp, row.fn, row.tn) == (0, 1, 1, 1)
    assert (row.precision, row.recall, row.f1) == (0, 0, 0) and math.isclose(row.accuracy, 1 / 3)

"""Flat clusterings, average linkage, nearest partners and classifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovemark.catalog import sqlparts as S
from grovemark.catalog.labels import SQL_CUSTOMERS, SQL_PATHS, class_paths, people
from grovemark.catalog.registry import Entry, registrar, table
from grovemark.catalog.texts import DIMENSIONS, word_vectors
from grovemark.catalog.trees import label_closure, rounded
from grovemark.operators import classes, flat, linkage, metrics, sampling, scope, tree
from grovemark.plans.corpus import discover_stop_words
from grovemark.plans.scoring import score_flat_clusters, score_merge_tree
from grovemark.session import cut

ENTRIES: dict[str, Entry] = {}
query = registrar(ENTRIES)

BLOCK_ROWS = 256  # small, so that the test tables need several blocks
LAST_ROWS = 1_024

# Orders as documents: the class of the customer, clustered by priority.
SQL_ORDERS = f"""WITH {SQL_PATHS}, {SQL_CUSTOMERS},
docs AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INT) AS cluster, class
  FROM orders JOIN people ON o_custkey = c_custkey),
counts AS (SELECT cluster AS node, class, count(*) AS n FROM docs GROUP BY cluster, class),
totals AS (SELECT class, count(*) AS n FROM docs GROUP BY class),
sizes AS (SELECT node, sum(n) AS n FROM counts GROUP BY node)"""


def order_documents(spark, folder):
    owners = people(spark, folder).select(F.col("c_custkey").alias("o_custkey"), "class")
    orders = table(spark, folder, "orders").select(
        "o_custkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("cluster")
    )
    return orders.join(owners, "o_custkey").select("cluster", "class")


def order_counts(spark, folder):
    return tree.contingency(order_documents(spark, folder), "cluster", "class")


def f_sql(closure: str) -> str:
    return f"""{SQL_ORDERS}, wanted AS ({closure}),
    whole AS (SELECT ui, sum(n) AS n_class FROM totals JOIN wanted ON class = descendant_ui GROUP BY ui),
    found AS (SELECT ui, node, sum(n) AS k FROM counts JOIN wanted ON class = descendant_ui GROUP BY ui, node),
    best AS (SELECT ui, any_value(n_class) AS n_class, max(2 * k / (s.n + n_class)) AS best_f
      FROM found JOIN whole USING (ui) JOIN sizes s USING (node) GROUP BY ui)
    SELECT round(sum(n_class * best_f) / (SELECT sum(n) FROM totals), 6) AS f FROM best"""


@query(f"{SQL_ORDERS} SELECT node, class, n FROM counts")
def contingency(spark, folder):
    return order_counts(spark, folder)


@query("SELECT CAST(substr(o_orderpriority, 1, 1) AS INT) AS class, count(*) AS n FROM orders GROUP BY 1")
def cluster_sizes(spark, folder):
    orders = table(spark, folder, "orders").select(F.substring("o_orderpriority", 1, 1).cast("int").alias("cluster"))
    return classes.class_frequency(orders, "cluster")


@query(f_sql("SELECT ui, descendant_ui FROM closure WHERE ui IN (SELECT class FROM totals)"))
def flat_hierarchical_f(spark, folder):
    closure = classes.class_closure(class_paths(spark, folder))
    return rounded(score_flat_clusters(order_documents(spark, folder), "cluster", "class", closure), "f")


@query(f_sql("SELECT class AS ui, class AS descendant_ui FROM totals"))
def flat_plain_f(spark, folder):
    return rounded(score_flat_clusters(order_documents(spark, folder), "cluster", "class"), "f")


@query(
    f"""{SQL_ORDERS}, sums AS (
      SELECT (SELECT sum(n * (n - 1.0) / 2) FROM counts) AS cells, (SELECT sum(n * (n - 1.0) / 2) FROM sizes) AS rows_,
        (SELECT sum(n * (n - 1.0) / 2) FROM totals) AS cols, (SELECT count(*) * (count(*) - 1.0) / 2 FROM docs) AS pairs)
    SELECT round((cells - rows_ * cols / pairs) / ((rows_ + cols) / 2 - rows_ * cols / pairs), 6) AS ari FROM sums"""
)
def adjusted_rand_index(spark, folder):
    return rounded(metrics.adjusted_rand_index(order_counts(spark, folder)), "ari")


@query(
    f"""{SQL_ORDERS} SELECT class, node, n FROM (
      SELECT *, row_number() OVER (PARTITION BY class ORDER BY n DESC, node) AS place FROM counts) WHERE place = 1"""
)
def best_cluster_per_class(spark, folder):
    return metrics.best_cluster_per_class(order_counts(spark, folder)).select("class", "node", "n")


SQL_CONFUSION = """WITH c AS (SELECT
  count(*) FILTER (quality = 1 AND n_chars > 1000) AS tp, count(*) FILTER (quality = 0 AND n_chars > 1000) AS fp,
  count(*) FILTER (quality = 1 AND n_chars <= 1000) AS fn, count(*) FILTER (quality = 0 AND n_chars <= 1000) AS tn
  FROM labels JOIN documents USING (doc_id))"""


def judged(spark, folder):
    called = (F.col("n_chars") > 1000).cast("int")
    joined = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    return metrics.confusion(joined.select("quality", called.alias("called")), "quality", "called")


@query(f"{SQL_CONFUSION} SELECT tp, fp, fn, tn FROM c")
def confusion_counts(spark, folder):
    return judged(spark, folder)


@query(
    f"""{SQL_CONFUSION} SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
    round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
    round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c"""
)
def binary_scores(spark, folder):
    return rounded(metrics.binary_scores(judged(spark, folder)), "accuracy", "precision", "recall", "f1")


@query(
    """WITH wide AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
    SELECT a.vec_id, round(min(1 - list_cosine_similarity(a.v, b.v)), 6) AS distance
    FROM wide a JOIN wide b ON a.vec_id <> b.vec_id GROUP BY a.vec_id"""
)
def nearest_distance(spark, folder):
    found = linkage.nearest_partners(table(spark, folder, "embeddings"), "vec_id", "embedding", BLOCK_ROWS)
    return rounded(found, "distance")


def linked(spark, folder):
    return linkage.average_linkage(table(spark, folder, "embeddings"), "vec_id", "embedding", BLOCK_ROWS, LAST_ROWS)


# Average linkage one merge at a time over the table of all pairs: a state holds the sum and number of distances of each
# pair of clusters, a cluster being named by its smallest leaf. Every leaf but the first is taken in (y) exactly once.
SQL_LINKAGE = """WITH RECURSIVE wide AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS leaf,
  list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
steps AS (
  SELECT 0 AS step, a.leaf AS a, b.leaf AS b, 1 - list_cosine_similarity(a.v, b.v) AS total, 1.0::DOUBLE AS weight
  FROM wide a JOIN wide b ON a.leaf < b.leaf
  UNION ALL
  SELECT step + 1, least(p, q), greatest(p, q), sum(total), sum(weight) FROM (
    SELECT step, total, weight, CASE WHEN a = y THEN x ELSE a END AS p, CASE WHEN b = y THEN x ELSE b END AS q
    FROM steps, (SELECT arg_min(a, (total / weight, a, b)) AS x, arg_min(b, (total / weight, a, b)) AS y FROM steps))
  WHERE p <> q GROUP BY ALL),
merges AS MATERIALIZED (SELECT step, min(total / weight) AS height, arg_min(a, (total / weight, a, b)) AS x,
  arg_min(b, (total / weight, a, b)) AS y FROM steps GROUP BY step)"""


# The merges with their names: a leaf is below the merges of those it was taken in by (rep), from that step on.
SQL_MERGES = f"""{SQL_LINKAGE},
walk AS (SELECT leaf, leaf AS rep, -1 AS since FROM wide
  UNION ALL SELECT w.leaf, m.x, m.step FROM walk w JOIN merges m ON w.rep = m.y),
sizes AS (SELECT step, count(*) AS size FROM merges JOIN walk ON rep = x AND since <= step GROUP BY step),
named AS MATERIALIZED (SELECT m.*, size, (SELECT count(*) FROM wide) + row_number() OVER (ORDER BY height, size, x) - 1 AS node_id
  FROM merges m JOIN sizes USING (step)),
tree AS MATERIALIZED (SELECT a.*, coalesce(lag(a.node_id) OVER (PARTITION BY a.x ORDER BY a.step), a.x) AS left_id, coalesce(last, a.y) AS right_id
  FROM named a LEFT JOIN (SELECT x, arg_max(node_id, step) AS last FROM named GROUP BY x) r ON r.x = a.y)"""


@query(f"{SQL_MERGES} SELECT node_id, left_id AS left, right_id AS right, round(height, 6) AS height, size FROM tree")
def average_linkage(spark, folder):
    return linked(spark, folder).merges.select("node_id", "left", "right", F.round("height", 6).alias("height"), "size")


@query(f"{SQL_LINKAGE} SELECT step, round(height, 6) AS height FROM merges")
def average_linkage_heights(spark, folder):
    made = linked(spark, folder)
    return made.merges.select((F.col("node_id") - made.n_leaves).alias("step"), F.round("height", 6).alias("height"))


@query(
    f"""{SQL_LINKAGE}, early AS MATERIALIZED (SELECT x, y FROM merges WHERE step < (SELECT count(*) FROM wide) - 10),
    walk AS (SELECT vec_id, leaf AS now FROM wide
      UNION ALL SELECT vec_id, x FROM walk JOIN early ON now = y)
    SELECT vec_id, min(now) AS cluster_id FROM walk GROUP BY vec_id"""
)
def average_linkage_labels(spark, folder):
    return linkage.cut_labels(linked(spark, folder), 10).select("vec_id", "cluster_id")


SCORED_CLUSTERS = 20


@query(
    f"""{SQL_MERGES}, {S.LABEL_CLOSURE},
    kept AS (SELECT * FROM tree WHERE node_id >= 2 * (SELECT count(*) FROM wide) - {SCORED_CLUSTERS}),
    ends AS (SELECT left_id AS node FROM kept UNION ALL SELECT right_id FROM kept),
    root AS (SELECT max(node_id) AS node FROM tree),
    nodes AS (SELECT node FROM ends UNION SELECT node FROM root),
    leaf_nodes AS (SELECT node FROM ends WHERE node NOT IN (SELECT node_id FROM kept)),
    members AS (SELECT node, leaf FROM nodes JOIN tree ON node_id = node JOIN walk ON rep = x AND since <= step
      UNION ALL SELECT node, node FROM nodes WHERE node < (SELECT count(*) FROM wide)),
    docs AS (SELECT leaf, CAST(label AS VARCHAR) AS class FROM wide JOIN embeddings USING (vec_id)),
    totals AS (SELECT class, count(*) AS n FROM docs GROUP BY class),
    counts AS (SELECT node, class, count(*) AS n FROM members JOIN docs USING (leaf) GROUP BY node, class), {S.SCORES} {S.REPORT}"""
)
def average_linkage_scores(spark, folder):
    made = linked(spark, folder)
    labels = linkage.cut_labels(made, SCORED_CLUSTERS).select("vec_id", "cluster_id")
    documents = table(spark, folder, "embeddings").select("vec_id", F.col("label").cast("string").alias("class"))
    report = score_merge_tree(
        documents.join(labels, "vec_id"), "cluster_id", "class", cut(made.merges), made.n_leaves, SCORED_CLUSTERS, label_closure(spark, folder)
    )
    return rounded(report, *report.columns)


@query()
def bisecting_k_means(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return flat.bisecting_k_means(vectors, "embedding", 8).select("vec_id", "label", "prediction")


@query()
def bisecting_k_means_f(spark, folder):
    """The flagship: cluster the vectors and score the clusters with and without the class tree."""
    found = flat.bisecting_k_means(table(spark, folder, "embeddings"), "embedding", 8)
    documents = cut(found.select("prediction", F.col("label").cast("string").alias("class")))
    plain = score_flat_clusters(documents, "prediction", "class").withColumnRenamed("f", "plain_f")
    with_tree = score_flat_clusters(documents, "prediction", "class", label_closure(spark, folder))
    rand = metrics.adjusted_rand_index(tree.contingency(documents, "prediction", "class"))
    return plain.select(with_tree.scalar().alias("hierarchical_f"), "plain_f", rand.scalar().alias("ari"))


def halves(spark, folder):
    # A linear function of the vector, so that a linear classifier has something to find.
    flag = (F.get("embedding", F.lit(0)) + F.get("embedding", F.lit(1)) + F.get("embedding", F.lit(2)) > 0).cast("int")
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", flag.alias("flag"))
    split = sampling.split_train_test(vectors, "vec_id", 0.5)
    return split.filter("NOT is_test").drop("is_test"), split.filter("is_test").drop("is_test")


@query()
def linear_svm_scores(spark, folder):
    train, test = halves(spark, folder)
    return scope.test_scores(scope.fit_linear_svm(train, "embedding", "flag"), test, "embedding", "flag")


# The first half in the order of a seeded hash is the test set, the rest the training set.
SQL_HALVES = """WITH ranked AS (SELECT vec_id, CAST(embedding[1] + embedding[2] + embedding[3] > 0 AS INT) AS flag,
  row_number() OVER (ORDER BY md5('0:' || vec_id), vec_id) AS place, count(*) OVER () AS n FROM embeddings),
train AS (SELECT vec_id, flag FROM ranked WHERE place > ceil(n * 0.5))"""


@query(
    f"""{SQL_HALVES}, drawn AS (SELECT * FROM (
      SELECT r, vec_id, flag, row_number() OVER (PARTITION BY r ORDER BY md5(r || ':' || vec_id), vec_id) AS place
      FROM train, range(5) t(r)) WHERE place <= 100),
    pool AS (SELECT t.r AS round, d.r || ':' || vec_id AS copy, vec_id, flag FROM range(5) t(r) JOIN drawn d ON d.r <= t.r),
    chosen AS (SELECT *, row_number() OVER (PARTITION BY round, flag ORDER BY md5(round || ':' || copy), copy) AS place FROM pool)
    SELECT round, vec_id, flag, count(*) AS copies FROM chosen WHERE flag = 1 OR place <= 50 GROUP BY round, vec_id, flag"""
)
def annotation_sets(spark, folder):
    train = cut(halves(spark, folder)[0].select("vec_id", "flag"))
    made = scope.annotation_sets(train, "vec_id", "flag")
    named = [rows.select(F.lit(k).cast("long").alias("round"), "vec_id", "flag") for k, rows in enumerate(made)]
    return reduce(DataFrame.unionByName, named).groupBy("round", "vec_id", "flag").agg(F.count("*").alias("copies"))


TRAINING_SIZES = [50, 100, 150, 200]


@query(
    f"""{SQL_HALVES}, ordered AS (SELECT vec_id, row_number() OVER (ORDER BY md5('0:' || vec_id), vec_id) AS place FROM train)
    SELECT n_train, vec_id FROM ordered, unnest({TRAINING_SIZES}) t(n_train) WHERE place <= n_train"""
)
def training_sets_by_size(spark, folder):
    train = cut(halves(spark, folder)[0].select("vec_id"))
    made = scope.sets_by_size(train, "vec_id", TRAINING_SIZES)
    return reduce(DataFrame.unionByName, [rows.select(F.lit(size).alias("n_train"), "vec_id") for size, rows in zip(TRAINING_SIZES, made)])


@query(
    """WITH units AS (SELECT vec_id % 4 AS parent, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)
        / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS unit FROM embeddings),
    cells AS (SELECT parent, label, unnest(unit) AS x, generate_subscripts(unit, 1) AS d FROM units),
    parts AS (SELECT parent, label, d, sum(x) AS s, count(*) AS n FROM cells GROUP BY GROUPING SETS ((parent, label, d), (parent, d)))
    SELECT parent, label AS cluster, any_value(n) AS n, round(any_value(n) - sqrt(sum(s * s)), 6) AS cost FROM parts GROUP BY parent, label"""
)
def partition_costs(spark, folder):
    vectors = table(spark, folder, "embeddings").select((F.col("vec_id") % 4).alias("parent"), F.col("label").alias("cluster"), "embedding")
    return rounded(flat.partition_costs(vectors, "parent", "cluster", "embedding", 64), "cost")


@query()
def annotation_rounds(spark, folder):
    train, test = halves(spark, folder)
    return scope.annotation_rounds(train, test, "vec_id", "embedding", "flag")


@query()
def scores_by_training_size(spark, folder):
    train, test = halves(spark, folder)
    return scope.scores_by_training_size(train, test, "vec_id", "embedding", "flag", TRAINING_SIZES)


@query()
def word_scope_stop_words(spark, folder):
    turns = table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.split("text", " ").alias("tokens"),
        (F.col("role") == "user").alias("inRel"),
    )
    articles = table(spark, folder, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("abstract"))
    return discover_stop_words(turns, articles, "doc_id", word_vectors(spark, folder), DIMENSIONS)

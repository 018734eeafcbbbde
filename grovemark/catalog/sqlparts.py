"""Statements shared by the tree and cluster queries."""

K = 8  # clusters the merge tree is cut into
BUDGET = 32  # leaves of the external tree

# Labels of the vectors as a two-level class tree: 3 and above lie below their remainder by 3.
LABEL_CLOSURE = """
label_paths AS (
  SELECT CAST(label AS VARCHAR) AS ui,
    CASE WHEN label < 3 THEN 'C.' || label ELSE 'C.' || (label % 3) || '.' || label END AS mn
  FROM (SELECT DISTINCT label FROM embeddings)),
closure AS (
  SELECT a.ui, d.ui AS descendant_ui FROM label_paths a
  JOIN label_paths d ON d.mn = a.mn OR starts_with(d.mn, a.mn || '.'))"""

# A merge tree over the vectors: merge k joins nodes 2k and 2k+1, so the parent of node j is n + j // 2.
MERGE_TREE = f"""
base AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS leaf, CAST(label AS VARCHAR) AS class, embedding
  FROM embeddings),
size AS (SELECT count(*) AS n_docs FROM base),
up(leaf, node, steps) AS (
  SELECT leaf, leaf, 0 FROM base
  UNION ALL SELECT leaf, n_docs + node // 2, steps + 1 FROM up, size WHERE node < 2 * n_docs - 2),
kept AS (SELECT leaf, node FROM up, size WHERE n_docs + node // 2 >= 2 * n_docs - {K}),
cut_leaves AS (SELECT node, min(leaf) AS cluster_id FROM kept, size WHERE node < 2 * n_docs - {K} GROUP BY node),
root AS (SELECT 2 * n_docs - 2 AS node FROM size),
totals AS (SELECT class, count(*) AS n FROM base GROUP BY class),
counts AS (SELECT node, class, count(*) AS n FROM kept JOIN base USING (leaf) GROUP BY node, class)"""

# Customers as the nodes of an external tree, orders as its phrases. Node i has children 2i and 2i+1; an order
# lists the nodes from its customer's up to the root, apart from every fifth one.
EXTERNAL_TREE = f"""
nodes AS (SELECT c_custkey + 1 AS id FROM customer),
chain(o_orderkey, k) AS (
  SELECT o_orderkey, o_custkey + 1 FROM orders UNION ALL SELECT o_orderkey, k // 2 FROM chain WHERE k > 1),
keys AS (SELECT o_orderkey, k FROM chain WHERE k % 5 <> 4),
seen AS (SELECT DISTINCT k FROM keys),
edges AS (
  SELECT p.id AS parent, c.id AS child, c.id % 2 AS position FROM nodes p JOIN nodes c ON c.id // 2 = p.id
  WHERE c.id IN (SELECT k FROM seen)),
reach(node, depth, path) AS (
  SELECT 1::BIGINT, 0, CAST([] AS BIGINT[])
  UNION ALL SELECT child, depth + 1, list_append(path, position) FROM reach JOIN edges ON parent = node),
gains AS (SELECT node, depth, path, count(*) - 1 AS gain FROM reach JOIN edges ON parent = node GROUP BY ALL),
visits AS (
  SELECT node, 1 + coalesce(sum(gain) OVER (
    ORDER BY depth, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS made FROM gains),
grown AS (SELECT parent, child FROM edges JOIN visits ON parent = node WHERE made < {BUDGET}),
grown_leaves AS (SELECT child AS node FROM grown WHERE child NOT IN (SELECT parent FROM grown)),
placed AS (SELECT o_orderkey, min(k) AS cluster_id FROM keys JOIN grown_leaves ON k = node GROUP BY o_orderkey)"""

# Scores from counts(node, class, n), totals(class, n), closure and root(node).
SCORES = """
per_node AS (SELECT node, sum(n) AS n, coalesce(max(n) FILTER (class IS NOT NULL), 0) AS majority
  FROM counts GROUP BY node),
largest AS (SELECT c.node, c.class, c.n FROM counts c JOIN per_node p USING (node)
  WHERE c.n = p.majority AND c.class IS NOT NULL),
recalls AS (
  SELECT t.class, t.n, coalesce(m.best, 0) / t.n AS recall FROM totals t
  LEFT JOIN (SELECT class, max(n) AS best FROM largest WHERE node NOT IN (SELECT node FROM root) GROUP BY class) m
    USING (class)
  WHERE t.class IS NOT NULL),
occurring AS (SELECT ui, descendant_ui FROM closure WHERE ui IN (SELECT class FROM totals)),
whole AS (SELECT ui, sum(n) AS n_class FROM totals JOIN occurring ON class = descendant_ui GROUP BY ui),
found AS (
  SELECT ui, node, sum(n) AS k FROM counts JOIN occurring ON class = descendant_ui
  WHERE node NOT IN (SELECT node FROM root) GROUP BY ui, node),
leaf_found AS (SELECT * FROM found WHERE node IN (SELECT node FROM leaf_nodes))"""


def f_score(found: str = "found") -> str:
    return f"""(SELECT sum(n_class * best) / (SELECT sum(n) FROM totals) FROM (
      SELECT ui, n_class, coalesce(max(2 * k / (p.n + n_class)), 0) AS best
      FROM whole LEFT JOIN {found} USING (ui) LEFT JOIN per_node p USING (node) GROUP BY ui, n_class))"""


PRECISION_MACRO = "(SELECT avg(majority / n) FROM per_node)"
PRECISION_MICRO = "(SELECT sum(majority) / sum(n) FROM per_node)"
RECALL_MACRO = "(SELECT avg(recall) FROM recalls)"
RECALL_MICRO = "(SELECT sum(recall * n) / sum(n) FROM recalls)"
REPORT = f"""SELECT round(pa, 6) AS precision_macro, round(pi, 6) AS precision_micro, round(ra, 6) AS recall_macro,
  round(ri, 6) AS recall_micro, round(2 * pa * ra / (pa + ra), 6) AS f1_macro,
  round(2 * pi * ri / (pi + ri), 6) AS f1_micro, round(f, 6) AS hierarchical_f
FROM (SELECT {PRECISION_MACRO} AS pa, {PRECISION_MICRO} AS pi, {RECALL_MACRO} AS ra, {RECALL_MICRO} AS ri,
  {f_score()} AS f)"""

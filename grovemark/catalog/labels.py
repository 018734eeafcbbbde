"""Class vocabularies, labels, samples and counts over regions, nations, customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovemark.catalog.registry import Entry, registrar, table
from grovemark.functions import labels as L
from grovemark.operators import classes, flat, sampling

ENTRIES: dict[str, Entry] = {}
query = registrar(ENTRIES)

# Regions and nations as a class tree with dotted numbers; every fifth nation has a second number.
SQL_PATHS = """
paths AS (
  SELECT DISTINCT 'ROOT' AS ui, 'W' AS mn, 'World' AS heading FROM region
  UNION ALL SELECT 'R' || r_regionkey, 'W.' || r_regionkey, r_name FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'W.' || n_regionkey || '.' || n_nationkey, n_name FROM nation
  UNION ALL SELECT 'N' || n_nationkey, 'W.' || ((n_regionkey + 1) % 5) || '.' || n_nationkey, n_name FROM nation
    WHERE n_nationkey % 5 = 0),
closure AS (
  SELECT DISTINCT a.ui, d.ui AS descendant_ui FROM paths a
  JOIN paths d ON d.mn = a.mn OR starts_with(d.mn, a.mn || '.'))"""
# Customers as documents labelled with their nation, or with the region when they owe money.
SQL_CUSTOMERS = """
people AS (
  SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'R' || n_regionkey ELSE 'N' || n_nationkey END AS class,
    ascii(c_mktsegment) AS cluster FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
# Customers as articles: the priorities of their orders are the headings, the abstract may be missing.
SQL_ARTICLES = """
articles AS (
  SELECT c_custkey, any_value(CASE WHEN c_acctbal >= 0 THEN c_name END) AS abstract,
    list('P' || substr(o_orderpriority, 1, 1) ORDER BY o_orderkey) FILTER (o_orderkey IS NOT NULL) AS headings
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey),
restricted AS (
  SELECT c_custkey, abstract, nullif(list_filter(headings, lambda x: x IN ('P1', 'P2')), []) AS kept, headings
  FROM articles)"""


def class_paths(spark, folder):
    region, nation = table(spark, folder, "region"), table(spark, folder, "nation")
    root = region.select(F.lit("ROOT").alias("ui"), F.lit("W").alias("mn"), F.lit("World").alias("heading")).distinct()
    regions = region.select(
        F.concat(F.lit("R"), "r_regionkey").alias("ui"),
        F.concat(F.lit("W."), "r_regionkey").alias("mn"),
        F.col("r_name").alias("heading"),
    )

    def nations(rows, parent):
        return rows.select(
            F.concat(F.lit("N"), "n_nationkey").alias("ui"),
            F.concat(F.lit("W."), parent, F.lit("."), F.col("n_nationkey")).alias("mn"),
            F.col("n_name").alias("heading"),
        )

    second = nations(nation.filter(F.col("n_nationkey") % 5 == 0), (F.col("n_regionkey") + 1) % 5)
    return root.unionByName(regions).unionByName(nations(nation, F.col("n_regionkey"))).unionByName(second)


def people(spark, folder):
    nation = table(spark, folder, "nation")
    owed = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("R"), "n_regionkey"))
    return (
        table(spark, folder, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "c_custkey",
            F.coalesce(owed, F.concat(F.lit("N"), "n_nationkey")).alias("class"),
            F.ascii("c_mktsegment").alias("cluster"),
        )
    )


def articles(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.struct("o_orderkey", F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1)).alias("ui")).alias("h"),
    )
    listed = orders.groupBy("c_custkey").agg(F.array_sort(F.collect_list("h")).alias("h"))
    abstract = F.when(F.col("c_acctbal") >= 0, F.col("c_name"))
    return (
        table(spark, folder, "customer")
        .select("c_custkey", abstract.alias("abstract"))
        .join(listed, "c_custkey", "left")
        .select("c_custkey", "abstract", F.transform("h", lambda h: h["ui"]).alias("headings"))
    )


def restricted(spark, folder):
    codes = table(spark, folder, "orders").select(F.substring("o_orderpriority", 1, 1).alias("code")).distinct()
    wanted = codes.filter("code <= '2'").select(F.concat(F.lit("P"), "code").alias("ui"))
    kept = articles(spark, folder).withColumn("kept", F.col("headings"))
    return classes.restrict_headings(kept, "c_custkey", "kept", wanted)


@query(f"WITH {SQL_PATHS} SELECT ui, mn, heading FROM paths WHERE mn = 'W.1' OR starts_with(mn, 'W.1.')")
def class_subtree(spark, folder):
    return classes.subtree(class_paths(spark, folder), "W.1")


@query(
    f"""WITH {SQL_PATHS}, overrides AS (
      SELECT 'X' || n_nationkey AS ui, 'W.' || n_regionkey || '.' || n_nationkey AS mn, lower(n_name) AS heading
      FROM nation WHERE n_regionkey = 0
      UNION ALL SELECT 'Y' || r_regionkey, 'W.9' || r_regionkey, r_name FROM region)
    SELECT ui, mn, heading FROM paths WHERE mn NOT IN (SELECT mn FROM overrides)
    UNION ALL SELECT * FROM overrides"""
)
def vocabulary_patch(spark, folder):
    renamed = table(spark, folder, "nation").filter("n_regionkey = 0").select(
        F.concat(F.lit("X"), "n_nationkey").alias("ui"),
        F.concat(F.lit("W."), F.col("n_regionkey"), F.lit("."), F.col("n_nationkey")).alias("mn"),
        F.lower("n_name").alias("heading"),
    )
    added = table(spark, folder, "region").select(
        F.concat(F.lit("Y"), "r_regionkey").alias("ui"),
        F.concat(F.lit("W.9"), "r_regionkey").alias("mn"),
        F.col("r_name").alias("heading"),
    )
    return classes.patch(class_paths(spark, folder), renamed.unionByName(added)).select("ui", "mn", "heading")


@query(f"WITH {SQL_PATHS} SELECT ui, max(mn) AS mn, any_value(heading) AS heading FROM paths GROUP BY ui")
def index_inversion(spark, folder):
    return classes.one_path_per_class(class_paths(spark, folder))


@query(f"WITH {SQL_PATHS} SELECT ui, descendant_ui FROM closure")
def class_closure(spark, folder):
    return classes.class_closure(class_paths(spark, folder))


@query(
    f"""WITH {SQL_PATHS}, {SQL_CUSTOMERS}
    SELECT c_custkey, class, coalesce(string_agg(ui, ';' ORDER BY ui), '') AS ancestors FROM people
    LEFT JOIN closure ON class = descendant_ui AND ui <> class AND ui <> 'ROOT' GROUP BY c_custkey, class"""
)
def ancestor_column(spark, folder):
    documents = classes.with_ancestors(people(spark, folder), class_paths(spark, folder), "ROOT", "class")
    return documents.select("c_custkey", "class", F.array_join("ancestors", ";").alias("ancestors"))


@query(
    f"""WITH {SQL_PATHS}, {SQL_CUSTOMERS}
    SELECT c_custkey, class IN (SELECT descendant_ui FROM closure WHERE ui = 'R1') AS positive FROM people"""
)
def positive_flag(spark, folder):
    documents = classes.with_ancestors(people(spark, folder), class_paths(spark, folder), "ROOT", "class")
    flag = L.is_class_or_below(F.col("class"), F.col("ancestors"), "R1")
    return documents.select("c_custkey", flag.alias("positive"))


@query(
    f"""WITH {SQL_PATHS}, {SQL_CUSTOMERS}
    SELECT class IN (SELECT descendant_ui FROM closure WHERE ui = 'R1') AS positive, count(*) AS n
    FROM people GROUP BY 1"""
)
def positive_negative_counts(spark, folder):
    return positive_flag(spark, folder).groupBy("positive").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SQL_CUSTOMERS} SELECT c_custkey, CAST(class = 'R1' AS INT) AS flag FROM people")
def exact_class_flag(spark, folder):
    return people(spark, folder).select("c_custkey", L.is_exact_class(F.col("class"), "R1").alias("flag"))


@query(f"WITH {SQL_CUSTOMERS} SELECT c_custkey, class FROM people WHERE class <> 'R2'")
def root_class_removal(spark, folder):
    return classes.without_class(people(spark, folder), "class", "R2").select("c_custkey", "class")


@query(
    f"""WITH {SQL_PATHS}, {SQL_CUSTOMERS}
    SELECT c_custkey, class, max(mn) AS mn, any_value(heading) AS heading
    FROM people LEFT JOIN paths ON class = ui GROUP BY c_custkey, class"""
)
def label_lookup(spark, folder):
    return classes.with_label_details(people(spark, folder), class_paths(spark, folder), "class").drop("cluster")


@query(f"WITH {SQL_ARTICLES} SELECT c_custkey, array_to_string(kept, ';') AS kept FROM restricted")
def heading_restriction(spark, folder):
    return restricted(spark, folder).select("c_custkey", F.array_join("kept", ";").alias("kept"))


@query(f"WITH {SQL_ARTICLES} SELECT c_custkey FROM restricted WHERE abstract IS NOT NULL AND kept IS NOT NULL")
def eligible_articles(spark, folder):
    found = restricted(spark, folder)
    return found.filter(L.is_eligible(F.col("headings"), F.col("abstract"), F.col("kept"))).select("c_custkey")


@query(f"WITH {SQL_ARTICLES} SELECT c_custkey, kept[1] AS label FROM restricted WHERE len(kept) = 1")
def single_label_articles(spark, folder):
    labelled = restricted(spark, folder).select("c_custkey", L.single_label(F.col("kept")).alias("label"))
    return labelled.filter(F.col("label").isNotNull())


@query(
    f"""WITH {SQL_ARTICLES} SELECT label, count(*) AS n FROM (SELECT unnest(headings) AS label FROM articles)
    GROUP BY label"""
)
def label_frequency(spark, folder):
    return classes.label_frequency(articles(spark, folder), "headings")


@query(f"WITH {SQL_CUSTOMERS} SELECT class, count(*) AS n FROM people GROUP BY class")
def class_frequency(spark, folder):
    return classes.class_frequency(people(spark, folder), "class")


@query(f"WITH {SQL_CUSTOMERS} SELECT class, count(*) AS n FROM people GROUP BY class ORDER BY n DESC, class")
def class_order_by_frequency(spark, folder):
    return classes.most_frequent_first(classes.class_frequency(people(spark, folder), "class"))


@query(
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN CAST(o_orderdate AS DATE)
      WHEN 'P' THEN CAST(o_orderdate AS DATE) + 1 END AS completed FROM orders"""
)
def date_fallback(spark, folder):
    def parts(day):
        return F.struct(
            F.date_format(day, "yyyy").alias("Year"),
            F.date_format(day, "MM").alias("Month"),
            F.date_format(day, "dd").alias("Day"),
        )

    day = F.to_date("o_orderdate")
    status = F.col("o_orderstatus")
    done = F.when(status == "F", parts(day))
    revised = F.when(status != "O", parts(F.date_add(day, 1)))
    return table(spark, folder, "orders").select("o_orderkey", L.completion_date(done, revised).alias("completed"))


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS id, o_orderstatus AS class, count(*) AS n
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL"""
)
def phrase_label_join(spark, folder):
    phrases = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    orders = table(spark, folder, "orders").withColumnRenamed("o_orderstatus", "class")
    joined = flat.with_true_class(phrases, orders, "id", "o_custkey", "class")
    return joined.groupBy("id", "class").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT * FROM (SELECT o_orderkey FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 1000)"""
)
def exact_sample(spark, folder):
    return sampling.sample_exact(table(spark, folder, "orders"), "o_orderkey", 1000, seed=7).select("o_orderkey")


@query(
    """SELECT o_orderkey, o_orderpriority FROM (
      SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('0:' || o_orderkey), o_orderkey) AS place
      FROM orders)
    WHERE o_orderpriority = '1-URGENT' OR (o_orderpriority IN ('2-HIGH', '5-LOW') AND place <= 200)"""
)
def per_class_sample(spark, folder):
    quotas = {"1-URGENT": None, "2-HIGH": 200, "5-LOW": 200}
    sample = sampling.sample_per_class(table(spark, folder, "orders"), "o_orderkey", "o_orderpriority", quotas)
    return sample.select("o_orderkey", "o_orderpriority")


@query(
    """SELECT o_orderkey, positive FROM (
      SELECT *, row_number() OVER (PARTITION BY positive ORDER BY md5('3:' || o_orderkey), o_orderkey) AS place
      FROM (SELECT o_orderkey, o_orderpriority = '1-URGENT' AS positive FROM orders))
    WHERE place <= 1000"""
)
def balanced_sample(spark, folder):
    positive = F.col("o_orderpriority") == "1-URGENT"
    sample = sampling.balanced_subset(table(spark, folder, "orders"), "o_orderkey", positive, 1000, seed=3)
    return sample.select("o_orderkey", positive.alias("positive"))


@query("SELECT o_orderkey FROM orders WHERE substr(md5('0:' || o_orderkey), 1, 8) < '05604189'")
def bernoulli_sample(spark, folder):
    return sampling.bernoulli_sample(table(spark, folder, "orders"), "o_orderkey", 0.021).select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY md5('1:' || o_orderkey), o_orderkey")
def shuffled_rows(spark, folder):
    return sampling.shuffled(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", seed=1)


@query(
    """SELECT o_orderkey, row_number() OVER (ORDER BY md5('0:' || o_orderkey), o_orderkey)
      <= ceil(count(*) OVER () * 0.3) AS is_test FROM orders"""
)
def train_test_split(spark, folder):
    split = sampling.split_train_test(table(spark, folder, "orders"), "o_orderkey", 0.3)
    return split.select("o_orderkey", "is_test")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS row_id FROM orders")
def dense_row_ids(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey")
    return sampling.dense_ids(orders, ["o_custkey", "o_orderkey"], "row_id").select("o_orderkey", "row_id")


@query("SELECT o_orderkey AS key FROM orders UNION ALL SELECT c_custkey AS key FROM customer")
def append_rows(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"))
    return orders.unionByName(table(spark, folder, "customer").select(F.col("c_custkey").alias("key")))

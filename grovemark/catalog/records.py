"""Sources and sinks: tables written in a foreign format below the checkpoint folder and read back whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovemark.catalog import texts
from grovemark.catalog.labels import SQL_ARTICLES
from grovemark.catalog.registry import Entry, registrar, table
from grovemark.catalog.trees import MERGE_SQL, external_nodes, merge_tree
from grovemark.functions import text as T
from grovemark.session import new_path
from grovemark.sources import articles, clusterer, vocabulary, words

ENTRIES: dict[str, Entry] = {}
query = registrar(ENTRIES)


@query(
    """SELECT 'C' || c_custkey AS ui, c_name AS heading, unnest(CASE WHEN c_custkey % 7 = 0
      THEN ['W.' || c_nationkey || '.' || c_custkey, 'V.' || c_custkey] ELSE ['W.' || c_nationkey || '.' || c_custkey] END) AS mn
    FROM customer"""
)
def class_vocabulary(spark, folder):
    """Customers as vocabulary records; every seventh has two tree numbers."""
    customer = table(spark, folder, "customer")
    number = F.format_string("MN = W.%d.%d\n", "c_nationkey", "c_custkey")
    second = F.when(F.col("c_custkey") % 7 == 0, F.format_string("MN = V.%d\n", "c_custkey")).otherwise("")
    head = F.concat(F.lit("*NEWRECORD\nRECTYPE = D\nMH = "), "c_name", F.lit("\nENTRY = "), "c_mktsegment", F.lit("\n"))
    record = F.concat(head, number, second, F.format_string("UI = C%d\n", "c_custkey"))
    path = new_path(spark)
    customer.select(record.alias("value")).write.text(path)
    return vocabulary.read_class_paths(spark, path).select("ui", "heading", "mn")


@query(
    f"""WITH {SQL_ARTICLES}
    SELECT CAST(c_custkey AS VARCHAR) AS PMID, c_mktsegment AS Title,
      CASE WHEN c_acctbal >= 0 THEN c_name END AS Abstract, coalesce(array_to_string(headings, ';'), '') AS headings,
      CASE WHEN c_custkey % 5 <> 4 THEN make_date(CASE WHEN c_custkey % 3 = 0 THEN 1960 ELSE 1990 END + c_custkey % 30,
        1 + c_custkey % 12, 1 + c_custkey % 28) END AS DateCompleted
    FROM customer JOIN articles USING (c_custkey)"""
)
def article_records(spark, folder):
    """Customers as article records in XML: the date may be missing or only that of the revision, the abstract too."""
    customer, orders = table(spark, folder, "customer"), table(spark, folder, "orders")
    heading = F.struct("o_orderkey", F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1)).alias("_UI"))
    held = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(heading)).alias("held"))
    key = F.col("c_custkey")

    def date(first_year: int):
        day = (F.lit(first_year) + key % 30, 1 + key % 12, 1 + key % 28)
        return F.struct(*(x.cast("string").alias(name) for x, name in zip(day, ("Year", "Month", "Day"))))

    parts = F.when(F.col("c_acctbal") >= 0, F.struct(F.array("c_name", "c_mktsegment").alias("AbstractText")))
    descriptors = F.transform("held", lambda h: F.struct(F.struct(h["_UI"].alias("_UI"), F.lit("x").alias("_VALUE")).alias("DescriptorName")))
    citation = F.struct(
        F.struct(key.cast("string").alias("_VALUE"), F.lit("1").alias("_Version")).alias("PMID"),
        F.when((key % 3 == 0) & (key % 5 != 4), date(1960)).alias("DateCompleted"),
        F.when(key % 5 != 4, date(1990)).alias("DateRevised"),
        F.struct(F.concat(F.lit("["), "c_mktsegment", F.lit("].")).alias("ArticleTitle"), parts.alias("Abstract")).alias("Article"),
        F.when(F.col("held").isNotNull(), F.struct(descriptors.alias("MeshHeading"))).alias("MeshHeadingList"),
    )
    path = new_path(spark)
    records = customer.join(held, "c_custkey", "left").select(citation.alias("MedlineCitation"))
    records.write.format("xml").option("rootTag", "PubmedArticleSet").option("rowTag", "PubmedArticle").save(path)
    found = articles.read_article_xml(spark, path)
    return found.select("PMID", "Title", "Abstract", F.concat_ws(";", "MeshList").alias("headings"), F.col("DateCompleted").cast("date").alias("DateCompleted"))


@query(
    """WITH ends AS (SELECT max(c_custkey) + 1 AS last FROM customer)
    SELECT c_custkey AS node_id, array_to_string(list_filter([2 * (c_custkey + 1), 2 * (c_custkey + 1) + 1], lambda c: c <= last), ';') AS children,
      CAST(c_custkey + 1 AS VARCHAR) AS filter_value FROM customer, ends"""
)
def node_records(spark, folder):
    """The nodes of the external tree as one JSON array, in which a node is known by its place."""
    node = F.struct("node_id", "children", F.col("filter_value").alias("filterValue"))
    whole = external_nodes(spark, folder).agg(F.array_sort(F.collect_list(node)).alias("nodes"))  # the format is one array
    bare = F.transform("nodes", lambda n: F.struct(n["children"].alias("children"), n["filterValue"].alias("filterValue")))
    path = new_path(spark)
    whole.select(F.to_json(bare).alias("value")).write.text(path)
    found = clusterer.read_nodes(spark, path)
    text = (F.concat_ws(";", F.col(c).cast("array<string>")).alias(c) for c in ("children", "filter_value"))
    return found.select(F.col("node_id").cast("long").alias("node_id"), *text)


@query(
    f"""WITH {texts.SQL_WORDS.strip()}
    SELECT word, {", ".join(f"round(CAST(CAST(vec[{i}] / 7.0 AS FLOAT) AS DOUBLE), 4) AS v{i}" for i in range(1, texts.DIMENSIONS + 1))} FROM vectors"""
)
def word_vector_file(spark, folder):
    """Word vectors through the text form with a header and back."""
    sevenths = texts.word_vectors(spark, folder).select("word", F.transform("vec", lambda x: (x / F.lit(7.0)).cast("float")).alias("vec"))
    path = new_path(spark)
    words.write_word_vectors(sevenths, path)
    found = words.read_word_vectors(spark, path)
    return found.select("word", *(F.round(F.get("vec", F.lit(i)).cast("double"), 4).alias(f"v{i + 1}") for i in range(texts.DIMENSIONS)))


@query(f"WITH {texts.SQL_WORDS.strip()} SELECT DISTINCT word FROM words")
def word_list(spark, folder):
    """The distinct tokens of the documents through a list with one word a line."""
    found = texts.tokenised(spark, folder).select(F.explode("tokens").alias("word")).distinct()
    path = new_path(spark)
    words.write_words(found, path)
    return words.read_words(spark, path)


@query(
    f"""WITH {texts.SQL_WORDS.strip()} SELECT doc_id AS id, md5(array_to_string(tokens, ';')) AS digest,
      array_to_string(list_filter(tokens, lambda x: len(x) > 5), ';') AS in_scope FROM docs"""
)
def phrase_scan(spark, folder):
    """Phrases with their nested index through a parquet table."""
    path = new_path(spark)
    articles.write_table(texts.phrases(spark, folder).withColumn("unused", F.lit(1)), path)
    found = clusterer.read_phrases(spark, path)
    inside = T.joined(T.tokens_in_class(F.col("tokens"), F.col("index"), 1))
    return found.select("id", F.md5(T.joined(F.col("tokens"))).alias("digest"), inside.alias("in_scope"))


@query(
    f"""{MERGE_SQL}, numbered AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS leaf FROM embeddings)
    SELECT vec_id, class, cluster_id FROM kept JOIN cut_leaves USING (node) JOIN base USING (leaf) JOIN numbered USING (leaf)"""
)
def cluster_output_scan(spark, folder):
    """Clustered documents, written with their vectors and read without them."""
    path = new_path(spark)
    articles.write_table(merge_tree(spark, folder).documents, path)
    return articles.read_table(spark, path, ["vec_id", "class", "cluster_id"])


@query("SELECT vec_id AS PMID, CAST(label AS VARCHAR) AS mesh_ui_diab, CAST(vec_id % 8 AS INT) AS prediction FROM embeddings")
def flat_output_scan(spark, folder):
    """A flat clustering, written with its vectors and read without them."""
    path = new_path(spark)
    made = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("PMID"), F.col("label").cast("string").alias("mesh_ui_diab"), (F.col("vec_id") % 8).cast("int").alias("prediction"), "embedding"
    )
    articles.write_table(made, path)
    return clusterer.read_predictions(spark, path)

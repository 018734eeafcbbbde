"""Text, tokens, word lists, word vectors and table descriptions over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovemark.catalog.registry import Entry, registrar, table
from grovemark.functions import text as T
from grovemark.operators import audit, flat, vectors
from grovemark.operators.classes import keep_listed
from grovemark.sources.articles import read_table

ENTRIES: dict[str, Entry] = {}
query = registrar(ENTRIES)

DIMENSIONS = 8

# The character sets below define the tokeniser. The tables are those most statements start from.
SQL_TOKENS = r"""list_filter(string_split_regex(regexp_replace(regexp_replace(lower({0}), '["/\\'']', '', 'g'),
  '[.,?;*!%^&_+():<=>@\[\]{{}}]', '', 'g'),
  '[\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'),
  lambda x: x <> '')"""
SQL_WORDS = f"""
docs AS (SELECT doc_id, {SQL_TOKENS.format('text')} AS tokens FROM documents),
words AS (SELECT doc_id, unnest(tokens) AS word FROM docs),
vocabulary AS (SELECT DISTINCT unnest({SQL_TOKENS.format('text')}) AS word FROM conversations),
vectors AS (SELECT word, list_transform(range(1, {DIMENSIONS + 1}), lambda i: ascii(substr(md5(word), i, 1))) AS vec
            FROM vocabulary)"""


def tokenised(spark, folder, name="documents", key="doc_id"):
    return table(spark, folder, name).select(key, T.tokens(F.col("text")).alias("tokens"))


def word_vectors(spark, folder):
    """The words of the conversations, with vectors read off their md5 digests."""
    turns = tokenised(spark, folder, "conversations", "conv_id")
    words = vectors.document_words(turns, "conv_id", "tokens").select("word").distinct().filter("word IS NOT NULL")
    digits = [F.ascii(F.substring(F.md5("word"), i, 1)).cast("float") for i in range(1, DIMENSIONS + 1)]
    return words.select("word", F.array(*digits).alias("vec"))


def phrases(spark, folder):
    """Documents as phrases: class 1 lists the tokens longer than five letters, class 2 the others."""
    docs = tokenised(spark, folder)
    places = F.when(F.size("tokens") > 0, F.sequence(F.lit(0), F.size("tokens") - 1)).otherwise(
        F.array().cast("array<int>")
    )

    def listed(test):
        kept = F.filter(places, lambda i: test(F.length(F.get("tokens", i))))
        return F.map_from_arrays(kept, F.transform(kept, lambda i: F.lit(1.0)))

    return docs.select(
        F.col("doc_id").alias("id"),
        "tokens",
        F.create_map(F.lit(1), listed(lambda n: n > 5), F.lit(2), listed(lambda n: n <= 5)).alias("index"),
    )


def length_phrases(spark, folder):
    """Documents as phrases with a class for each length that a token has."""
    docs = tokenised(spark, folder)
    lengths = F.array_distinct(F.transform("tokens", F.length))

    def places(n):
        at = F.transform("tokens", lambda w, i: F.when(F.length(w) == n, i))
        return F.map_from_entries(F.transform(F.filter(at, lambda i: i.isNotNull()), lambda i: F.struct(i, F.lit(1.0))))

    return docs.select(F.col("doc_id").alias("id"), "tokens", F.map_from_arrays(lengths, F.transform(lengths, places)).alias("index"))


@query("SELECT doc_id, lang, source FROM documents")
def article_scan(spark, folder):
    return read_table(spark, f"{folder}/documents.parquet", ["doc_id", "lang", "source"])


@query("SELECT doc_id, replace(source || ' ' || text, chr(10), '') AS line FROM documents")
def one_line_text(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", T.one_line(T.document_text(F.col("source"), F.col("text"))).alias("line"))


SQL_CLEAN = r"md5(regexp_replace(regexp_replace(regexp_replace({0}, '^\[', ''), '\.\z', ''), '\]\z', ''))"


@query(
    f"""SELECT doc_id, {SQL_CLEAN.format("text")} AS plain, {SQL_CLEAN.format("'[' || text || '].'")} AS bracketed,
      {SQL_CLEAN.format("text || '.]'")} AS closed FROM documents"""
)
def title_clean(spark, folder):
    text = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id",
        F.md5(T.clean_title(text)).alias("plain"),
        F.md5(T.clean_title(F.concat(F.lit("["), text, F.lit("].")))).alias("bracketed"),
        F.md5(T.clean_title(F.concat(text, F.lit(".]")))).alias("closed"),
    )


@query(
    """SELECT d.doc_id, md5(d.source || ' ' || d.text) AS digest,
      md5(CASE WHEN l.toxic = 1 THEN d.source END || ' ' || d.text) AS partial_digest
    FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def text_build(spark, folder):
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    title = F.when(F.col("toxic") == 1, F.col("source"))
    return docs.select(
        "doc_id",
        F.md5(T.document_text(F.col("source"), F.col("text"))).alias("digest"),
        F.md5(T.document_text(title, F.col("text"))).alias("partial_digest"),
    )


@query(
    f"""WITH {SQL_WORDS.strip()} SELECT doc_id, len(tokens) AS n_tokens, md5(array_to_string(tokens, ' ')) AS digest
    FROM docs"""
)
def tokeniser(spark, folder):
    return tokenised(spark, folder).select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.md5(F.array_join("tokens", " ")).alias("digest"),
    )


@query(
    f"""WITH {SQL_WORDS.strip()},
    stop AS (SELECT list(DISTINCT w) AS stopped
      FROM (SELECT unnest({SQL_TOKENS.format('text')}) AS w FROM benchmark))
    SELECT doc_id, array_to_string(list_filter(tokens, lambda x: NOT list_contains(stopped, x)), ' ') AS kept
    FROM docs, stop"""
)
def stop_word_removal(spark, folder):
    stop = tokenised(spark, folder, "benchmark", "item_id").select(F.explode("tokens").alias("word"))
    kept = keep_listed(tokenised(spark, folder), "doc_id", "tokens", stop, keep=False)
    return kept.select("doc_id", F.array_join("tokens", " ").alias("kept"))


@query(
    f"""WITH {SQL_WORDS.strip()} SELECT DISTINCT word FROM words
    WHERE regexp_matches(word, '[\\p{{Nd}}²³¹⁰-⁹₀-₉①-⑨]') AND word NOT IN (SELECT word FROM vocabulary)"""
)
def unknown_words_with_digit(spark, folder):
    return vectors.unknown_words_with_digit(
        tokenised(spark, folder), "doc_id", "tokens", word_vectors(spark, folder)
    )


@query("SELECT o_orderkey, CAST(CAST(o_orderkey AS VARCHAR) AS BIGINT) AS key_number FROM orders")
def numeric_key_cast(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderkey").cast("string").cast("long").alias("key_number")
    )


@query(
    f"""WITH {SQL_WORDS.strip()} SELECT doc_id AS id, array_to_string(tokens, ';') AS tokens,
      array_to_string(list_sort(list_distinct(list_transform(tokens, lambda x: len(x)))), ';') AS classes
    FROM docs"""
)
def token_joining(spark, folder):
    return length_phrases(spark, folder).select(
        "id", T.joined(F.col("tokens")).alias("tokens"), T.joined(T.class_keys(F.col("index"))).alias("classes")
    )


@query(
    f"""WITH {SQL_WORDS.strip()} SELECT doc_id AS id, array_to_string(list_filter(tokens, lambda x: len(x) > 5), ';')
      AS in_scope FROM docs"""
)
def tokens_in_class(spark, folder):
    return phrases(spark, folder).select(
        "id", T.joined(T.tokens_in_class(F.col("tokens"), F.col("index"), 1)).alias("in_scope")
    )


@query(
    f"""WITH {SQL_WORDS.strip()} SELECT doc_id AS id,
      array_to_string(list_sort(list_distinct(list_filter(tokens, lambda x: len(x) <= 5))), ';') AS out_of_scope
    FROM docs"""
)
def token_set_difference(spark, folder):
    inside = T.tokens_in_class(F.col("tokens"), F.col("index"), 1)
    outside = T.tokens_outside(F.col("tokens"), inside)
    return phrases(spark, folder).select("id", T.joined(F.array_sort(outside)).alias("out_of_scope"))


@query(f"WITH {SQL_WORDS.strip()} SELECT DISTINCT word FROM words WHERE len(word) <= 5")
def out_of_scope_vocabulary(spark, folder):
    return flat.out_of_scope_words(phrases(spark, folder))


@query(f"WITH {SQL_WORDS.strip()} SELECT DISTINCT CAST(len(word) AS INT) AS class FROM words")
def classes_seen_in_phrases(spark, folder):
    return flat.seen_classes(length_phrases(spark, folder))


@query(
    f"""WITH {SQL_WORDS.strip()} SELECT bool_or(len(tokens) > 0 AND tokens[1] = 'the') AS found FROM docs"""
)
def membership_probe(spark, folder):
    docs = tokenised(spark, folder)
    return docs.agg(F.bool_or(F.coalesce(F.get("tokens", F.lit(0)) == "the", F.lit(False))).alias("found"))


@query(
    """SELECT 'doc_id' AS "column", count(*) FILTER (doc_id IS NULL) AS n_null FROM j
    UNION ALL SELECT 'source', count(*) FILTER (source IS NULL) FROM j
    UNION ALL SELECT 'quality', count(*) FILTER (quality IS NULL) FROM j
    UNION ALL SELECT 'share', count(*) FILTER (share IS NULL OR isnan(share)) FROM j""".replace(
        " FROM j",
        """ FROM (SELECT d.doc_id, d.source, l.quality,
        CASE WHEN l.toxic = 1 THEN CAST('NaN' AS DOUBLE) ELSE CAST(l.toxic AS DOUBLE) END AS share
        FROM documents d LEFT JOIN labels l USING (doc_id)) j""",
    )
)
def null_audit(spark, folder):
    joined = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    share = F.when(F.col("toxic") == 1, F.lit(float("nan"))).otherwise(F.col("toxic").cast("double"))
    return audit.null_audit(joined.select("doc_id", "source", "quality", share.alias("share")))


@query("SELECT count(*) AS n_rows, count(text) AS n_texts FROM documents")
def table_shape(spark, folder):
    return table(spark, folder, "documents").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("text").alias("n_texts")
    )


@query(
    f"""WITH {SQL_WORDS.strip()}, sums AS (
      SELECT doc_id, count(*) AS n, {', '.join(f'avg(vec[{i}]) AS a{i}' for i in range(1, DIMENSIONS + 1))}
      FROM words JOIN vectors USING (word) GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words,
      {', '.join(f'coalesce(round(CAST(CAST(a{i} AS FLOAT) AS DOUBLE), 3), 0) AS v{i}' for i in range(1, DIMENSIONS + 1))}
    FROM docs d LEFT JOIN sums USING (doc_id)"""
)
def mean_word_vectors(spark, folder):
    means = vectors.mean_vectors(
        tokenised(spark, folder), "doc_id", "tokens", word_vectors(spark, folder), DIMENSIONS
    )
    parts = [F.round(F.get("vec", F.lit(i)).cast("double"), 3).alias(f"v{i + 1}") for i in range(DIMENSIONS)]
    return means.select("doc_id", F.col("n_words").cast("long").alias("n_words"), *parts)


@query(
    f"""WITH raw AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM conversations),
    {SQL_WORDS.strip()},
    keys AS (SELECT conv_id * 1000 + turn AS id FROM conversations),
    sums AS (SELECT conv_id * 1000 + turn AS id, count(*) AS n,
      {", ".join(f"avg(vec[{i}]) AS a{i}" for i in range(1, DIMENSIONS + 1))} FROM raw JOIN vectors USING (word) GROUP BY ALL)
    SELECT id, CAST(coalesce(n, 0) AS BIGINT) AS n_words,
      {", ".join(f"coalesce(round(CAST(CAST(a{i} AS FLOAT) AS DOUBLE), 3), 0) AS v{i}" for i in range(1, DIMENSIONS + 1))}
    FROM keys LEFT JOIN sums USING (id)"""
)
def mean_vectors_of_raw_tokens(spark, folder):
    turns = table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.split("text", " ").alias("tokens")
    )
    means = vectors.mean_vectors(turns, "id", "tokens", word_vectors(spark, folder), DIMENSIONS)
    parts = [F.round(F.get("vec", F.lit(i)).cast("double"), 3).alias(f"v{i + 1}") for i in range(DIMENSIONS)]
    return means.select("id", F.col("n_words").cast("long").alias("n_words"), *parts)

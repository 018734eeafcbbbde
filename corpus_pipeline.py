"""A corpus pipeline: quality, repeated lines, near copies, benchmark leaks, tokens.

Each stage takes what its predecessor kept and returns it with the columns of documents; the last returns token digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovemark.catalog.registry import Entry, table
from grovemark.llm import byte_pairs, leaks, lines, quality, simhash
from grovemark.llm.columns import unused
from grovemark.session import cut


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on all labels, does not reject. Null and empty texts are scored too."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    names = unused(docs, "score", "predicted")
    return quality.score(docs, model, threshold=0.3, names=tuple(names)).filter(F.col(names[1]) == 1).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier line; n_chars follows the text. Null texts stay null."""
    made = lines.dedup_lines(docs, threshold=0.8, min_words=1)
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else made


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: four-word shingles, fingerprints that differ in four bits at most.

    The row with the smallest id stays, then that with the smallest hash of its text. Texts without words are copies of
    each other.
    """
    return simhash.one_of_each(docs, words=4, bits=4)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows that agree in id and text are treated alike."""
    (row,) = unused(docs, "_row")
    named = docs.withColumn(row, F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit(""))))
    found = cut(leaks.find_leaks(named, table(spark, sf_dir, "benchmark"), key=row).select("doc_id"))
    return leaks.remove_leaks(named, found, key=row).drop(row)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text and the bytes that they decode to, as digests."""
    return byte_pairs.digests(docs)


STAGES = [
    ("quality", good_documents),
    ("lines", without_repeated_lines),
    ("near copies", without_near_copies),
    ("leaks", without_leaks),
    ("tokens", tokens),
]
ORACLE_SQL = None  # the fitted classifier and the tokenizer have no SQL form; tests/llm compares with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs


ENTRIES = {"pipeline": Entry(run, ORACLE_SQL)}

"""From labelled articles to a cluster tree and cluster labels."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovemark.functions.text import document_text, tokens
from grovemark.operators.classes import keep_listed
from grovemark.operators.linkage import BLOCK_ROWS, average_linkage, cut_labels
from grovemark.operators.scope import fit_linear_svm
from grovemark.operators.scope import stop_words as words_out_of_scope
from grovemark.operators.vectors import document_words, mean_vectors
from grovemark.session import cut


class Clustering(NamedTuple):
    """labelled: the articles with class_predict; merges: the merge tree."""

    labelled: DataFrame
    merges: DataFrame
    n_leaves: int


def article_vectors(
    articles: DataFrame, key: str, word_vectors: DataFrame, dimensions: int, stop_words: DataFrame | None = None
) -> DataFrame:
    """(key, n_words, vec) of title and abstract, without stop words when they are given."""
    worded = articles.select(key, tokens(document_text(F.col("title"), F.col("abstract"))).alias("tokens"))
    if stop_words is not None:
        worded = keep_listed(worded, key, "tokens", stop_words, keep=False)
    return mean_vectors(worded, key, "tokens", word_vectors, dimensions)


def cluster_corpus(
    articles: DataFrame,
    key: str,
    word_vectors: DataFrame,
    dimensions: int,
    n_clusters: int,
    stop_words: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> Clustering:
    """Average linkage of the articles' mean word vectors, cut into n_clusters."""
    vectors = cut(article_vectors(articles, key, word_vectors, dimensions, stop_words))
    linkage = average_linkage(vectors, key, "vec", block_rows)
    labels = cut_labels(linkage, n_clusters).select(key, F.col("cluster_id").alias("class_predict"))
    return Clustering(articles.join(labels, key), linkage.merges, linkage.n_leaves)


def discover_stop_words(
    annotations: DataFrame,
    articles: DataFrame,
    key: str,
    word_vectors: DataFrame,
    dimensions: int,
    c: float = 0.01,
) -> DataFrame:
    """(word): words of the articles that a classifier trained on annotated token lists puts out of scope.

    annotations(id, tokens, inRel); their tokens are used as they are.
    """
    word_vectors = cut(word_vectors)  # read three times below
    vectors = mean_vectors(annotations, "id", "tokens", word_vectors, dimensions)
    training = vectors.join(annotations.select("id", F.col("inRel").cast("int").alias("label")), "id")
    model = fit_linear_svm(training, "vec", "label", c, tol=1e-6)
    worded = articles.select(key, tokens(document_text(F.col("title"), F.col("abstract"))).alias("tokens"))
    vocabulary = document_words(worded, key, "tokens").select("word").distinct()
    return words_out_of_scope(model, vocabulary, word_vectors)



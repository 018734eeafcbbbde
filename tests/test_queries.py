"""Every query with SQL against DuckDB on the smallest tables; the others must return rows."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert difference(queries()[name](spark, FOLDER), connect(FOLDER), oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ["average_linkage_scores", "bisecting_k_means", "word_scope_stop_words", "annotation_rounds", "scores_by_training_size", "linear_svm_scores"])
def test_returns_rows(spark, name):
    assert queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry(spark).columns == ["hierarchical_f", "plain_f", "ari"] and entry(spark).count() == 1

"""The pipeline stage by stage, and the guard of the entry points."""

import os
import shutil
import subprocess
import sys

from pyspark.sql import functions as F

import corpus_pipeline
from grovemark.session import cut
from tests.llm import fixtures

FOLDER = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"]
    words = [f"term{k}" for k in range(1_000)]
    planted = [
        (5_000, " ".join(words), "en", "s", 0), (5_001, " ".join(words[:70] + ["swapped"] + words[71:]) + ".", "en", "s", 0),
        (5_002, f"Plain words before. {item} Plain words after.", "en", "s", 0), (5_003, None, "en", "s", 0), (None, "", None, None, None),
    ]
    docs = cut(docs.unionByName(spark.createDataFrame(planted, docs.schema)))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        made = cut(stage(spark, docs, FOLDER))
        if name != "tokens":
            assert made.schema.names == docs.schema.names
        assert made.join(docs, "doc_id", "left_anti").filter("doc_id IS NOT NULL").count() == 0
        kept[name], docs = {r["doc_id"] for r in made.select("doc_id").collect()}, made
    assert 5_002 in kept["near copies"] and 5_002 not in kept["leaks"]
    assert kept["leaks"] == kept["tokens"]


def test_near_copies_go(spark):
    words = [f"term{k}" for k in range(1_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:70] + ["x"] + words[71:])), (3, " ".join(reversed(words)))], "doc_id long, text string")
    kept = corpus_pipeline.without_near_copies(spark, docs, FOLDER)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_odd_rows_and_clashing_columns(spark):
    """Every stage takes nulls, repeated rows, very long texts and columns by the names that operators use."""
    names = ("score", "predicted", "_text", "_row", "__row", "_doc", "_kept", "_held", "row", "words", "lines", "node", "Predicted_")
    rows = fixtures.odd(spark).select("doc_id", "text").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.lit(1).cast("long")})
    docs = cut(rows.unionByName(spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id < 40")).withColumns({name: F.lit("x") for name in names}))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = cut(stage(spark, docs, FOLDER))
        assert made.columns == docs.columns, name
        assert made.filter("score <> 'x' OR _row <> 'x' OR _held <> 'x'").count() == 0
        assert 0 < made.count() <= docs.count()
        docs = made
    assert docs.groupBy("doc_id", "text").count().filter("count > 1").count() == 0
    assert corpus_pipeline.tokens(spark, docs, FOLDER).count() == docs.count()


def test_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, FOLDER))
        assert docs.count() == 0


def test_entry_points_without_these_folders(tmp_path):
    """The other queries are there when the folders are not."""
    shutil.copytree(os.path.join(ROOT, "grovemark"), tmp_path / "grovemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; print(sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline'), len(e.queries()) > 80)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert done.stdout.strip() == "[] True", done.stderr

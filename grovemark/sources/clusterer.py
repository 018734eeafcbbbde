"""Output of an external clusterer: phrases with a class index, and the cluster tree as a JSON array."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES_JSON = "array<struct<children: array<int>, filterValue: array<int>>>"


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """phrases(id, tokens, index); index maps a class to the token positions that belong to it."""
    return spark.read.load(path).select("id", "tokens", "index")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """nodes(node_id, children, filter_value); a node is known by its position in the array."""
    array = spark.read.text(path, wholetext=True).select(F.from_json("value", NODES_JSON).alias("nodes"))
    return array.select(F.posexplode("nodes").alias("node_id", "node")).select(
        "node_id", "node.children", F.col("node.filterValue").alias("filter_value")
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(PMID, mesh_ui_diab, prediction) of a flat clustering."""
    return spark.read.parquet(path).select("PMID", "mesh_ui_diab", "prediction")

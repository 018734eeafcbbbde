"""Small documents that hold the cases each operator must define."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string"
ODD = [
    (9001, None), (None, ""), (9002, ""), (9003, "word"), (9004, "ONE\x0btwo"), (9005, "one two"), (9005, "one two"),
    (9006, "é ß 中文 \U0001f600 ½ ² x\x1cy"), (9007, "  \t\n "), (9008, "long " * 20_000), (9009, "a" * 30_000), (None, "one two"),
]


def given(spark, folder="/root/testdata/sf0.001"):
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")


def odd(spark, rows=()):
    """The odd rows with columns that clash with those an operator makes."""
    made = spark.createDataFrame([*ODD, *rows], SCHEMA)
    return made.withColumns({name: F.lit("x") for name in ("score", "ids", "row", "n", "kind", "part", "words")})


def mixed(spark, rows=()):
    return given(spark).unionByName(odd(spark, rows).select("doc_id", "text"))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

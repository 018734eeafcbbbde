"""Word vectors in text form and word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """word_vectors(word, vec): lines of a word and its numbers.

    A header, if there is one, is a line with the number of all other lines and of their numbers; it is skipped. Empty
    lines are skipped too. A line with another number of numbers than the rest is an error.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "").select(F.split(F.rtrim("value"), " ").alias("parts"))
    fields = lines.groupBy((F.size("parts") - 1).alias("dimension")).agg(F.count(F.lit(1)).alias("n"))
    sizes = {row["dimension"]: row["n"] for row in fields.orderBy(F.desc("n"), F.desc("dimension")).limit(2).collect()}
    if not sizes:
        return lines.select(F.get("parts", F.lit(0)).alias("word"), F.lit(None).cast("array<float>").alias("vec"))
    usual, total = next(iter(sizes)), lines.count()
    if total == 2 and 1 in sizes:  # a header and one vector
        usual = max(sizes)
    if total == 1 and 1 in sizes:  # a header that announces no word
        usual = 0
    is_header = (F.size("parts") == 2) & (F.array_join("parts", " ") == F.lit(f"{total - 1} {usual}"))
    message = F.concat(F.lit("not a word vector: "), F.array_join("parts", " "))
    checked = F.when(F.size("parts") == usual + 1, F.col("parts")).otherwise(F.raise_error(message).cast("array<string>"))
    return lines.filter(~is_header).select(checked.alias("parts")).select(
        F.get("parts", F.lit(0)).alias("word"),
        F.transform(F.slice("parts", 2, usual), lambda x: x.cast("float")).alias("vec"),
    )


def write_word_vectors(word_vectors: DataFrame, path: str) -> None:
    """Write part files in word order; the header with the number of words and dimensions opens the first one."""
    counted = word_vectors.agg(
        F.concat_ws(" ", F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).alias("value")
    )
    header = counted.select(F.lit(0).alias("place"), F.lit("").alias("word"), "value")
    lines = word_vectors.select(
        F.lit(1).alias("place"),
        "word",
        F.concat_ws(" ", F.col("word"), F.concat_ws(" ", F.col("vec").cast("array<string>"))).alias("value"),
    )
    ordered = header.unionByName(lines).repartitionByRange("place", "word").sortWithinPartitions("place", "word")
    ordered.select("value").write.mode("overwrite").text(path)


def write_words(words: DataFrame, path: str) -> None:
    words.select(F.col(words.columns[0]).alias("value")).write.mode("overwrite").text(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(word): one word per line, stripped."""
    return spark.read.text(path).select(F.trim("value").alias("word"))

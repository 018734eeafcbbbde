"""The ASCII class vocabulary: records that start with *NEWRECORD and hold MH, MN and UI lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_class_paths(spark: SparkSession, path: str) -> DataFrame:
    """class_paths(ui, mn, heading), one row per tree number of each record."""
    records = spark.read.option("lineSep", "*NEWRECORD").text(path)
    numbers = F.regexp_extract_all("value", F.lit(r"(?m)^MN = (.+?)\s*$"), F.lit(1))
    return (
        records.select(
            F.regexp_extract("value", r"(?m)^UI = (.+?)\s*$", 1).alias("ui"),
            F.explode(numbers).alias("mn"),
            F.regexp_extract("value", r"(?m)^MH = (.+?)\s*$", 1).alias("heading"),
        )
        .filter((F.col("ui") != "") & (F.col("heading") != ""))
    )

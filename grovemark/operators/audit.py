"""Counts that describe a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_audit(df: DataFrame) -> DataFrame:
    """(column, n_null): missing values per column, NaN included, in one pass."""
    def missing(field):
        absent = F.col(field.name).isNull()
        return absent | F.isnan(field.name) if field.dataType.typeName() in ("float", "double") else absent

    counted = df.agg(*[F.count_if(missing(field)).alias(field.name) for field in df.schema])
    return counted.unpivot([], df.columns, "column", "n_null")

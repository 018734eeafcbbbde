"""Which rows are held out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(n))

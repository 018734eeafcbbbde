from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Entry(NamedTuple):
    run: Query
    sql: str | None


def registrar(entries: dict[str, Entry]):
    """A decorator that files a query under its name, with its SQL if there is one."""

    def query(sql: str | None = None):
        def keep(run: Query) -> Query:
            entries[run.__name__] = Entry(run, sql)
            return run

        return keep

    return query


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")

"""Session helpers: cutting lineage and joining on keys that may be very frequent."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A key is called hot when it holds more than 1/HOT_SHARE of all rows and more than HOT_ROWS rows, so at most
# HOT_SHARE keys are hot, and a table with ordinary keys pays nothing.
HOT_SHARE = 1_000
HOT_ROWS = 200_000
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
MAX_BROADCAST_CLASSES = 50_000  # a class row is a few hundred bytes


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the checkpoint folder of the session; only a local master may fall back to a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="grovemark-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def new_path(spark: SparkSession) -> str:
    """A path in the checkpoint folder that nothing uses yet."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the checkpoint folder and continue from there.

    The new frame has no lineage, so a lost executor costs a read and not the rounds before it. Shuffle files of the write go
    when it ends, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = new_path(spark)
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def cut_observed(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """cut(df), and aggregates over its rows, read from the table.

    An Observation would save the read, but a session that has used one cannot ship fitted models to its tasks any more.
    """
    made = cut(df)
    return made, made.agg(*(measure.alias(name) for name, measure in measures.items())).head().asDict()


def hot_hashes(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> list[int]:
    """Hashes of the hot keys of df: never more than HOT_SHARE values."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(F.xxhash64(key).alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    hot = counts.filter((F.col("n") > hot_rows) & (F.col("n") * HOT_SHARE > total))
    return [row["hash"] for row in hot.select("hash").collect()]


def lookup_join(
    big: DataFrame, lookup: DataFrame, key: str, how: str = "inner", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Join big to a lookup with one row per key, where a few keys may hold most rows of big.

    Rows with a hot key meet the at most HOT_SHARE hot lookup rows by broadcast and do not move; the others
    are shuffled. Both inputs are read more than once, so pass tables or checkpointed frames.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    hashes = hot_hashes(big, key, hot_rows)
    if not hashes:
        return big.join(lookup, key, how)
    is_hot = F.coalesce(F.xxhash64(key).isin(hashes) & F.col(key).isNotNull(), F.lit(False))
    hot_lookup = F.broadcast(lookup.filter(is_hot))
    hot_part = big.filter(is_hot).join(hot_lookup, key, how)
    return hot_part.unionByName(big.filter(~is_hot).join(lookup.filter(~is_hot), key, how))


def label_join(big: DataFrame, lookup: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join documents to a lookup with one row per class: broadcast while the classes are few, else lookup_join."""
    if fits(lookup, MAX_BROADCAST_CLASSES):
        return big.join(F.broadcast(lookup), key, how)
    return lookup_join(big, lookup, key, how)


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows; reads no more than one row beyond the bound."""
    return df.select(F.lit(1)).limit(max_rows + 1).count() <= max_rows

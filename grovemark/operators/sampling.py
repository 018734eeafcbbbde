"""Seeded samples, splits and orders that do not depend on partitioning.

Rows are ordered by md5(seed:key). The key must identify a row. To take the first n rows of that order no
sort of the table is needed: a count per hash prefix finds the prefix where the n-th row lies, and only the
rows of that prefix are ranked.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovemark.session import cut

PREFIX_LENGTH = 4  # hexadecimal digits: 65,536 prefixes


def seeded_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _first_by_hash(df: DataFrame, key: str, seed: int, group: Column | None, quota, strict: bool) -> DataFrame:
    """Mark the first quota(group, total) rows of each group in hash order; a null quota takes all.

    Without a group the table is one group; groups are never null. Adds _selected instead of filtering, so that
    a caller can split.
    """
    hashed = df.withColumn("_group", F.lit(0) if group is None else group).withColumn("_hash", seeded_hash(key, seed))
    hashed = hashed.withColumn("_prefix", F.substring("_hash", 1, PREFIX_LENGTH))
    histogram = hashed.groupBy("_group", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_group")
    earlier = whole.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    running = histogram.select(
        "_group",
        "_prefix",
        "_n",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_total"),
    ).withColumn("_quota", quota(F.col("_group"), F.col("_total")))
    reached = (F.col("_before") < F.col("_quota")) & (F.col("_before") + F.col("_n") >= F.col("_quota"))
    cuts = running.groupBy("_group").agg(
        F.max("_quota").alias("_quota"),
        F.max("_total").alias("_total"),
        F.min(F.when(reached, F.col("_prefix"))).alias("_cut"),
        F.min(F.when(reached, F.col("_before"))).alias("_before"),
    )
    if strict:
        message = F.lit("the sample is larger than the table")
        cuts = cuts.withColumn(
            "_quota", F.when(F.col("_quota") > F.col("_total"), F.raise_error(message)).otherwise(F.col("_quota"))
        )
    if group is None:
        found = cuts.select(F.struct("_quota", "_cut", "_before")).scalar()
        placed = hashed.withColumn("_found", found).select("*", "_found.*").drop("_found")
    else:  # one row per group of a caller's literal mapping (or a flag), so no shuffle of the table
        placed = hashed.join(F.broadcast(cuts), "_group")
    at_cut = F.col("_prefix") == F.col("_cut")
    sure = placed.filter(F.col("_cut").isNull() | ~at_cut).withColumn(
        "_selected",
        F.when(F.col("_cut").isNull(), F.col("_quota").isNull() | (F.col("_quota") > 0)).otherwise(
            F.col("_prefix") < F.col("_cut")
        ),
    )
    rank = F.row_number().over(Window.partitionBy("_group").orderBy("_hash", key))
    ranked = placed.filter(at_cut).withColumn("_selected", rank <= F.col("_quota") - F.col("_before"))
    return sure.unionByName(ranked).select(*df.columns, "_selected")


def sample_exact(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows without replacement; fails when the table has fewer."""
    marked = _first_by_hash(df, key, seed, None, lambda group, total: F.lit(n), strict=True)
    return marked.filter("_selected").drop("_selected")


def sample_per_class(
    df: DataFrame, key: str, label: str, quotas: Mapping[str, int | None], seed: int = 0
) -> DataFrame:
    """Up to quotas[c] rows of each listed class, all rows for a quota of None; other classes are left out."""
    listed = df.filter(F.col(label).isin(list(quotas)))

    def quota(group: Column, total: Column) -> Column:
        chosen = F.lit(None).cast("long")
        for value, n in quotas.items():
            if n is not None:
                chosen = F.when(group == F.lit(value), F.lit(n).cast("long")).otherwise(chosen)
        return chosen

    marked = _first_by_hash(listed, key, seed, F.col(label), quota, strict=False)
    return marked.filter("_selected").drop("_selected")


def balanced_subset(df: DataFrame, key: str, positive: Column, n_each: int, seed: int = 0) -> DataFrame:
    """n rows where the flag holds and n rows where it does not (null counts as not)."""
    flag = F.coalesce(positive, F.lit(False))
    marked = _first_by_hash(df, key, seed, flag, lambda group, total: F.lit(n_each), strict=False)
    return marked.filter("_selected").drop("_selected")


def split_train_test(df: DataFrame, key: str, test_share: float, seed: int = 0) -> DataFrame:
    """Add is_test; exactly ceil(n * test_share) rows are test rows."""
    if not 0.0 < test_share < 1.0:
        raise ValueError("test_share must lie between 0 and 1")
    marked = _first_by_hash(
        df, key, seed, None, lambda group, total: F.ceil(total * F.lit(test_share)), strict=False
    )
    return marked.withColumnRenamed("_selected", "is_test")


def bernoulli_sample(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """Each row with the given chance, decided by its hash alone."""
    threshold = f"{min(math.floor(fraction * 16**8), 16**8 - 1):08x}"
    return df.filter(F.substring(seeded_hash(key, seed), 1, 8) < threshold)


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(seeded_hash(key, seed), key)


def dense_ids(df: DataFrame, keys: list[str], name: str, start: int = 0) -> DataFrame:
    """Add ids start, start+1, ... in the order of the keys, without one global window.

    The rows are range partitioned and sorted, written once, and numbered by partition offset.
    """
    slot = F.monotonically_increasing_id()
    ordered = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_slot", slot))
    ordered = ordered.withColumn("_part", F.shiftright("_slot", 33))
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition of the range exchange, so one window task is enough.
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    within = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ordered.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + within + F.lit(start))
        .select(*df.columns, name)
    )

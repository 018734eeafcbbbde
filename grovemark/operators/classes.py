"""Class vocabularies as tables: class_paths(ui, mn, heading), one row per dotted tree number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovemark.functions.labels import in_subtree
from grovemark.session import HOT_ROWS, cut, fits, label_join, lookup_join

# Up to this many listed values are put into the plan as a hashed set; more are joined.
MAX_INLINE_VALUES = 10_000


def subtree(class_paths: DataFrame, root: str) -> DataFrame:
    return class_paths.filter(in_subtree(F.col("mn"), root))


def patch(class_paths: DataFrame, overrides: DataFrame) -> DataFrame:
    """Add the overriding rows; they replace rows with the same tree number."""
    return class_paths.join(overrides, "mn", "left_anti").unionByName(overrides)


def one_path_per_class(class_paths: DataFrame) -> DataFrame:
    """Class to number and heading; of several numbers the last one stays."""
    return class_paths.groupBy("ui").agg(
        F.max("mn").alias("mn"), F.max_by("heading", "mn").alias("heading")
    )


def path_prefixes(class_paths: DataFrame) -> DataFrame:
    """Every tree number with each of its dotted prefixes, itself included."""
    parts = F.split("mn", r"\.")
    return class_paths.select(
        "ui", "mn", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("level")
    ).select("ui", "mn", F.array_join(F.slice(parts, 1, F.col("level")), ".").alias("prefix"))


def class_closure(class_paths: DataFrame) -> DataFrame:
    """(ui, descendant_ui) for every class and each class at or below it, over all its tree numbers."""
    below = path_prefixes(class_paths).select(F.col("ui").alias("descendant_ui"), F.col("prefix").alias("mn"))
    return class_paths.select("ui", "mn").join(below, "mn").select("ui", "descendant_ui").distinct()


def ancestors(class_paths: DataFrame, root_ui: str) -> DataFrame:
    """(ui, ancestors): the proper ancestors of each class, root left out, sorted."""
    proper = (F.col("ui") != F.col("descendant_ui")) & (F.col("ui") != root_ui)
    return (
        class_closure(class_paths)
        .groupBy(F.col("descendant_ui"))
        .agg(F.array_sort(F.collect_set(F.when(proper, F.col("ui")))).alias("ancestors"))
        .withColumnRenamed("descendant_ui", "ui")
    )


def with_ancestors(documents: DataFrame, class_paths: DataFrame, root_ui: str, label: str) -> DataFrame:
    """Add the ancestor list of each document's class; an unknown class gets an empty list."""
    lookup = ancestors(class_paths, root_ui).withColumnRenamed("ui", label)
    nothing = F.array().cast("array<string>")
    return label_join(documents, lookup, label).withColumn("ancestors", F.coalesce("ancestors", nothing))


def with_label_details(documents: DataFrame, class_paths: DataFrame, label: str) -> DataFrame:
    """Add number and heading of each document's class."""
    details = one_path_per_class(class_paths).withColumnRenamed("ui", label)
    return label_join(documents, details, label)


def without_class(documents: DataFrame, label: str, ui: str) -> DataFrame:
    return documents.filter(F.col(label) != ui)


def keep_listed(
    df: DataFrame, key: str, items: str, listed: DataFrame, keep: bool = True, max_inline: int = MAX_INLINE_VALUES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Keep (or drop) the array items found in a one-column table; order and repeats stay, and every row stays a row.

    A null item is in no list: it goes when listed items are kept and stays when they are dropped. A short list becomes a
    hashed set inside the projection; a long one is joined to the exploded items, frequent ones apart from the others.
    Both give the same result. key names the record; rows that share it are rows of their own.
    """
    if items not in df.columns or key not in df.columns:
        raise ValueError(f"{key} and {items} must be columns")
    value = listed.columns[0]
    values = listed.filter(F.col(value).isNotNull()).distinct()
    if fits(values, max_inline):
        inline = [row[0] for row in values.collect()]
        if keep:
            return df.withColumn(items, F.filter(items, lambda x: x.isin(inline)))
        return df.withColumn(items, F.filter(items, lambda x: x.isNull() | ~x.isin(inline)))
    rows = cut(df.withColumn("_row", F.monotonically_increasing_id()))
    exploded = rows.select("_row", F.posexplode(items).alias("_pos", "_item"))
    listing = cut(values.select(F.col(value).alias("_item"), F.lit(True).alias("_listed")))
    marked = lookup_join(exploded, listing, "_item", "left", hot_rows)
    kept = marked.filter(F.coalesce("_listed", F.lit(False)) == F.lit(keep))
    packed = kept.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_pos", "_item"))).alias("_kept"))
    nothing = F.array().cast(df.schema[items].dataType)
    restored = F.coalesce(F.transform("_kept", lambda s: s["_item"]), nothing)
    return rows.join(packed, "_row", "left").withColumn(items, F.when(F.col(items).isNotNull(), restored)).select(*df.columns)


def restrict_headings(articles: DataFrame, key: str, headings: str, wanted: DataFrame) -> DataFrame:
    """Keep the headings of the wanted classes, repeats and order kept; no match gives null."""
    kept = keep_listed(articles, key, headings, wanted.select("ui"))
    return kept.withColumn(headings, F.when(F.size(headings) > 0, F.col(headings)))


def label_frequency(articles: DataFrame, headings: str) -> DataFrame:
    """How often each label occurs over all label lists."""
    return articles.select(F.explode(headings).alias("label")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n")
    )


def class_frequency(documents: DataFrame, label: str) -> DataFrame:
    return documents.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def most_frequent_first(frequency: DataFrame) -> DataFrame:
    return frequency.orderBy(F.desc("n"), "class")

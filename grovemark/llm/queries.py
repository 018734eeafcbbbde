"""The query of each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovemark.catalog.registry import Entry, registrar, table
from grovemark.llm import (
    byte_pairs, languages, leaks, lines, manifest, neighbours, periods, personal, quality, restaurants, ring, simhash, vector_copies,
)
from grovemark.llm.folds import fold

ENTRIES: dict[str, Entry] = {}
query = registrar(ENTRIES)


@query()
def op1_personal(spark, folder):
    return personal.report(table(spark, folder, "documents"))


@query()
def op2_leaks(spark, folder):
    return leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op3_simhash(spark, folder):
    """Four-word shingles, links at 4 or fewer differing bits."""
    found = simhash.near_copies(table(spark, folder, "documents"), words=4, bits=4)
    digits = F.lower(F.lpad(F.hex("f0"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query()
def op4_restaurants(spark, folder):
    return restaurants.score(table(spark, folder, "documents"), fold("doc_id", 7) == 2)


@query()
def op5_ring(spark, folder):
    """Eight shards on a ring without slack, so that the numbers of rows differ by one at most."""
    found = ring.assign(table(spark, folder, "documents"), n_shards=8, vnodes=128, slack=0.0)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query()
def op6_neighbours(spark, folder):
    """Queries are the rows whose vec_id is divisible by 20; all rows are candidates."""
    return neighbours.search(table(spark, folder, "embeddings"), F.col("id") % 20 == 0, k=20)


@query()
def op7_byte_pairs(spark, folder):
    return byte_pairs.digests(table(spark, folder, "documents"))


@query()
def op8_lines(spark, folder):
    return lines.line_report(table(spark, folder, "documents"), min_words=1)


@query()
def op9_quality(spark, folder):
    docs = table(spark, folder, "documents").withColumn("held_out", fold("doc_id", 5) == 0)
    model = quality.train(docs, table(spark, folder, "labels"), fold("doc_id", 5) != 0)
    return quality.score(docs, model, threshold=0.3, keep=["doc_id", "held_out"])


@query()
def op10_languages(spark, folder):
    docs = table(spark, folder, "documents").withColumn("held_out", fold("doc_id", 5) == 0)
    return languages.identify(docs, ~F.col("held_out"), carry=["held_out"])


@query(vector_copies.SQL)
def op11_vector_copies(spark, folder):
    return vector_copies.near_copies(table(spark, folder, "embeddings"), threshold=0.93)


@query(manifest.SQL)
def op12_manifest(spark, folder):
    return manifest.report(table(spark, folder, "documents"))


@query()
def op13_periods(spark, folder):
    """Runs of six words and four periods or more, over texts a tenth of which have repeats laid in."""
    docs = table(spark, folder, "documents").withColumn("text", periods.planted("doc_id", "text"))
    return periods.run_report(periods.periodic_runs(docs))

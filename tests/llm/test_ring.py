"""Shards against a walk round the ring in plain Python."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from grovemark.llm import ring
from tests.llm import fixtures


def walked(spark, docs, n_shards, vnodes, slack):
    """Shards by carrying rows from point to point, in ring order."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.crc32(text.cast("binary")).alias("crc"), (F.octet_length(text) + 1).alias("size"), F.xxhash64("doc_id").alias("at")).collect()
    rows = sorted((r["at"] + 2**63, r["doc_id"] is not None, r["doc_id"] or 0, r["crc"], r["size"], r["doc_id"]) for r in rows)
    points, room = ring.ring_points(spark, n_shards, vnodes), ring.capacities(len(rows), n_shards, slack)
    by_point = defaultdict(list)
    for row in rows:
        by_point[next((k for k, (at, _) in enumerate(points) if at >= row[0]), 0)].append(row)
    last = [r for r in by_point[0] if r[0] > points[-1][0]]
    by_point[0] = [r for r in by_point[0] if r not in last] + last
    out, carried = Counter(), []
    for turn in (0, 1):
        for k, (_, shard) in enumerate(points):
            waiting, carried = carried + (by_point[k] if turn == 0 else []), []
            took = waiting[: room[shard]]
            room[shard] -= len(took)
            carried = waiting[len(took) :]
            out.update((row[5], row[3], shard) for row in took)
    return out


@pytest.mark.parametrize("n_shards, slack", [(8, 0.0), (5, 0.2)])
def test_same_as_a_walk(spark, n_shards, slack):
    docs = fixtures.mixed(spark).cache()
    got = ring.assign(docs, n_shards=n_shards, vnodes=16, slack=slack).collect()
    assert Counter((r["doc_id"], r["text_crc32"], r["shard"]) for r in got) == walked(spark, docs, n_shards, 16, slack)
    slots = defaultdict(list)
    for row in got:
        slots[row["shard"]].append(row["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if slack == 0:
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_sizes_and_other_columns(spark):
    docs = fixtures.odd(spark)
    got = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in ring.assign(docs).collect())
    text = lambda r: (r["text"] or "").encode()
    assert got == Counter((r["doc_id"], len(text(r)) + 1, zlib.crc32(text(r))) for r in docs.collect())
    assert ring.assign(fixtures.empty(spark)).count() == 0


def test_limited_movement(spark):
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    before = {r["doc_id"]: r["shard"] for r in ring.assign(docs, n_shards=8, slack=0.25).collect()}
    after = {r["doc_id"]: r["shard"] for r in ring.assign(docs, n_shards=9, slack=0.25).collect()}
    moved = sum(before[k] != after[k] for k in before)
    assert moved < 1.5 * len(before) / 9

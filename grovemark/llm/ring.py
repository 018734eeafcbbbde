"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns `vnodes` points on a ring of 64-bit hashes. A row belongs to the first point at or after the hash of its
key; if that point's shard is full the row continues clockwise to the next point whose shard has room. Along the ring the
points are visited in order, and a point takes the rows that reach it in ring order; rows that find no room go on, twice
round at most, since all shards together have room for all rows. With `slack` 0 the capacities differ by one row at most
and add up to the number of rows, so the counts of any two shards differ by one at most; a larger slack moves fewer rows.

The ring is cut into cells of equal length; a cell and the arcs in it give units of consecutive rows, whose number is
bounded by cells + points, whatever the data. Only the counts of the units meet the ring's walk: rows are ranked within
units, and a unit's rows go to shards by rank intervals. So no row is moved twice, texts are not shuffled, and no task
holds more than a unit.

Defined cases: rows with a null key lie where the hash of null lies; rows that repeat are rows of their own, ordered by
the hash of the text; a null text has size 1; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovemark.session import cut

CELL_BITS = 14
RING = 2**64


def ring_points(spark, n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every point, in ring order. A shard's points do not depend on the number of shards."""
    ids = spark.range(n_shards).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("v"))
    rows = ids.select("shard", F.xxhash64(F.lit("ring"), "shard", "v").alias("at")).collect()  # n_shards * vnodes rows
    return sorted((row["at"] + RING // 2, row["shard"]) for row in rows)


def capacities(total: int, n_shards: int, slack: float) -> list[int]:
    """How many rows each shard may take: (1 + slack) of its even share, and never less than that share."""
    return [total // n_shards + (k < total % n_shards) + int(slack * total / n_shards) for k in range(n_shards)]


def walk(points: list[tuple[int, int]], counts: dict[int, list[tuple[int, int]]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(unit, first rank, end rank, shard, slot of the first rank) of every interval.

    counts has the (unit, rows) that reach each point first, in ring order. What a full shard refuses is carried on to the
    next point; after the second round nothing is left.
    """
    room, filled = list(room), [0] * len(room)
    out, carried = [], []
    for turn in (0, 1):
        for at, (_, shard) in enumerate(points):
            waiting = carried + [(unit, 0, n) for unit, n in counts.get(at, [])] if turn == 0 else carried
            carried = []
            for unit, low, high in waiting:
                took = min(high - low, room[shard])
                if took:
                    out.append((unit, low, low + took, shard, filled[shard]))
                    room[shard] -= took
                    filled[shard] += took
                if low + took < high:
                    carried.append((unit, low + took, high))
            if turn == 1 and not carried:
                break
    return out


def on_ring(key: Column) -> tuple[Column, Column]:
    """The cell of a key's hash and the hash itself, both in ring order."""
    at = F.xxhash64(key)
    return F.shiftrightunsigned(at.bitwiseXOR(F.lit(-(2**63))), 64 - CELL_BITS).cast("int"), at


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", n_shards: int = 8, vnodes: int = 128, slack: float = 0.0) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): the shard of every row and its place there, gapless from 0."""
    spark = docs.sparkSession
    points = ring_points(spark, n_shards, vnodes)
    width = RING >> CELL_BITS
    # Per cell the points in it, and the first point after it: its rows go to one of these.
    positions = [at for at, _ in points]
    pieces = []
    for cell in range(1 << CELL_BITS):
        low, high = bisect_left(positions, cell * width), bisect_left(positions, (cell + 1) * width)
        ends = [positions[k] - RING // 2 for k in range(low, high)]
        pieces.append((cell, ends, [k % len(points) for k in range(low, high + 1)]))
    cells = spark.createDataFrame(pieces, "cell int, ends array<long>, owners array<int>")
    cell, at = on_ring(F.col(key))
    size = F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col(key).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), cell.alias("cell"), at.alias("at"))
    # cells has 2^CELL_BITS rows, a constant.
    within = F.size(F.filter("ends", lambda end: end < F.col("at")))
    placed = rows.join(F.broadcast(cells), "cell").select(
        "doc_id", "size", "text_crc32", "at", (F.col("cell") * 2048 + within).alias("unit"), F.element_at("owners", within + 1).alias("point")
    )
    placed = cut(placed)
    found = placed.groupBy("unit", "point").agg(F.count("*").alias("n")).orderBy("unit").collect()  # cells + points rows at most
    counts: dict[int, list[tuple[int, int]]] = {}
    for row in found:
        counts.setdefault(row["point"], []).append((row["unit"], row["n"]))
    room = capacities(sum(row["n"] for row in found), n_shards, slack)
    intervals = walk(points, counts, room)
    by_unit: dict[int, list[tuple[int, int, int]]] = {}
    for unit, low, _, shard, slot in sorted(intervals):
        by_unit.setdefault(unit, []).append((low, shard, slot))
    table = spark.createDataFrame(sorted(by_unit.items()), "unit int, parts array<struct<low:long,shard:int,slot:long>>")
    ranked = placed.withColumn(
        "rank", F.expr("row_number() OVER (PARTITION BY unit ORDER BY at, doc_id, text_crc32, size)").cast("long") - 1
    )
    part = F.element_at(F.filter("parts", lambda p: p["low"] <= F.col("rank")), -1)
    chosen = ranked.join(F.broadcast(table), "unit").withColumn("part", part)  # as many rows as units
    return chosen.select(
        "doc_id", "size", "text_crc32", F.col("part.shard").alias("shard"), (F.col("part.slot") + F.col("rank") - F.col("part.low")).alias("slot")
    )

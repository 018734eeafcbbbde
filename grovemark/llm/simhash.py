"""SimHash near-copies by the generalised pigeonhole principle.

Fingerprints link when they differ in at most `bits` of their first 64 bits (and, with a wider fingerprint, in at most
`wide_bits` of all). The 64 bits are dealt into m partitions, bits that vary together side by side, and partition i gets
a threshold t_i of its own (-1: not used) with sum(t_i + 1) = bits + 1. Two linked fingerprints then differ in at most
t_i bits of some partition i: if they differed in t_i + 1 or more of each, they would differ in bits + 1. The thresholds
are chosen by dynamic programming on estimated candidate counts, which come from bit statistics over all fingerprints;
m is the number of partitions for which the best total is smallest. Every distinct fingerprint is filed under its own
value of each partition and probes the values within t_i bits; of two fingerprints only one probes the other. Candidates
are verified on whole fingerprints.

Copies fall together before anything is compared: one row for each distinct fingerprint. A bucket that many fingerprints
share is cut into tiles of bounded size, so no task holds it whole, and a tile gives a spanning star for each of its
connected parts, not its pairs; reachability is the same. Components are then found over these links.

Defined cases: a null text is an empty one; texts without words have fingerprint zero and link like others; texts with
fewer words than a shingle are hashed whole; rows with the same id are rows of their own; null ids are never the smallest
of a group unless all are null; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovemark.llm.byte_pairs import gathered
from grovemark.llm.columns import unused
from grovemark.llm.components import components
from grovemark.session import cut

TILE_ROWS = 2_048  # a bucket with more than twice as many rows is cut into pairs of parts of about this size
SMALL_GROUP = 24
PROBE_COST = 300.0  # of one row to shuffle, in pair comparisons


def shingle_hashes(text: str | None, words: int, seed: int) -> list[int]:
    """XXH64 of every shingle, repeats included."""
    found = (text or "").encode().lower().split()  # bytes: only A-Z are lower-cased, only ASCII white space splits
    if not found:
        return []
    digest = xxhash.xxh64_intdigest
    last = max(1, len(found) - words + 1)
    return [digest(b" ".join(found[k : k + words]), seed) for k in range(last)]


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of hashes the 64-bit number whose bit is set where over half of the run has it; zero if it is empty."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, (np.cumsum(sizes) - sizes)[full], axis=0, dtype=np.int64)
        over = (2 * sums > sizes[full, None]).astype(np.uint8)
        out[full] = np.packbits(over, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def remixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Further independent hashes of shingles from their first hash, by a 64-bit finaliser; k = 0 leaves them."""
    if k == 0:
        return hashes
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * k) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, width: int = 1) -> DataFrame:
    """(doc_id, row, f0, ...): `width` numbers of 64 bits for each document; f0 is from the XXH64 with seed 42."""
    names = [f"f{k}" for k in range(width)]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, count, columns = [], 0, [[np.zeros(0, np.uint64)] for _ in names]

            def close():
                sizes = np.fromiter(map(len, held), np.int64, len(held))
                flat = np.concatenate(held)
                held.clear()
                for k, column in enumerate(columns):
                    column.append(majority_bits(remixed(flat, k), sizes))

            for value in batch.column(2):
                held.append(np.array(shingle_hashes(value.as_py(), words, 42), np.uint64))
                count += len(held[-1])
                if count >= 100_000:  # shingles unpacked at a time
                    close()
                    count = 0
            if held:
                close()
            arrays = [pa.array(np.concatenate(column).view(np.int64)) for column in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["doc_id", "row", *names])

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("row"), body.alias("text"))
    return narrow.mapInArrow(made, "doc_id long, row long, " + ", ".join(f"{name} long" for name in names))


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many have both bit i and bit j set, over all of them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, both = 0, np.zeros((64, 64))
        for batch in batches:
            values = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(values, axis=1, bitorder="little").astype(np.float32)
            rows += len(bits)
            both += bits.T @ bits
        cell = np.arange(64 * 64 + 1)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.append(both.ravel(), rows))], names=["cell", "n"])

    sums = distinct.select("f0").mapInArrow(counted, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n"))
    found = np.zeros(64 * 64 + 1)
    for row in sums.collect():  # 4,097 rows
        found[row["cell"]] = row["n"]
    return int(found[-1]), found[:-1].reshape(64, 64)


def joint_differences(total: int, both: np.ndarray) -> np.ndarray:
    """[i, j, s, t]: the chance that two fingerprints drawn at random differ (1) or not (0) in bit i and in bit j."""
    ones = np.diag(both) / total
    p11 = both / total
    p = np.empty((64, 64, 2, 2))
    p[:, :, 1, 1], p[:, :, 1, 0], p[:, :, 0, 1] = p11, ones[:, None] - p11, ones[None, :] - p11
    p[:, :, 0, 0] = 1 - p[:, :, 1, 1] - p[:, :, 1, 0] - p[:, :, 0, 1]
    out = np.empty_like(p)
    for s in (0, 1):
        for t in (0, 1):
            out[:, :, s, t] = sum(p[:, :, x, y] * p[:, :, x ^ s, y ^ t] for x in (0, 1) for y in (0, 1))
    return np.clip(out, 1e-12, 1)


def correlated_groups(both: np.ndarray, total: int, m: int) -> list[list[int]]:
    """The bits in m groups of nearly equal size, each grown by the bit that goes most with those in it."""
    ones = np.diag(both) / total
    spread = np.sqrt(np.maximum(ones * (1 - ones), 1e-9))
    tie = np.abs(both / total - np.outer(ones, ones)) / np.outer(spread, spread)
    free, groups = list(range(64)), []
    for k in range(m):
        size = 64 // m + (k < 64 % m)
        group = [max(free, key=lambda b: (sum(tie[b, c] for c in free if c != b), -b))]
        free.remove(group[0])
        while len(group) < size:
            group.append(max(free, key=lambda b: (max(tie[b, c] for c in group), -b)))
            free.remove(group[-1])
        groups.append(group)
    return groups


def chances_within(group: list[int], joint: np.ndarray, most: int) -> np.ndarray:
    """The chance of a difference in at most 0, 1, ... `most` bits of a group, along a chain of its bits."""
    first = joint[group[0], group[0]]
    state = np.zeros((2, most + 2))
    state[0, 0], state[1, 1] = first[0, 0], first[1, 1]
    for a, b in zip(group, group[1:]):
        step = joint[a, b] / joint[a, b].sum(axis=1, keepdims=True)
        after = np.zeros_like(state)
        after[0] = state[0] * step[0, 0] + state[1] * step[1, 0]
        after[1, 1:] = (state[0] * step[0, 1] + state[1] * step[1, 1])[:-1]
        state = after
    return np.cumsum(state.sum(axis=0))[: most + 1]


def allotted(costs: np.ndarray, spend: int) -> tuple[float, list[int]]:
    """Thresholds with the least total cost, where costs[i, t + 1] is that of threshold t and sum(t + 1) = spend."""
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(math.inf, [])] * spend
    for row in costs:
        best = [
            min(((best[s - u][0] + row[u], [*best[s - u][1], u - 1]) for u in range(min(s, len(row) - 1) + 1)), key=lambda x: x[0])
            for s in range(spend + 1)
        ]
    return best[spend]


def partition_plan(total: int, both: np.ndarray, bits: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition in use."""
    joint, choices = joint_differences(total, both), []
    for m in range(1, bits + 2):
        groups = correlated_groups(both, total, m)
        most = min(bits, 3)
        costs = np.zeros((m, most + 2))
        for i, group in enumerate(groups):
            within = chances_within(group, joint, most)
            for t in range(most + 1):
                probes = 1 + sum(math.comb(len(group), k) for k in range(1, t + 1)) / 2
                costs[i, t + 1] = PROBE_COST * total * probes + total * total / 2 * within[t]
        cost, thresholds = allotted(costs, bits + 1)
        choices.append((cost, [(g, t) for g, t in zip(groups, thresholds) if t >= 0]))
    return min(choices, key=lambda x: x[0])[1]


def signed(number: int) -> int:
    return number - 2**64 if number >= 2**63 else number


def bucket_entries(distinct: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """distinct with a row (part, key, own) for each bucket where a fingerprint is filed (own) or probes."""
    ways = []
    for part, (group, threshold) in enumerate(plan):
        mask = sum(1 << b for b in group)
        for k in range(threshold + 1):
            for flips in combinations(sorted(group), k):
                ways.append((part, signed(mask), signed(sum(1 << b for b in flips)), signed(1 << flips[-1] if flips else 0)))
    # As many ways as the plan has masks: a few dozen or hundred, whatever the data.
    fields = (("part", "int"), ("mask", "long"), ("flip", "long"), ("top", "long"))
    inline = F.array(*(F.struct(*(F.lit(x).cast(t).alias(n) for x, (n, t) in zip(way, fields))) for way in ways))
    filed = distinct.select("*", F.explode(inline).alias("way")).filter("(f0 & way.top) = 0")
    return filed.select(
        *distinct.columns,
        F.col("way.part").alias("part"),
        F.expr("(f0 & way.mask) ^ way.flip").alias("key"),
        F.expr("way.flip = 0").alias("own"),
    )


def tiled(entries: DataFrame) -> DataFrame:
    """entries with the column tile; rows of a bucket with too many of them are copied to all pairs of parts they are in."""
    counts = entries.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * TILE_ROWS)
    large = cut(counts.select("part", "key", F.ceil(F.col("n") / TILE_ROWS).cast("long").alias("parts")))
    if large.isEmpty():
        return entries.withColumn("tile", F.lit(0).cast("long"))
    joined = entries.join(large, ["part", "key"], "left")
    place = F.expr("pmod(xxhash64(f0), parts)")
    tiles = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
            lambda other: F.least(other, place) * F.col("parts") + F.greatest(other, place),
        )
    )
    return joined.withColumn("tile", F.explode(tiles)).drop("parts")


def star_labels(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of `size` nodes the smallest node it is connected with by the pairs (a, b)."""
    label = np.arange(size)
    while len(a):
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        after = after[after]
        if np.array_equal(after, label):
            break
        label = after
    while not np.array_equal(label, label[label]):
        label = label[label]
    return label


def linked(values: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int, wide_bits: int) -> np.ndarray:
    """Which pairs of rows of values (f0, f1, ...) are links."""
    near = np.bitwise_count(values[0][a] ^ values[0][b]).astype(np.int64)
    keep = near <= bits
    if len(values) > 1:
        rest = np.flatnonzero(keep)
        for column in values[1:]:
            near[rest] += np.bitwise_count(column[a[rest]] ^ column[b[rest]])
        keep[rest] = near[rest] <= wide_bits
    return keep


def bucket_links(batches: Iterator[pa.RecordBatch], bits: int, wide_bits: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of sorted bucket entries. What is kept between batches is one bucket or tile, whose size is bounded."""

    def groups(columns: list[np.ndarray], whole: bool):
        """(start, end) of each group that is complete, and where the rest begins."""
        part, key, tile = columns[:3]
        change = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1
        starts = np.concatenate(([0], change))
        ends = np.append(change, len(part))
        return (starts, ends, len(part)) if whole else (starts[:-1], ends[:-1], starts[-1])

    def found(columns: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
        own, node, values = columns[3], columns[4], [c.view(np.uint64) for c in columns[5:]]
        sizes = ends - starts
        small = (sizes > 1) & (sizes <= SMALL_GROUP)
        if small.any():
            rows = gathered(starts[small], sizes[small])
            later = np.repeat(ends[small], sizes[small]) - 1 - rows
            a = np.repeat(rows, later)
            b = gathered(rows + 1, later)
            keep = own[a] | own[b]
            a, b = a[keep], b[keep]
            keep = linked(values, a, b, bits, wide_bits)
            yield np.stack([node[a[keep]], node[b[keep]]])
        for start, end in zip(starts[sizes > SMALL_GROUP], ends[sizes > SMALL_GROUP]):
            filed = start + np.flatnonzero(own[start:end])
            pairs = []
            for k in range(0, len(filed), 256):
                near = np.bitwise_count(values[0][filed[k : k + 256], None] ^ values[0][None, start:end]) <= bits
                a, b = np.nonzero(near)
                a, b = filed[k + a], start + b
                keep = (a != b) & linked(values, a, b, bits, wide_bits)
                pairs.append(np.stack([a[keep], b[keep]]) - start)
            if pairs:
                a, b = np.concatenate(pairs, axis=1)
                label = star_labels(end - start, a, b)
                moved = np.flatnonzero(label != np.arange(end - start))
                yield np.stack([node[start + moved], node[start + label[moved]]])

    rest = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        columns = [np.concatenate(pair) for pair in zip(rest, columns)] if rest else columns
        if not len(columns[0]):
            continue
        starts, ends, split = groups(columns, False)
        for a, b in found(columns, starts, ends):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        rest = [c[split:].copy() for c in columns]
    if rest:
        starts, ends, _ = groups(rest, True)
        for a, b in found(rest, starts, ends):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def fingerprint_links(distinct: DataFrame, bits: int = 4, wide_bits: int = 256) -> DataFrame:
    """Links (a, b) between nodes that give the components of all links; distinct has the columns node, f0, f1, ..."""
    total, both = bit_statistics(distinct)
    if total < 2:
        return distinct.sparkSession.createDataFrame([], "a long, b long")
    entries = tiled(bucket_entries(distinct, partition_plan(total, both, bits)))
    dealt = entries.repartition("part", "key", "tile").sortWithinPartitions("part", "key", "tile")
    ordered = dealt.select("part", "key", "tile", "own", *distinct.columns)
    return ordered.mapInArrow(lambda batches: bucket_links(batches, bits, wide_bits), "a long, b long")


def near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, bits: int = 4, width: int = 1, wide_bits: int = 256
) -> DataFrame:
    """(doc_id, row, f0, component, component_id): component_id is the smallest doc_id that links reach.

    With width > 1 a link also needs at most wide_bits differing bits in all 64 * width. component is never null and tells
    components apart; row is the hash of the text.
    """
    names = [f"f{k}" for k in range(width)]
    node = F.col("f0") if width == 1 else F.xxhash64(*names)
    made = cut(fingerprints(docs, key, text, words, width).withColumn("node", node))
    distinct = cut(made.groupBy("node", *names).agg(F.min("doc_id").alias("least")))
    links = fingerprint_links(distinct.select("node", *names), bits, wide_bits)
    roots = components(cut(links.distinct()))
    nodes = distinct.select("node", "least").join(roots, "node", "left").withColumn("component", F.coalesce("root", "node"))
    nodes = cut(nodes.drop("root"))
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "component").select("node", "component", "component_id")
    return made.join(named, "node").select("doc_id", "row", "f0", "component", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """docs without near copies: of each component the row with the smallest id stays, then the smallest hash of its text."""
    doc, row = unused(docs, "_doc", "_row")
    found = near_copies(docs, key, text, words, bits)
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("stays"))
    stays = cut(first.select(F.col("stays.doc_id").alias(doc), F.col("stays.row").alias(row)))
    hashed = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    kept = docs.join(stays, F.col(key).cast("long").eqNullSafe(F.col(doc)) & (hashed == F.col(row)), "left_semi")
    # Rows that agree in id and text are copies of each other too.
    again = kept.groupBy(F.col(key).cast("long"), hashed).count().filter("count > 1")
    if again.isEmpty():
        return kept
    return kept.withColumn(row, hashed).dropDuplicates([key, row]).drop(row)

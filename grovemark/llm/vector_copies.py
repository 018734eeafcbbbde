"""Near-copies among vectors by random-hyperplane signs, exact cosines and connected components.

Vectors with the same label and length are compared. Equal vectors fall together first: one node stands for each distinct
vector of a label, with the number of its copies. A table hashes a node to the signs of its products with some random
directions; nodes with the same signs share a bucket. Two vectors at angle a agree in a sign with chance 1 - a / pi, so
the number of tables follows from the number of signs and the wished recall at the threshold itself; nearer pairs are
found more surely. The number of signs follows from the largest label: twice the vectors, one sign more, and so more
tables; what a bucket of unrelated vectors holds stays the same.

Every pair in a bucket is verified by its cosine in double precision. Pairs are never written: a bucket gives for each of its nodes how
many copies it links with, and the smallest node it reaches there. A pair that shares several buckets is counted in the
first of its tables only, which each node's signs tell. A bucket with too many nodes is cut into parts, and the pairs of
parts are compared as tiles of bounded size, so no task holds it whole. Components follow from the links of nodes to the
smallest node they reach, over all tables.

Defined cases: vectors that are null, empty, zero or that hold a null or a number that is not finite link with nothing, nor
do rows with a null label; vectors of different lengths do not link; equal vectors link at any threshold up to one; rows
that repeat an id are rows of their own and link with each other; a null id is never the smallest unless all are null, and
such a row is kept where its component_id is null too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovemark.llm.components import components
from grovemark.operators.sampling import dense_ids
from grovemark.session import cut, label_join, lookup_join

BUCKET_ROWS = 32  # unrelated vectors that a bucket holds, on the whole, in the largest label
TILE_ROWS = 2_048  # a bucket with more than twice as many nodes is cut into parts of about this size
STRIP = 256  # rows of a bucket compared with all its rows at a time
NODE_SCHEMA = "node long, family long, copies long, v array<{kind}>, signs array<int>"
FOUND_SCHEMA = "node long, n long, root long"


def tables_for(threshold: float, signs: int, recall: float) -> int:
    """How many tables find a pair right at the threshold with chance `recall`."""
    agree = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** signs
    return 1 if agree >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def signs_for(largest: int) -> int:
    return min(28, max(4, math.ceil(math.log2(max(1, largest) / BUCKET_ROWS))))


def directions(width: int, n: int, seed: int) -> np.ndarray:
    """The same for every task: one direction a column."""
    return np.random.default_rng([seed, width]).standard_normal((width, n))


def units(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column of one length as unit vectors in double precision."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), width)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.sqrt(np.add.reduce(x * x, axis=1))[:, None]


def with_signs(nodes: DataFrame, kind: str, signs: int, tables: int, seed: int) -> DataFrame:
    """nodes (node, family, copies, v) with the signs of each table as a number."""
    weights = 1 << np.arange(signs)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = np.asarray(batch.column(3).value_lengths())
            for width in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == width))
                if width not in drawn:
                    drawn[width] = directions(width, signs * tables, seed)
                for k in range(0, part.num_rows, 4_096):
                    rows = part.slice(k, 4_096)
                    positive = units(rows.column(3), width) @ drawn[width] > 0
                    numbers = positive.reshape(rows.num_rows, tables, signs) @ weights
                    lists = pa.ListArray.from_arrays(np.arange(0, numbers.size + 1, tables, dtype=np.int32), pa.array(numbers.ravel().astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([*rows.columns, lists], names=["node", "family", "copies", "v", "signs"])

    return nodes.select("node", "family", "copies", "v").mapInArrow(made, NODE_SCHEMA.format(kind=kind))


def bucket_rows(signed: DataFrame) -> DataFrame:
    """signed with a row (at, value, tile, part) for each tile of a shared bucket; nodes alone in a bucket have none there.

    Buckets are counted without the vectors, which then move once for each tile.
    """
    places = signed.select("node", "family", F.posexplode("signs").alias("at", "value"))
    counts = places.groupBy("family", "at", "value").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.when(F.col("n") > 2 * TILE_ROWS, F.ceil(F.col("n") / TILE_ROWS)).otherwise(1).cast("int")
    shared = places.join(counts.withColumn("parts", parts).drop("n"), ["family", "at", "value"])
    by_node = shared.groupBy("node").agg(F.collect_list(F.struct("at", "value", "parts")).alias("buckets"))  # one entry a table at most
    filed = signed.join(by_node, "node").select(*signed.columns, F.explode("buckets").alias("bucket")).select(*signed.columns, "bucket.*")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.least(other, F.col("part")) * F.col("parts") + F.greatest(other, F.col("part")))
    return filed.withColumn("part", part).withColumn("tile", F.explode(tiles)).withColumn("within", F.expr("tile div parts = tile % parts"))


def smallest_reached(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of `size` rows the smallest row that the pairs (a, b) lead to."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        after = after[after]
        if np.array_equal(after, label):
            return label
        label = after


def tile_links(node: np.ndarray, copies: np.ndarray, part: np.ndarray, x: np.ndarray, signs: np.ndarray, at: int, within: bool, threshold: float):
    """(node, n, root) of the rows of one tile that link with another one there.

    n counts the copies linked with by pairs that no earlier table than `at` brings together, in pairs of this tile only:
    all pairs of one part (within), or pairs of two parts. root is the smallest row reached over all links of the tile.
    """
    size = len(node)
    counted, heads, tails = np.zeros(size), [], []
    order = np.argsort(node, kind="stable")
    node, copies, part, x, signs = node[order], copies[order], part[order], x[order], signs[order, :at]
    for first in range(0, size, STRIP):
        near = x[first : first + STRIP] @ x[first:].T
        a, b = np.nonzero(near >= threshold - 1e-9)
        cosine = near[a, b]
        a, b = a + first, b + first
        keep = a < b
        if not within:
            keep &= part[a] != part[b]
        a, b, cosine = a[keep], b[keep], cosine[keep]
        border = cosine < threshold + 1e-9
        if border.any():  # products of whole blocks may round otherwise than a sum over the pair
            sure = np.add.reduce(x[a[border]] * x[b[border]], axis=1) >= threshold
            keep = ~border
            keep[border] = sure
            a, b = a[keep], b[keep]
        if not len(a):
            continue
        first_met = np.ones(len(a), bool)
        for k in range(at):
            first_met &= signs[a, k] != signs[b, k]
        counted += np.bincount(a[first_met], copies[b[first_met]], size) + np.bincount(b[first_met], copies[a[first_met]], size)
        label = smallest_reached(size, a, b)  # a spanning star of the strip stands for its links
        moved = np.flatnonzero(label != np.arange(size))
        heads.append(moved)
        tails.append(label[moved])
    if not heads:
        return None
    root = smallest_reached(size, np.concatenate(heads), np.concatenate(tails))
    linked = np.zeros(size, bool)
    linked[np.concatenate(heads)] = linked[np.concatenate(tails)] = True
    return node[linked], counted[linked].astype(np.int64), node[root[linked]]


def found_links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows of buckets, sorted by tile, to (node, n, root). Only one tile is kept between batches, and its size is bounded."""

    def closed(rows: pa.Table, ends: list[int]) -> Iterator[pa.RecordBatch]:
        start, made = 0, []
        numbers = {name: rows[name].to_numpy() for name in ("node", "copies", "part", "at", "within")}
        v, signs = rows["v"].combine_chunks(), rows["signs"].combine_chunks()
        for end in ends:
            if end - start > 1:
                width, tables = len(v[start]), len(signs[start])
                x = units(v.slice(start, end - start), width)
                code = np.asarray(signs.slice(start, end - start).flatten()).reshape(-1, tables)
                part = {name: column[start:end] for name, column in numbers.items()}
                found = tile_links(part["node"], part["copies"], part["part"], x, code, int(part["at"][0]), bool(part["within"][0]), threshold)
                if found:
                    made.append(found)
            start = end
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made)], names=["node", "n", "root"])

    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]) if rest is not None else rows
        if not rows.num_rows:
            continue
        keys = [rows[name].to_numpy() for name in ("family", "at", "value", "tile")]
        ends = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        if len(ends):
            yield from closed(rows, ends.tolist())
        rest = rows.slice(ends[-1] if len(ends) else 0)
    if rest is not None and rest.num_rows:
        yield from closed(rest, [rest.num_rows])


def usable(vector: str):
    """Whether a vector takes part, as a condition; kind is the type of its numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_copies(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, recall: float = 0.9999, seed: int = 17
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): the vectors linked with each, and the smallest id that links reach."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0 and at most 1")
    kind = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
    v = F.col(vector).cast(f"array<{kind}>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), v.alias("v"))
    taking = F.col("label").isNotNull() & usable("v")
    rows = cut(rows.select("vec_id", F.when(taking, F.struct("label", "v")).alias("u")))
    groups = rows.filter("u IS NOT NULL").groupBy("u").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    groups = cut(dense_ids(groups, ["u"], "node").withColumn("g", F.struct("u.label", F.size("u.v").alias("width"))))
    sizes = cut(groups.groupBy("g").agg(F.count("*").alias("nodes")))
    largest = sizes.agg(F.max("nodes")).scalar()
    families = cut(dense_ids(sizes.select("g"), ["g"], "family"))
    nodes = label_join(groups, families, "g", "inner").select("node", "family", "copies", F.col("u.v").alias("v"))
    signs = signs_for(sizes.select(largest.alias("n")).head()["n"]) if not sizes.isEmpty() else 4
    signed = cut(with_signs(nodes, kind, signs, tables_for(threshold, signs, recall), seed))
    keys = ["family", "at", "value", "tile"]
    dealt = bucket_rows(signed).repartition(*keys).sortWithinPartitions(*keys).select(*keys, "within", "part", "node", "copies", "v", "signs")
    found = cut(dealt.mapInArrow(lambda batches: found_links(batches, threshold), FOUND_SCHEMA))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    named = groups.join(counts, "node", "left").join(roots, "node", "left")
    named = cut(named.select("u", "copies", "least", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "node").alias("component")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(named.join(least, "component").select("u", (F.col("copies") - 1 + F.col("n")).alias("n_links"), "component_id"))
    reached = lookup_join(rows, named, "u", "left")
    component = F.when(F.col("u").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return reached.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )


SQL = """WITH RECURSIVE wide AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL),
pairs AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM wide a JOIN wide b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) BETWEEN 0.93 AND 2),
reached(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM reached r JOIN pairs p ON r.b = p.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a),
links AS (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN links USING (vec_id)"""

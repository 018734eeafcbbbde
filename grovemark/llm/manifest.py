"""A Merkle manifest of a table as postorder append logs.

Every row is a leaf. The leaves of a language, in the order of ids, form a tree: every 8 consecutive nodes (the last run
may have fewer, even one) become their digest, until one node is left, the subroot. The subroots, in the order of languages, form a
tree in the same way; its last node is the root.

A tree is written as a log in the order in which its nodes are complete, which is postorder: a node stands right after the
last node below it. Where the last leaf below a node at height h is the leaf L, the node stands at
L + sum over k >= 1 of floor(L / 8^k) + h: so many leaves and complete subtrees come before. Places follow from sizes
alone, so builders work side by side: each takes an aligned block of 8^4 leaves, appends its nodes in completion order, and knows
where its piece begins in the log. The nodes that the blocks end in are the leaves of the next layer, whose builders do the
same, until one node is left in each tree. A task holds one block.

A proof of a leaf is the siblings on its way up. Proofs are taken from the pieces by the same places, from the top layer
down: each block gets the way from its own root upwards from the layer above, once, and adds the siblings within the block.

Defined cases: a null value is written `-`, other than the empty text `0:`; null languages come first, null ids come first
in their language; rows that agree in id are ordered by their digests, and rows that agree in all columns are leaves of
their own; a row with a null id is never tampered with; a lone leaf is its subroot, and the proof is then that of the
subroot; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovemark.operators.sampling import dense_ids
from grovemark.session import cut, label_join, lookup_join

FANOUT = 8
HEIGHT = 4  # of a block: a builder holds 8^4 leaves and the nodes above them
WIDTH = 32  # bytes of a digest
PIECE_SCHEMA = "tree long, block long, first long, width long, height int, nodes binary"
WAY_SCHEMA = "tree long, block long, places array<int>, siblings array<binary>"


def digest_of(parts: bytes) -> bytes:
    """sha256 over digests as hexadecimal text, one after the other."""
    return hashlib.sha256(parts.hex().encode()).digest()


def postorder_place(leaf: int, height: int = 0) -> int:
    """Where a node at `height` stands in the log if `leaf` is the last leaf below it."""
    place = leaf + height
    while leaf := leaf // FANOUT:
        place += leaf
    return place


def node_place(height: int, index: int, width: int, top: int) -> int:
    """Where the index-th node of a height stands among the nodes of `width` leaves, which are built up to `top`."""
    leaf = min((index + 1) * FANOUT**height, width) - 1
    return leaf + sum(leaf // FANOUT**k for k in range(1, top + 1)) + height


def levels_of(width: int) -> int:
    """The height at which `width` nodes have become one."""
    height = 0
    while width > 1:
        width, height = -(-width // FANOUT), height + 1
    return height


def append_nodes(leaves: Iterator[bytes], width: int, top: int) -> bytes:
    """The log of `width` leaves up to height `top`: a node is appended as soon as all nodes below it are there."""
    log, open_runs = bytearray(), [bytearray() for _ in range(top)]
    for leaf, node in enumerate(leaves, 1):
        log += node
        for height in range(top):
            open_runs[height] += node
            last = leaf == width
            if not last and leaf % FANOUT ** (height + 1):
                break
            node = digest_of(bytes(open_runs[height]))
            open_runs[height].clear()
            log += node
    return bytes(log)


def node_at(nodes: memoryview, place: int) -> bytes:
    return bytes(nodes[place * WIDTH : (place + 1) * WIDTH])


def siblings_within(nodes: memoryview, leaf: int, width: int, top: int) -> tuple[list[int], list[bytes]]:
    """For each height the place of the leaf's node in its run and the other nodes of the run."""
    places, others = [], []
    for height in range(top):
        index, count = leaf // FANOUT**height, -(-width // FANOUT**height)
        first = index - index % FANOUT
        run = range(first, min(first + FANOUT, count))
        places.append(index - first)
        others.append(b"".join(node_at(nodes, node_place(height, k, width, top)) for k in run if k != index))
    return places, others


def folded(node: bytes, places: list[int], others: list[bytes]) -> bytes:
    """The root that a node and the siblings on its way give."""
    for place, rest in zip(places, others):
        node = digest_of(rest[: place * WIDTH] + node + rest[place * WIDTH :])
    return node


class Layer(NamedTuple):
    """nodes(tree, n, i, node): what is built on, n nodes in each tree; pieces(tree, block, first, width, height, nodes)."""

    nodes: DataFrame
    pieces: DataFrame


class Manifest(NamedTuple):
    """leaves(doc_id, tree, n, i, leaf, tampered), trees(lang, tree, n, subroot), the layers of the trees of languages and
    of the tree over their subroots, and the root(root)."""

    leaves: DataFrame
    trees: DataFrame
    layers: list[Layer]
    top_layers: list[Layer]
    root: DataFrame


def value_text(column: str) -> Column:
    value = F.col(column).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(doc_id: str, source: str, lang: str, n_chars: str, text: Column) -> Column:
    text = F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*map(value_text, (doc_id, source, lang, n_chars)), text).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def layer_of(nodes: DataFrame) -> Layer:
    """Build the aligned blocks of nodes(tree, n, i, node), side by side; a table of pieces."""

    def built(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        tree, block, n = (table[c][0].as_py() for c in ("tree", "block", "n"))
        width = table.num_rows
        top = HEIGHT if n > FANOUT**HEIGHT else levels_of(n)
        log = append_nodes((x.as_py() for x in table["node"]), width, top)
        row = {"tree": [tree], "block": [block], "first": [postorder_place(block * FANOUT**HEIGHT)], "width": [width], "height": [top], "nodes": [log]}
        kinds = {"height": pa.int32(), "nodes": pa.binary()}
        return pa.table({name: pa.array(value, kinds.get(name, pa.int64())) for name, value in row.items()})

    block = F.expr(f"i div {FANOUT**HEIGHT}")
    return Layer(nodes, cut(nodes.withColumn("block", block).groupBy("tree", "block").applyInArrow(built, PIECE_SCHEMA)))


def layers_of(nodes: DataFrame) -> tuple[list[Layer], DataFrame]:
    """The layers over nodes(tree, n, i, node), and (tree, node) with the last node of each tree.

    A layer has a 4,096th of the nodes of the one below it, and only trees that are not one node yet.
    """
    layers, done = [], []
    while True:
        done.append(nodes.filter("n = 1").select("tree", "node"))
        nodes = nodes.filter("n > 1")
        if nodes.isEmpty():
            roots = done[0]
            for part in done[1:]:
                roots = roots.union(part)
            return layers, cut(roots)
        layers.append(layer_of(nodes))
        ended = F.expr(f"substring(nodes, length(nodes) - {WIDTH - 1}, {WIDTH})")
        counts = nodes.select("tree", "n").groupBy("tree").agg(F.ceil(F.first("n") / FANOUT**HEIGHT).cast("long").alias("n"))
        nodes = cut(label_join(layers[-1].pieces.select("tree", F.col("block").alias("i"), ended.alias("node")), counts, "tree", "inner").select("tree", "n", "i", "node"))


def build(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", text: str = "text") -> Manifest:
    """The manifest of docs. Digests are made where the texts lie; only digests, ids and languages move."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    changed = F.coalesce(crc % 3 == 0, F.lit(False))
    tampered = F.when(changed, leaf_digest(doc_id, source, lang, n_chars, lower_ascii(F.col(text).cast("string"))))
    # The key orders null first and then by bytes.
    named = F.when(F.col(lang).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(lang).cast("string")))
    leaves = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), named.alias("key"),
        F.unhex(leaf_digest(doc_id, source, lang, n_chars, F.col(text).cast("string"))).alias("leaf"), F.unhex(tampered).alias("tampered"),
    )
    placed = cut(dense_ids(leaves, ["key", "doc_id", "leaf"], "slot"))
    counted = placed.groupBy("key").agg(F.min("slot").alias("start"), F.count("*").alias("n"))
    trees = cut(dense_ids(counted, ["key"], "tree"))
    placed = label_join(placed, trees, "key", "inner").select("doc_id", "tree", "n", (F.col("slot") - F.col("start")).alias("i"), "leaf", "tampered")
    placed = cut(placed)
    layers, subroots = layers_of(placed.select("tree", "n", "i", F.col("leaf").alias("node")))
    trees = cut(trees.join(subroots, "tree").select(F.expr("nullif(key, '')").alias("key"), "tree", "n", F.col("node").alias("subroot")))
    n_trees = trees.count()
    top = trees.select(F.lit(0).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), F.col("tree").alias("i"), F.col("subroot").alias("node"))
    top_layers, root = layers_of(top)
    named = trees.select(F.expr("substring(key, 2)").alias("lang"), "tree", "n", "subroot")
    return Manifest(placed, named, layers, top_layers, root.select(F.col("node").alias("root")))


def tree_log(layers: list[Layer], leaves: DataFrame) -> DataFrame:
    """(tree, place, height, node): the logs of trees, from their pieces; leaves(tree, n) has the size of each tree."""
    parts = []
    for depth, layer in enumerate(layers):
        sizes = leaves.select("tree", F.col("n").alias("n_leaves")).distinct()

        def read(batches: Iterator[pa.RecordBatch], depth: int = depth) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                    trees, places, heights, nodes = [], [], [], []
                    for height in range(0 if depth == 0 else 1, row["height"] + 1):  # the leaves of a layer end pieces below it
                        for k in range(-(-row["width"] // FANOUT**height)):
                            level = height + HEIGHT * depth
                            index = row["block"] * FANOUT ** (HEIGHT - height) + k
                            trees.append(row["tree"])
                            places.append(postorder_place(min((index + 1) * FANOUT**level, row["n_leaves"]) - 1, level))
                            heights.append(level)
                            at = node_place(height, k, row["width"], row["height"])
                            nodes.append(row["nodes"][at * WIDTH : (at + 1) * WIDTH])
                    yield pa.RecordBatch.from_pydict({"tree": pa.array(trees, pa.int64()), "place": pa.array(places, pa.int64()), "height": pa.array(heights, pa.int32()), "node": pa.array(nodes, pa.binary())})

        parts.append(label_join(layer.pieces, sizes, "tree", "inner").mapInArrow(read, "tree long, place long, height int, node binary"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def with_lone_blocks(above: DataFrame, of_trees: DataFrame) -> DataFrame:
    """above (tree, block, places, siblings) with a row for each tree that has none: it ended below, in one block."""
    rest = of_trees.join(above.select("tree").distinct(), "tree", "left_anti")
    return above.unionByName(rest.withColumn("block", F.lit(0).cast("long")))


def ways(layers: list[Layer], of_trees: DataFrame) -> DataFrame:
    """(tree, block, places, siblings): the way up of each block below the layers, where a block is a leaf of the lowest of
    them; of_trees(tree, places, siblings) has the ways above the trees themselves. Trees that ended below have one block.
    """
    above = of_trees.withColumn("block", F.lit(0).cast("long"))
    kinds = [("tree", pa.int64()), ("block", pa.int64()), ("places", pa.list_(pa.int32())), ("siblings", pa.list_(pa.binary()))]

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):  # a piece is one block
                nodes, found = memoryview(row["nodes"]), []
                for leaf in range(row["width"]):
                    places, others = siblings_within(nodes, leaf, row["width"], row["height"])
                    found.append((row["tree"], row["block"] * FANOUT**HEIGHT + leaf, places + row["places"], others + row["siblings"]))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, (_, kind) in zip(zip(*found), kinds)], schema=pa.schema(kinds))

    for layer in reversed(layers):
        above = with_lone_blocks(layer.pieces.join(above, ["tree", "block"]).mapInArrow(taken, WAY_SCHEMA), of_trees)
    return above


def prove(made: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf, digests as hexadecimal text.

    The way above a block is taken once for the block; the siblings within it are taken from its piece of the log. The
    root is folded from the tampered leaf where there is one.
    """
    nowhere = {"places": F.expr("CAST(array() AS array<int>)"), "siblings": F.expr("CAST(array() AS array<binary>)")}
    if made.top_layers:
        top = made.trees.select(F.lit(0).cast("long").alias("tree")).limit(1).withColumns(nowhere)
        of_trees = cut(ways(made.top_layers, top).select(F.col("block").alias("tree"), "places", "siblings"))
    else:
        of_trees = cut(made.trees.select("tree").withColumns(nowhere))
    above = cut(ways(made.layers[1:], of_trees))
    if made.layers:
        pieces = above.join(made.layers[0].pieces, ["tree", "block"], "left")
    else:
        pieces = above.withColumns({"width": F.lit(1).cast("long"), "height": F.lit(0), "nodes": F.lit(None).cast("binary")})
    roots = made.trees.select("tree", "subroot").join(F.broadcast(made.root))  # the root is one row
    pieces = label_join(pieces, roots, "tree", "inner").select("tree", "block", "width", "height", "nodes", "places", "siblings", "subroot", "root")
    kinds = [("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())]

    def proven(docs: pa.Table, piece: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows and piece.num_rows:
            block = piece.to_pylist()[0]
            nodes, width, top = memoryview(block["nodes"] or b""), block["width"] or 1, block["height"] or 0
            shared = b"".join(block["siblings"]).hex().encode()
            root, subroot = block["root"], block["subroot"].hex()
            for doc_id, i, leaf, tampered in zip(*(docs[c].to_pylist() for c in ("doc_id", "i", "leaf", "tampered"))):
                places, others = siblings_within(nodes, i % FANOUT**HEIGHT, width, top)
                proof = hashlib.sha256(b"".join(others).hex().encode())
                proof.update(shared)
                reached = folded(tampered or leaf, places + block["places"], others + block["siblings"])
                rows.append((doc_id, leaf.hex(), subroot, root.hex(), proof.hexdigest(), reached.hex(), reached == root))
        columns = list(zip(*rows)) or [()] * len(kinds)
        return pa.table({name: pa.array(list(c), kind) for c, (name, kind) in zip(columns, kinds)})

    docs = made.leaves.withColumn("block", F.expr(f"i div {FANOUT**HEIGHT}"))
    keys = ["tree", "block"]
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return docs.groupBy(*keys).cogroup(pieces.groupBy(*keys)).applyInArrow(proven, schema)


def report(docs: DataFrame) -> DataFrame:
    return prove(build(docs))


SQL_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda x, bit: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""
SQL_TEXT = "coalesce(strlen({0}) || ':' || {0}, '-')"
SQL_ROW = " || ".join(SQL_TEXT.format(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars"))
SQL_UP = """SELECT level + 1, tree, i // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY i)) FROM {0} WHERE n > 1 GROUP BY level, tree, i // 8, n"""
SQL_WAY = """SELECT w.place, w.level + 1, w.tree, w.i // 8, (w.n + 7) // 8,
    sha256(string_agg(CASE WHEN s.i = w.i THEN w.node ELSE s.node END, '' ORDER BY s.i)),
    w.proof || coalesce(string_agg(s.node, '' ORDER BY s.i) FILTER (s.i <> w.i), '')
  FROM {0} w JOIN {1} s ON s.level = w.level AND s.tree = w.tree AND s.i // 8 = w.i // 8 WHERE w.n > 1
  GROUP BY w.place, w.level, w.tree, w.i, w.n, w.node, w.proof"""
SQL = f"""WITH RECURSIVE leaves AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS place, leaf,
    CASE WHEN h % 3 = 0 THEN changed ELSE leaf END AS given,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY lang) AS n,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM (SELECT doc_id, lang, {SQL_CRC} AS h, sha256({SQL_ROW} || {SQL_TEXT.format("text")}) AS leaf,
    sha256({SQL_ROW} || {SQL_TEXT.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS changed FROM documents)),
nodes(level, tree, i, n, node) AS (SELECT 0, tree, i, n, leaf FROM leaves UNION ALL {SQL_UP.format("nodes")}),
subroots AS MATERIALIZED (SELECT tree, node, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, tree, i, n, node) AS (SELECT 0, 0, tree, n, node FROM subroots UNION ALL {SQL_UP.format("tops")}),
low(place, level, tree, i, n, node, proof) AS (SELECT place, 0, tree, i, n, given, '' FROM leaves UNION ALL {SQL_WAY.format("low", "nodes")}),
high(place, level, tree, i, n, node, proof) AS (
  SELECT place, 0, 0, l.tree, s.n, l.node, proof FROM low l JOIN subroots s USING (tree) WHERE l.n = 1 UNION ALL {SQL_WAY.format("high", "tops")})
SELECT doc_id, leaf, s.node AS subroot, r.node AS root, sha256(h.proof) AS proof_sha256, h.node AS folded_root, h.node = r.node AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN high h ON h.place = l.place AND h.n = 1 JOIN tops r ON r.n = 1"""

"""Digests, logs and proofs against a plain restatement."""

import hashlib
import string
import zlib

import pytest
from pyspark.sql import functions as F

from grovemark.llm import manifest
from tests.llm import fixtures

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(row, text):
    return h("".join(value(row[c]) for c in ("doc_id", "source", "lang", "n_chars")) + value(text))


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [h("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
        out.append(nodes)
    return out


def way(tree, i):
    for nodes in tree[:-1]:
        first = i - i % 8
        yield "".join(nodes[first:i]), "".join(nodes[i + 1 : first + 8])
        i //= 8


def trees_of(rows):
    languages = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    for name in languages:
        own = [(r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r) for r in rows if r["lang"] == name]
        own.sort(key=lambda x: x[:3])
        yield own, levels([x[2] for x in own])


def brute(rows):
    trees = list(trees_of(rows))
    top = levels([tree[-1][0] for _, tree in trees])
    out = []
    for t, (own, tree) in enumerate(trees):
        for i, (_, _, node, r) in enumerate(own):
            steps = [*way(tree, i), *way(top, t)]
            x = node
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                x = leaf(r, r["text"].translate(LOWER))
            for left, right in steps:
                x = h(left + x + right)
            root = top[-1][0]
            out.append((r["doc_id"], node, tree[-1][0], root, h("".join(a + b for a, b in steps)), x, x == root))
    return sorted(out, key=str)


def documents(spark, n_languages=11):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*SCHEMA.replace(",", "").split()[::2])
    odd = fixtures.odd(spark).select("doc_id", "text").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")})
    few = spark.range(3 * n_languages).select(
        (F.col("id") + 10_000).alias("doc_id"), F.concat(F.lit("Of Ärger Ä"), "id").alias("text"),
        F.concat(F.lit("é"), (F.col("id") % n_languages).cast("string")).alias("lang"), F.lit("S").alias("source"), F.lit(9).cast("long").alias("n_chars"),
    )
    one = spark.createDataFrame([(20_000, "A", "", "", 1)], SCHEMA)
    made = given.unionByName(odd).unionByName(few).unionByName(one)
    return made.withColumns({name: F.lit("x") for name in ("leaf", "tree", "i", "n", "key", "slot", "block", "root", "places")})


@pytest.mark.parametrize("height", [1, 4])
def test_same_as_brute_force(spark, monkeypatch, height):
    monkeypatch.setattr(manifest, "HEIGHT", height)
    docs = documents(spark)
    assert sorted(map(tuple, manifest.report(docs).collect()), key=str) == brute([r.asDict() for r in docs.collect()])


def test_empty_and_single(spark):
    assert manifest.report(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(3, "A b", None, None, None)], SCHEMA)
    assert [tuple(r) for r in manifest.report(one).collect()] == brute([r.asDict() for r in one.collect()])


def postorder(tree):
    """The nodes of a tree, each after those below it."""

    def below(height, index):
        if height:
            for k in range(index * 8, min(index * 8 + 8, len(tree[height - 1]))):
                yield from below(height - 1, k)
        yield height, tree[height][index]

    yield from below(len(tree) - 1, 0)


def test_log_is_postorder(spark, monkeypatch):
    monkeypatch.setattr(manifest, "HEIGHT", 1)
    docs = documents(spark).filter("lang = 'en' OR lang = 'fr'")
    made = manifest.build(docs)
    log = manifest.tree_log(made.layers, made.leaves).orderBy("tree", "place").collect()
    trees = [tree for _, tree in trees_of([r.asDict() for r in docs.collect()])]
    want = [(t, place, height, node) for t, tree in enumerate(trees) for place, (height, node) in enumerate(postorder(tree))]
    assert [(r["tree"], r["place"], r["height"], r["node"].hex()) for r in log] == want


def test_blocks_know_their_place():
    for width in (1, 5, 8, 9, 64, 65, 513, 600):
        nodes = [bytes([k % 251]) * 32 for k in range(width)]
        top = manifest.levels_of(width)
        log = manifest.append_nodes(iter(nodes), width, top)
        tree = [nodes]
        while len(tree[-1]) > 1:
            tree.append([manifest.digest_of(b"".join(tree[-1][k : k + 8])) for k in range(0, len(tree[-1]), 8)])
        for height, level in enumerate(tree):
            for index, node in enumerate(level):
                place = manifest.node_place(height, index, width, top)
                assert place == manifest.postorder_place(min((index + 1) * 8**height, width) - 1, height)
                assert log[place * 32 : place * 32 + 32] == node
        assert len(log) == 32 * sum(map(len, tree))

"""Fingerprints and components against brute force."""

import numpy as np
import pytest
import xxhash

from grovemark.llm import simhash
from tests.llm import fixtures


def brute(rows, words, bits):
    prints = []
    for row in rows:
        found = (row["text"] or "").encode().lower().split()
        shingles = [b" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))] if found else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    values, label = np.array(prints, dtype=np.uint64), np.arange(len(prints))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= bits
    while True:
        after = np.array([label[near[k]].min() for k in range(len(values))])
        if (after == label).all():
            break
        label = after
    least = {}
    for k, row in enumerate(rows):
        if row["doc_id"] is not None:
            least[label[k]] = min(least.get(label[k], 2**62), row["doc_id"])
    return sorted(((r["doc_id"], format(prints[k], "016x"), least.get(label[k])) for k, r in enumerate(rows)), key=str)


def found(docs, bits):
    rows = simhash.near_copies(docs, bits=bits).collect()
    return sorted(((r["doc_id"], format(r["f0"] & (2**64 - 1), "016x"), r["component_id"]) for r in rows), key=str)


@pytest.mark.parametrize("bits, tile, small", [(4, 2_048, 24), (9, 20, 4)])
def test_same_as_brute_force(spark, monkeypatch, bits, tile, small):
    monkeypatch.setattr(simhash, "TILE_ROWS", tile)
    monkeypatch.setattr(simhash, "SMALL_GROUP", small)
    near = [(9200 + k, " ".join(f"w{j}" if j != k else "other" for j in range(60))) for k in range(40)]
    docs = fixtures.mixed(spark, near)
    assert found(docs, bits) == brute(docs.collect(), 4, bits)


def test_no_rows(spark):
    assert simhash.near_copies(fixtures.empty(spark)).count() == 0


def test_thresholds_keep_every_pair():
    """No pair within the threshold escapes all partitions."""
    rng = np.random.default_rng(0)
    for bits in (1, 4, 11):
        x = rng.integers(0, 2, (300, 64))
        plan = simhash.partition_plan(10**6, (x.T @ x) * (10**6 / 300), bits)
        assert sum(t + 1 for _, t in plan) == bits + 1
        for _ in range(200):
            differing = set(rng.choice(64, bits, replace=False).tolist())
            assert any(len(differing & set(group)) <= t for group, t in plan)


def test_one_of_each(spark):
    base = [f"word{k}" for k in range(200)]
    copy = base[:100] + ["changed"] + base[101:]
    docs = spark.createDataFrame(
        [(3, " ".join(base), 1), (1, " ".join(copy), 2), (2, "something else entirely here now", 3), (2, "something else entirely here now", 4), (5, None, 5)],
        "doc_id long, text string, row int",
    )
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == [1, 2, 5]
    assert simhash.one_of_each(docs).columns == docs.columns

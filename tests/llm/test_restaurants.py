"""Base scores by counting, the model by its total probability and held-out text."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovemark.llm import restaurants
from grovemark.llm.folds import fold
from tests.llm import fixtures


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


@pytest.mark.parametrize("size", [12_000_000, 5_000])
def test_base_scores(spark, monkeypatch, size):
    monkeypatch.setattr(restaurants, "CHUNK_BYTES", size)
    docs = fixtures.mixed(spark)
    rows, out = docs.collect(), lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    counts = Counter(w for r in rows if not out(r["doc_id"]) for w in tokens(r["text"]))
    total, kinds = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens(t))
    line = lambda d, o, n, k, t, b: (str(d), o, n, k, t, round(b, 6))
    want = Counter(line(r["doc_id"], out(r["doc_id"]), len(tokens(r["text"])), sum(counts[w] > 0 for w in tokens(r["text"])), total, base(r["text"])) for r in rows)
    got = restaurants.score(docs, fold("doc_id", 7) == 2).collect()
    assert Counter(line(*tuple(r)[:6]) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_better_than_base_on_held_out_text(spark):
    rows = restaurants.score(fixtures.given(spark, "/root/testdata/sf0.01"), fold("doc_id", 7) == 2).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_probabilities_sum_to_one(spark):
    """Over all known words and one unknown, after each class of word."""
    training = [(k, t) for k, t in enumerate(["a b a c", "b a", "c c b zebra", "a"] * 5)]
    asked = [(100 + k, w) for k, w in enumerate(["a", "b", "c", "zebra", "unseen", ""])]
    docs = spark.createDataFrame(training + asked, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in restaurants.score(docs, F.col("doc_id") >= 100).collect()}
    firsts = spark.createDataFrame(training + [(200 + k, w + " " + e) for k, w in enumerate(["a", "b", "c", "zebra", "unseen"]) for e in [""]], "doc_id long, text string")
    after = {r["doc_id"]: r for r in restaurants.score(firsts, F.col("doc_id") >= 200).collect()}
    # P(w) = P(w, end) / P(end | w); the end after w is read off a text of w twice: P(w w end) = P(w) P(w|w) P(end|w).
    assert rows[105]["n_tokens"] == 1 and 10 ** rows[105]["score"] < 1
    assert all(abs(after[200 + k]["score"] - rows[100 + k]["score"]) < 1e-6 for k in range(5))


def test_predictive_sums_to_one():
    counts = np.array([5, 3, 1, 2, 7, 1])
    seating = restaurants.Seating(0, np.array([2, 1, 3]), np.array([0, 1, 0, 0, 1, 2]), counts)
    history = []
    for number in range(3):
        s = np.array(seating.sums())
        c = restaurants.CONTEXTS
        totals = restaurants.Totals(s[c : 2 * c], s[:c], s[2 * c], 3, int(counts.sum()), 0.5)
        history.append(totals)
        root = seating.root_probability(totals)
        unknown = (1 + 0.5 * totals.root_tables) / 4 / (1 + totals.tables.sum())
        assert abs(root.sum() + unknown - 1) < 1e-9
        for k in range(3):
            mine = seating.classes == k
            p = (1 + 0.5 * totals.tables[k]) * root
            np.add.at(p, seating.word[mine], (counts - 0.5 * seating.tables)[mine])
            assert abs((p.sum() + (1 + 0.5 * totals.tables[k]) * unknown) / (1 + totals.customers[k]) - 1) < 1e-9
        seating.sweep(totals, number)


def test_tables():
    rng = np.random.default_rng(0)
    customers = np.array([0, 1, 2, 50, 1_000, 200_000])
    taken = restaurants.tables_taken(customers, np.full(6, 3.0), 0.5, rng)
    assert taken[0] == 0 and taken[1] == 1 and (taken <= customers).all() and (np.diff(taken) >= 0).all()


def test_no_rows(spark):
    assert restaurants.score(fixtures.empty(spark), F.lit(False)).count() == 0
    assert restaurants.score(fixtures.odd(spark), F.lit(True)).count() == len(fixtures.ODD)


def test_contexts_are_whole_tokens(spark):
    """xa and ya end in the same byte but are followed by other words."""
    training = [(k, "xa p" if k % 2 else "ya q") for k in range(60)]
    asked = [(100, "xa p"), (101, "xa q"), (102, "ya p"), (103, "ya q")]
    docs = spark.createDataFrame(training + asked, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in restaurants.score(docs, F.col("doc_id") >= 100).collect()}
    assert got[100] > got[101] + 0.5 and got[103] > got[102] + 0.5


def test_whole_contexts_sum_to_one(spark):
    """Over all next tokens of a context, with hot and with rare contexts, seen in training or not."""
    words = ["a", "b", "c", "zebra", "unseen"]
    training = [(k, t) for k, t in enumerate(["a b a c", "b a", "c c b zebra", "a"] * 5)]
    asked = [(100 + 10 * i + j, f"{u} {w}") for i, u in enumerate(words) for j, w in enumerate(words)]
    alone = [(1000 + i, u) for i, u in enumerate(words)]
    after = [(2000, "")]
    docs = spark.createDataFrame(training + asked + alone + after, "doc_id long, text string")
    got = {r["doc_id"]: 10 ** r["score"] for r in restaurants.score(docs, F.col("doc_id") >= 100).collect()}
    # P(u, end) = P(u) P(end | u) and P(u, w, end) = P(u) P(w | u) P(end | w), where P(end | w) = P(w, end) / P(w).
    # A matrix of the pairs gives P(w | u) P(end | w) / P(end | u); it must fit sums of one for all contexts at once.
    pair = np.array([[got[100 + 10 * i + j] / got[1000 + i] for j in range(5)] for i in range(5)])  # P(w|u) P(end|w) / P(end|u)
    # With e = P(end | .): sum over w of pair[u, w] * e[u] / e[w] + e[u] = 1, which is linear in x = 1 / e: pair @ x + 1 = x.
    x = np.linalg.solve(np.eye(5) - pair, np.ones(5))
    first = np.array([got[1000 + i] for i in range(5)]) * x  # P(u at the start)
    assert (x > 1).all() and abs(first.sum() + got[2000] - 1) < 1e-4


@pytest.mark.parametrize("customers, weight, discount", [(300, 2.0, 0.5), (1_500, 0.3, 0.8), (1_500, 40.0, 0.1), (1_500, 400.0, 0.5)])
def test_tables_follow_the_exact_law(customers, weight, discount):
    """Mean and spread of the number of tables against the law found by recursion over customers."""
    law = np.zeros(customers + 2)
    law[1] = 1.0
    tables = np.arange(len(law))
    for seated in range(1, customers):
        chance = weight / (weight + np.maximum(seated - discount * tables, 1e-9))
        law = law * (1 - chance) + np.append(0, (law * chance)[:-1])
    mean = (law * tables).sum()
    spread = math.sqrt((law * (tables - mean) ** 2).sum())
    n = 40_000
    drawn = restaurants.tables_taken(np.full(n, customers), np.full(n, weight), discount, np.random.default_rng(5))
    assert abs(drawn.mean() / mean - 1) < 0.01
    assert abs(drawn.std() / spread - 1) < 0.03


def test_same_scores_on_any_number_of_partitions(spark, monkeypatch):
    monkeypatch.setattr(restaurants, "HOT_SHARE", 50)
    docs, set_to, made = fixtures.mixed(spark), spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions in ("4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            rows = restaurants.score(docs.repartition(int(partitions) // 4), fold("doc_id", 7) == 2).collect()
            made.append(Counter(tuple(r) for r in rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", set_to)
    assert made[0] == made[1]


def test_number_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(restaurants, "BUCKET_BYTES", 10)
    docs = spark.createDataFrame([(k, False, "ab" * 10) for k in range(50)] + [(60, False, None)], "doc_id long, out boolean, text string")
    assert restaurants.number_of_buckets(docs) == 100 and restaurants.number_of_buckets(docs.limit(0)) == restaurants.MIN_BUCKETS

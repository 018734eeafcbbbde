"""Runs of words against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovemark.llm import periods
from tests.llm import fixtures


def brute_runs(x, least=6, repeats=4):
    found = set()
    for q in range(1, len(x) // repeats + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, repeats * q):
                if not any(x[i : i + length - r] == x[i + r : i + length] for r in range(1, q)):
                    found.add((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def texts(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        x = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(0, 130))]
        if len(x) > 10 and rng.random() < 0.7:  # a repeat laid in, perhaps with a fault
            start, p = rng.randrange(len(x)), 1 + rng.randrange(len(x) // 5)
            for i in range(start + p, len(x)):
                x[i] = x[i - p]
            if rng.random() < 0.5:
                x[rng.randrange(len(x))] = 9
        yield x


def test_sequences_as_brute_force():
    for x in texts(400, 3):
        assert periods.sequence_runs(np.array(x, np.int64), len(x)) == brute_runs(x), x


def test_texts_of_a_batch_do_not_meet():
    words = [[b"a"] * 5, [b"a"] * 5, [], [b"a", b"b"] * 9 + [b"a"] * 6, [b"a"] * 3]
    assert periods.batch_runs(words) == [[], [], [], [(0, 19, 2), (18, 6, 1)], []]


def test_transform_and_convolution():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, 400).astype(np.uint64)
    rows = rng.integers(0, periods.PRIME, (5, 64)).astype(np.uint64)
    assert (periods.backward(periods.forward(rows)) == rows).all()
    for size in (1, 2, 8, 32):
        starts = np.arange(0, 400 - 3 * size, size)
        found = set(zip(*(c.tolist() for c in periods.occurrences(x, starts, size))))
        want = {(k, d) for k, s in enumerate(starts) for d in range(size, 2 * size) if (x[s : s + size] == x[s + d : s + d + size]).all()}
        assert found == want


def test_a_zero_by_chance_is_parted():
    x = np.array([1, 2, 1, 2, 7, 2, 1, 2, 1])
    assert periods.stretches(x, 0, 7, 2) == [(0, 2), (3, 4), (5, 7)]


def test_few_periods_are_refused():
    with pytest.raises(ValueError):
        periods.sequence_runs(np.zeros(9, np.int64), 9, repeats=3)


def words_of(doc_id, text):
    words = (text or "").encode().split()
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def report(doc_id, text):
    words = words_of(doc_id, text)
    code = {}
    runs = brute_runs([code.setdefault(w, len(code)) for w in words])
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    digests = (
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest(),
    )
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digests)


def test_report_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(periods, "SLAB_WORDS", 500)
    more = [(k, " ".join(random.Random(k).choice("ab") for _ in range(k % 90)) + " c d e" * (k % 7)) for k in range(9100, 9400)]
    short = fixtures.given(spark).filter("length(text) < 4000 AND doc_id % 3 = 0")  # for the brute force
    docs = short.unionByName(fixtures.odd(spark, more).filter("doc_id IS NULL OR doc_id NOT IN (9008, 9009)").select("doc_id", "text"))
    got = periods.run_report(periods.periodic_runs(docs.withColumn("text", periods.planted("doc_id", "text")))).collect()
    want = [report(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(r["n_runs"] > 0 for r in got) > 30


def test_odd_long_and_empty(spark):
    docs = fixtures.odd(spark).withColumns({name: F.lit("x") for name in ("runs", "best", "collapsed")})
    found = {r["doc_id"]: r for r in periods.periodic_runs(docs).filter("doc_id IS NOT NULL").collect()}
    assert [tuple(r) for r in found[9008]["runs"]] == [(0, 20_000, 1)] and found[9008]["collapsed"] == "long"
    assert found[9001]["runs"] == [] and found[9001]["collapsed"] == ""
    assert periods.run_report(periods.periodic_runs(fixtures.empty(spark))).collect() == []

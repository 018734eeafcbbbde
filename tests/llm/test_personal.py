"""Base entities against the plain patterns, patterns on planted contexts."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from grovemark.llm import personal
from tests.llm import fixtures

PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
PIECES = ["a", "b.", "@", "1", "23", "4", ".", "-", " ", "+", "(", ")", "é", "\U0001f600", "\n", "255", "300", "_", "%", "@x.y", "  ", "\x01"]


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in match.split("."))
    if kind == "card":
        worth = [int(c) if k % 2 == 0 else int(c) * 2 - 9 * (c > "4") for k, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(worth) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def base(text):
    counts, spans = [], []
    for kind, pattern in PLAIN:
        found = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if holds(kind, m.group())]
        counts.append(len(found))
        spans += found
    return (*counts, hashlib.sha256(",".join(spans).encode()).hexdigest()), spans


def test_base_entities(spark):
    rng = random.Random(3)
    rows = [(20_000 + k, "".join(rng.choice(PIECES) for _ in range(rng.choice([5, 40, 200])))) for k in range(500)]
    rows += [(30_000, "1 " * 3_000), (30_001, "1" * 4_000 + ".1.1.1"), (30_002, "x@" + "a." * 3_000), (30_003, "4111 1111-1111 1111 +1 (650) 555-1234x")]
    docs = fixtures.mixed(spark, rows)
    got = personal.report(docs).collect()
    texts = docs.collect()
    want = sorted(((r["doc_id"], *base(r["text"])[0]) for r in texts), key=str)
    assert sorted((tuple(r)[:6] for r in got), key=str) == want
    spans = {r["doc_id"]: set(r["spans"].split(",")) for r in got}
    assert all(set(base(r["text"])[1]) <= spans[r["doc_id"]] for r in texts if r["doc_id"] and r["doc_id"] >= 20_000)


def test_patterns_discover(spark):
    names = ["ann", "bob", "cyd", "dee", "eve", "fay", "gus"]
    rows = [(k, f"{n} dialled help line +1 (555) 555-01{k:02d} today and then {n} left") for k, n in enumerate(names)]
    rows += [(100, "somebody dialled help line 555-0199-77 today again"), (101, "the year 2024 was fine"), (102, None)]
    got = {r["doc_id"]: r for r in personal.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100]["spans"] == "phone:27:38" and got[100]["n_phone"] == 0 and got[100]["n_added"] == 1
    assert got[101]["spans"] == "" and got[102]["n_added"] == 0 and got[3]["n_phone"] == 1


def test_no_rows(spark):
    assert personal.report(fixtures.empty(spark)).count() == 0
    assert personal.report(fixtures.odd(spark)).count() == len(fixtures.ODD)


def test_words_around_matches(spark):
    """The two words before a match and the word after it, beside other matches, long words and long space."""
    space, token = r"[ \t\n\x0b\f\r]+", r"(?<!\S)[^\s0-9@]*[0-9@]\S*"
    rng = random.Random(7)
    pieces = ["tel", "fax", "12345678", "23456789", "a@b.c", "x" * 90, "9" * 90, "é", "\U0001f600"]
    texts = ["tel 12345678 fax 23456789", "one" + " " * 200 + "two" + " " * 200 + "345 6" + "\n" * 90 + "end"]
    texts += [rng.choice([" ", "\n", " " * 70]).join(rng.choice(pieces) for _ in range(rng.choice([1, 4, 30]))) for _ in range(200)]
    made = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    rows = made.select("n", F.explode(personal.raw_matches(F.col("text"), personal.TOKENS, personal.TOKEN)).alias("m")).select("n", "m.*")
    words = lambda text: [w for w in re.split(space, text) if w]
    got = sorted((r["n"], r["k"], r["value"], words(r["before"]), words(r["after"])) for r in rows.collect())
    want = [
        (n, k, m.group(), words(t[: m.start()])[-2:], words(t[m.end() :])[:1])
        for n, t in enumerate(texts) for k, m in enumerate(re.finditer(token, t))
    ]
    assert got == want

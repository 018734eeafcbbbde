"""Leaks against the exact distance of all windows."""

import numpy as np

from grovemark.llm import leaks
from tests.llm import fixtures


def distance(a, b):
    row = list(range(len(b) + 1))
    for k, x in enumerate(a, 1):
        after = [k]
        for j, y in enumerate(b, 1):
            after.append(min(row[j] + 1, after[-1] + 1, row[j - 1] + (x != y)))
        row = after
    return row[-1]


def test_edit_distances():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 4, (60, 9)), rng.integers(0, 4, (60, 12))
    assert leaks.edit_distances(a, b).tolist() == [distance(x.tolist(), y.tolist()) for x, y in zip(a, b)]


def test_all_windows(spark):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").limit(25).collect()
    known = [w for r in items for w in leaks.words_of(r["text"])]
    rng, rows = np.random.default_rng(1), []
    for k in range(120):
        words = list(leaks.words_of(items[k % len(items)]["text"]))
        for _ in range(int(rng.integers(0, int(0.3 * len(words)) + 1))):
            place, kind = int(rng.integers(0, len(words))), int(rng.integers(0, 3))
            if kind == 0:
                words[place] = str(rng.choice(known))
            elif kind == 1:
                words.insert(place, f"new{place}")
            else:
                del words[place]
        around = [[str(x) for x in rng.choice(known, int(rng.integers(0, 30)))] for _ in range(2)]
        rows.append((k, " ".join(around[0] + words + around[1])))
    benchmark = spark.createDataFrame([*items, (900, None), (901, "")], "item_id long, text string")
    docs = fixtures.odd(spark, rows)
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in leaks.find_leaks(docs, benchmark).collect()}
    parsed, want = leaks.Items([tuple(r) for r in items], 0.2, 0.999), {}
    for doc, text in rows:
        words = np.array([parsed.vocabulary.get(w, 0) for w in leaks.words_of(text)])
        for width, (names, sequences) in parsed.by_width.items():
            windows = np.lib.stride_tricks.sliding_window_view(words, min(width, len(words)))
            for name, row in zip(names, sequences):
                least = leaks.edit_distances(windows, np.tile(row, (len(windows), 1))).min()
                if least <= parsed.edits[width]:
                    want[doc, name] = least
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) and len(want) > 50
    exact = {k for k, v in want.items() if v <= 1}
    assert exact <= set(got)


def test_spans_removal_and_no_rows(spark):
    text = "The quick brown fox jumps over the lazy dog while seven wizards quietly boxed"
    benchmark = spark.createDataFrame([(1, text)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Intro here. {text.upper()}! End."), (2, "nothing"), (None, "x")], "doc_id long, text string")
    found = leaks.find_leaks(docs, benchmark)
    row = found.first()
    assert (row["doc_id"], row["distance"], row["start"], row["end"]) == (1, 0, 12, 12 + len(text))
    assert sorted((r["doc_id"] for r in leaks.remove_leaks(docs, found).collect()), key=str) == [2, None]
    assert leaks.find_leaks(fixtures.empty(spark), benchmark).count() == 0
    assert leaks.find_leaks(docs, benchmark.limit(0)).count() == 0

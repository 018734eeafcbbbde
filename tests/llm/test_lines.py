"""Kept lines against all pairs of lines."""

import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from grovemark.llm import lines, queries
from grovemark.session import DROP_SHUFFLES, cut
from tests.llm import fixtures

BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
CASES = [
    (9300, BASE), (9301, BASE + " lambda"), (9302, f"Kappa  {BASE} lambda mu\nshort one\nshort one"), (9303, BASE.replace("alpha", "x1").replace("beta", "x2")),
    (9304, "\n\n" + BASE.upper()), (9304, "\n\n" + BASE.upper()), (9304, "other text of the same document id"),
] + [(9400 + k, " ".join(f"w{j}" if j != k % 31 else f"v{k}" for j in range(30))) for k in range(150)]


def brute(spark, docs, threshold, min_words):
    rows = docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()
    every = []
    for doc, text, h in {tuple(r) for r in rows if r["text"] is not None}:
        for k, line in enumerate(text.split("\n")):
            words = frozenset(w for w in re.split("[ \t\r\n\x0b\x0c]+", line.lower()) if w)
            every.append(((doc is not None, doc or 0, h, k), doc, text, words))
    every.sort(key=lambda x: x[0])
    holds, kept = defaultdict(list), defaultdict(list)
    for n, (place, doc, text, words) in enumerate(every):
        shared = defaultdict(int)
        if len(words) >= min_words:
            for w in words:
                for m in holds[w]:
                    shared[m] += 1
                holds[w].append(n)
        if not any(s >= threshold * (len(words) + len(every[m][3]) - s) - 1e-9 for m, s in shared.items()):
            kept[doc, text].append(place[3])
    line_count = lambda t: 0 if t is None else len(t.split("\n"))
    return sorted(
        ((d, line_count(t), len(kept.get((d, t), [])), ",".join(map(str, kept.get((d, t), [])))) for d, t, _ in map(tuple, rows)), key=str
    )


@pytest.mark.parametrize("hot, tile, min_words", [(64, 512, 5), (1, 40, 5), (0, 40, 2)])
def test_same_as_all_pairs(spark, monkeypatch, hot, tile, min_words):
    monkeypatch.setattr(lines, "HOT_IN_SAMPLE", hot)
    monkeypatch.setattr(lines, "TILE_ROWS", tile)
    docs = fixtures.mixed(spark, CASES).cache()
    assert sorted(map(tuple, lines.line_report(docs, min_words=min_words).collect()), key=str) == brute(spark, docs, 0.8, min_words)


def test_texts_and_other_columns(spark):
    docs = fixtures.odd(spark, CASES[:3])
    made = lines.dedup_lines(docs)
    texts = {r["doc_id"]: r["text"] for r in made.collect()}
    assert made.columns == docs.columns and texts[9300] == BASE and texts[9301] == ""
    assert texts[9302] == "short one\nshort one" and texts[9001] is None and texts[9002] == ""
    assert lines.dedup_lines(fixtures.empty(spark)).count() == 0


def test_short_lines_are_compared(spark, tmp_path):
    """By the query and the stage: lines of one word or more, few distinct words in a long line, four words of five."""
    rows = [
        (9500, "Les.\n\nAnd ornd.\nLes."), (9501, "les.\nand ORND.\n\nother and ornd."), (9502, "go " * 50 + "away"), (9503, "away go"),
        (9504, "one two three four"), (9505, "one two three four five"), (9506, "one two three"), (9507, "two one three"),
    ]
    docs = fixtures.mixed(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = brute(spark, docs, 0.8, 1)
    assert sorted(map(tuple, queries.op8_lines(spark, str(tmp_path)).collect()), key=str) == want
    texts = {r["doc_id"]: r["text"] for r in corpus_pipeline.without_repeated_lines(spark, spark.createDataFrame(rows, fixtures.SCHEMA), str(tmp_path)).collect()}
    assert texts[9500] == "Les.\n\nAnd ornd." and texts[9501] == "\nother and ornd." and texts[9505] == "" and texts[9507] == ""


def large_lines():
    """Lines of 44 to 52, 92 to 104 and 190 to 200 words with near copies of other sizes, on both sides of a level of the summaries."""
    rows = []
    for family, size in enumerate((44, 46, 48, 49, 50, 52, 92, 96, 97, 104, 190, 193, 200)):
        words = [f"f{family}w{k}" for k in range(size)]
        for copy, (gone, new) in enumerate([(0, 0), (0, size // 5), (size // 9, 0), (size // 9, size // 9), (size // 8, size // 8), (size // 5, 0), (size // 4, 1)]):
            rows.append((9600 + 10 * family + copy, " ".join(words[gone:] + [f"n{copy}x{k}" for k in range(new)])))
    return rows


def test_large_sets_on_both_sides_of_a_level(spark):
    docs = spark.createDataFrame(large_lines(), fixtures.SCHEMA).cache()
    got = sorted(map(tuple, lines.line_report(docs, min_words=1).collect()), key=str)
    want = brute(spark, docs, 0.8, 1)
    assert got == want and 0 < sum(n_kept for _, _, n_kept, _ in want) < len(want)
    assert sorted(map(tuple, lines.line_report(docs, threshold=0.4).collect()), key=str) == brute(spark, docs, 0.4, 5)


def test_large_sets_that_share_few_words_are_no_pairs(spark, monkeypatch):
    """Sets of 100 and of 200 words, 12 of which are common to all; words in the order of their hash."""
    monkeypatch.setattr(lines, "cell_ranks", lambda docs, text: F.array(F.lit(0).cast("tinyint")))
    common = [f"common{k}" for k in range(12)]
    rows = [(9700 + s, " ".join(common + [f"s{s}w{k}" for k in range(88 + 100 * (s % 2))])) for s in range(60)]
    docs = spark.createDataFrame(rows, fixtures.SCHEMA)
    entries = lines.entries_of(lines.representatives(docs, "doc_id", "text", 0.8, 1).withColumn("open", F.lit(True)))
    shared = entries.alias("a").join(entries.alias("b"), F.expr("a.key = b.key AND a.sig < b.sig"))
    assert shared.count() > 300 and shared.filter(lines.possible(0.8, 2)).count() < 10


def test_sets_that_drift_are_settled_by_those_before_them(spark):
    """Each set shares 29 of 31 words with the next, but few with the earliest set that holds one of its words."""
    rows = [(9900 + s, " ".join(f"drift{k}" for k in range(s, s + 30))) for s in range(60)]
    docs = spark.createDataFrame(rows, fixtures.SCHEMA).cache()
    reps = lines.representatives(docs, "doc_id", "text", 0.8, 1)
    hot = spark.createDataFrame([], "key int")
    gone = {r["sig"] for r in lines.settled(docs, reps, hot, True, "doc_id", "text", 0.8).collect()}
    later = {r["sig"] for r in reps.filter("place.doc > 9900").collect()}
    assert gone <= later and len(gone) >= 50
    assert sorted(map(tuple, lines.line_report(docs, min_words=1).collect()), key=str) == brute(spark, docs, 0.8, 1)


def near_family(size):
    """Sets of 26 common words and four of their own: none matches another, but all are near."""
    return [(9100 + s, " ".join([f"c{k}" for k in range(26)] + [f"own{s}x{k}" for k in range(4)])) for s in range(size)]


def test_near_sets_that_match_nothing_give_no_pairs(spark, monkeypatch):
    """No table has more rows than sets have words to be filed under, however large the family is."""
    rows, cut = [], lines.cut
    monkeypatch.setattr(lines, "cut", lambda df: (made := cut(df), rows.append(made.count()))[0])
    docs = spark.createDataFrame(near_family(150), fixtures.SCHEMA)
    reps = lines.representatives(docs, "doc_id", "text", 0.8, 1)
    filed = lines.entries_of(reps.withColumn("open", F.lit(True))).count()
    assert lines.matched(docs, reps, "doc_id", "text", 0.8, 1).count() == 0
    assert max(rows) <= filed < 150 * 149 / 8


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_same_in_slices_and_tiles(spark, monkeypatch, threshold):
    monkeypatch.setattr(lines, "WHOLE_ROWS", 0)
    monkeypatch.setattr(lines, "TILE_ROWS", 40)
    docs = spark.createDataFrame(large_lines() + CASES + near_family(50), fixtures.SCHEMA).cache()
    assert sorted(map(tuple, lines.line_report(docs, threshold=threshold).collect()), key=str) == brute(spark, docs, threshold, 5)


def test_shuffle_files_go_with_the_table(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        files = disk.getAllFiles()
        return {name for name in (files.apply(k).getName() for k in range(files.size())) if name.startswith("shuffle_")}

    before = held()
    made = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    end = time.time() + 20
    while held() - before and time.time() < end:
        time.sleep(0.2)
    assert not held() - before and made.count() == 7
    assert spark.conf.get(DROP_SHUFFLES) == "false"

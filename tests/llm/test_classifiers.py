"""Quality and language by held-out accuracy."""

import numpy as np
from pyspark.sql import functions as F

from grovemark.llm import languages, quality
from grovemark.llm.folds import fold
from grovemark.llm.queries import ENTRIES
from tests.llm import fixtures

FOLDER = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    scored = ENTRIES["op9_quality"].run(spark, FOLDER)
    assert scored.count() == 1_000
    held = scored.filter("held_out").join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.93
    assert all(0 <= r["score"] <= 1 for r in held)


def test_quality_odd_rows(spark):
    docs = fixtures.odd(spark)
    labels = spark.createDataFrame([(9003, 1), (9003, 0), (9005, 1), (None, 1), (9006, None), (9008, 7), (9009, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels, F.lit(True))
    assert quality.score(docs.drop("score"), model).count() == len(fixtures.ODD)
    none = quality.train(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality.score(docs.drop("score"), none).collect()} == {0.5}
    one = quality.train(docs, labels.filter("quality = 1 AND doc_id = 9005"), F.lit(True))
    assert len({r["score"] for r in quality.score(docs.drop("score"), one).collect()}) == 1
    assert quality.score(fixtures.empty(spark), none).count() == 0


def test_additive_model_finds_an_interaction():
    x = np.random.default_rng(0).uniform(size=(4_000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    with_pairs, without = quality.fit(x, y, rounds=30), quality.fit(x, y, rounds=30, n_pairs=0)
    accuracy = lambda model: np.mean((model.scores(x) > 0.5) == (y == 1))
    assert accuracy(with_pairs) > 0.95 > 0.7 > accuracy(without)


def test_language_held_out(spark):
    rows = ENTRIES["op10_languages"].run(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = rows.filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in held)


def test_words_are_judged_whole():
    long_marks = "." * 200
    place = quality.FEATURES.index("bare_marks")
    assert quality.features(f"{long_marks} a b c")[place] == 0.25 and quality.features(f"{long_marks}x a b c")[place] == 0


def test_numbers_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "the cat sat there", "en"), (2, "½ ²", None), (3, "Ⅷ ① 42 _", None), (4, "²a", None), (5, "\u0301 ٣", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in languages.identify(docs, F.lit(True)).collect()}
    assert got == {1: "en", 2: "und", 3: "und", 4: "en", 5: "und"}


def test_language_as_plain_compression(spark):
    """The predictions and scores, restated without Spark."""
    import zstandard

    docs = fixtures.given(spark).join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang"), "doc_id")
    got = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in languages.identify(docs, F.lit(True), sample_rows=10_000).collect()}
    rows = docs.withColumn("h", F.pmod(F.xxhash64(F.col("text"), F.lit("sample")), F.lit(1 << 40))).collect()
    clean = lambda text: f" {' '.join(''.join(c if c.isalpha() else ' ' for c in text.lower()).split())} ".encode()
    content, counts = {}, {}
    for r in sorted({(r["lang"], r["h"], r["text"]) for r in rows}):
        if len(content.get(r[0], b"")) < 200_000:
            content[r[0]] = content.get(r[0], b"") + clean(r[2])
    for r in rows:
        counts[r["lang"]] = counts.get(r["lang"], 0) + 1
    names = sorted(content, key=lambda name: (-counts[name], name))
    packers = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content[n][:200_000], dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False) for n in names]
    for r in rows:
        sizes = [len(p.compress(clean(r["text"]))) for p in packers]
        best = sizes.index(min(sizes))
        assert got[r["doc_id"]][0] == names[best]


def test_language_odd_rows(spark):
    docs = fixtures.odd(spark, [(1, "le la les un une du")]).withColumn("lang", F.when(F.col("doc_id") == 1, "fr"))
    got = languages.identify(docs, F.lit(True)).collect()
    assert len(got) == len(fixtures.ODD) + 1
    assert all((r["lang_pred"] == "und") == (r["score"] == 0.0) for r in got)
    assert [r["lang_pred"] for r in got if r["doc_id"] in (9001, 9002, 9007)] == ["und"] * 3
    untaught = languages.identify(docs, F.lit(False)).collect()
    assert {r["lang_pred"] for r in untaught} == {"und"}
    assert languages.identify(docs.limit(0), F.lit(True)).count() == 0

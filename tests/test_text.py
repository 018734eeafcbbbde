import datetime

from pyspark.sql import functions as F

from grovemark.functions import labels as L
from grovemark.functions import text as T
from grovemark.operators.vectors import mean_vectors, unknown_words_with_digit


def first(df):
    return df.head()[0]


def test_tokens(spark):
    df = spark.createDataFrame([('  "A-b"  c:d;E [x] <y>@ z',)], "text string")
    assert first(df.select(T.tokens(F.col("text")))) == ["a-b", "cde", "x", "y", "z"]


def test_tokens_split_at_unicode_space_and_keep_null(spark):
    df = spark.createDataFrame([("a b c",), ("",), (None,)], "text string")
    assert [r[0] for r in df.select(T.tokens(F.col("text"))).collect()] == [["a", "b", "c"], [], None]


def test_clean_title(spark):
    titles = ["[A title].", "A.", "[A]", "A].", "A.]", ""]
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    got = [r[0] for r in df.select(T.clean_title(F.col("title"))).collect()]
    assert got == ["A title", "A", "A", "A", "A.", ""]


def test_document_text_is_null_when_a_part_is(spark):
    df = spark.createDataFrame([("a", None), ("a", "b\nc")], "title string, abstract string")
    text = T.document_text(F.col("title"), F.col("abstract"))
    assert [r[0] for r in df.select(T.one_line(text)).collect()] == [None, "a bc"]


def test_digits_follow_str_isdigit(spark):
    words = ["b12", "abc", "x²", "①", "½", "٣"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = [r[0] for r in df.select(T.has_digit(F.col("word"))).collect()]
    assert got == [any(c.isdigit() for c in w) for w in words]


def test_phrase_tokens(spark):
    schema = "tokens array<string>, index map<int, map<int, double>>"
    df = spark.createDataFrame([(["a", "b", "c"], {1: {2: 1.0, 0: 1.0}, 7: {1: 1.0}})], schema)
    inside = T.tokens_in_class(F.col("tokens"), F.col("index"))
    assert first(df.select(inside)) == ["a", "c"]
    assert first(df.select(T.tokens_outside(F.col("tokens"), inside))) == ["b"]
    assert first(df.select(T.tokens_in_class(F.col("tokens"), F.col("index"), 9))) is None
    assert first(df.select(T.joined(T.class_keys(F.col("index"))))) == "1;7"


def test_completion_date(spark):
    part = "struct<Year:string,Month:string,Day:string>"
    rows = [(("2019", "01", "31"), ("2020", "05", "06")), (None, ("2020", "05", "06")), (None, None)]
    df = spark.createDataFrame(rows, f"done {part}, revised {part}")
    got = [r[0] for r in df.select(L.completion_date(F.col("done"), F.col("revised"))).collect()]
    assert got == [datetime.date(2019, 1, 31), datetime.date(2020, 5, 6), None]


def test_mean_vectors_by_both_routes(spark):
    docs = spark.createDataFrame(
        [(1, ["a", "a", "b", "zz"]), (2, ["zz"]), (3, None), (4, [])], "id long, tokens array<string>"
    )
    words = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [4.0, 3.0]), ("c", [9.0, 9.0])], "word string, vec array<float>")
    want = {1: (3, [2.0, 1.0]), 2: (0, [0.0, 0.0]), 3: (0, [0.0, 0.0]), 4: (0, [0.0, 0.0])}
    for bound in (100, 0):
        got = mean_vectors(docs, "id", "tokens", words, 2, max_broadcast_words=bound).collect()
        assert {r.id: (r.n_words, r.vec) for r in got} == want


def test_unknown_words_with_digit(spark):
    docs = spark.createDataFrame([(1, ["a1", "b2", "b2", "c"])], "id long, tokens array<string>")
    words = spark.createDataFrame([("a1", [1.0])], "word string, vec array<float>")
    assert [r.word for r in unknown_words_with_digit(docs, "id", "tokens", words).collect()] == ["b2"]

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovemark.catalog.clusters import halves
from grovemark.operators import flat, scope
from grovemark.plans.corpus import cluster_corpus, discover_stop_words


def points(spark, n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = int(i % 3 == 0)
        rows.append((i, [float(x) for x in rng.normal(size=3) + (6 * y - 3)], y))
    return spark.createDataFrame(rows, "id long, vec array<double>, y int")


def test_separable_points(spark):
    model = scope.fit_linear_svm(points(spark, 90, 1), "vec", "y")
    row = scope.test_scores(model, points(spark, 60, 2), "vec", "y").head()
    assert row.accuracy == 1.0 and row.f1 == 1.0
    signs = scope.decisions(model, points(spark, 60, 2), "vec").filter((F.col("decision") > 0) != (F.col("y") == 1))
    assert signs.count() == 0


def test_rounds(spark):
    got = scope.annotation_rounds(points(spark, 90, 1), points(spark, 30, 2), "id", "vec", "y", rounds=2, batch=40)
    rows = got.orderBy("round").collect()
    assert [r.round for r in rows] == [0, 1] and all(r.tp + r.fp + r.fn + r.tn == 30 for r in rows)


def test_training_sizes(spark):
    got = scope.scores_by_training_size(points(spark, 90, 1), points(spark, 30, 2), "id", "vec", "y", [20, 60])
    assert sorted(r.n_train for r in got.collect()) == [20, 60]


def test_stop_words_and_corpus(spark):
    inside, outside = ["insulin", "glucose", "diabetes"], ["the", "of", "weather", "rain"]
    table = [(w, [1.0, 0.1 * i]) for i, w in enumerate(inside)] + [(w, [-1.0, 0.1 * i]) for i, w in enumerate(outside)]
    vectors = spark.createDataFrame(table, "word string, vec array<float>")
    notes = [(i, [w], w in inside) for i, w in enumerate(inside + outside[:2])]
    annotations = spark.createDataFrame(notes, "id long, tokens array<string>, inRel boolean")
    texts = [(1, "Insulin", "of the glucose"), (2, "weather", "rain unknown"), (3, "glucose", "diabetes."), (4, "rain", None)]
    articles = spark.createDataFrame(texts, "id long, title string, abstract string")
    stop = discover_stop_words(annotations, articles, "id", vectors, 2, c=1.0)
    assert {r.word for r in stop.collect()} == {"of", "the", "weather", "rain"}
    made = cluster_corpus(articles, "id", vectors, 2, 3, stop)
    groups = {r.id: r.class_predict for r in made.labelled.collect()}
    assert made.n_leaves == 4 and groups[1] == groups[3] and len(set(groups.values())) == 3


def test_one_class_and_no_rows(spark):
    train = points(spark, 30, 1).withColumn("y", F.lit(0))
    row = scope.scores_by_training_size(train, points(spark, 30, 2), "id", "vec", "y", [10]).first()
    assert (row.tp, row.fp, row.fn, row.tn) == (0, 0, 10, 20) and row.f1 == 0
    with pytest.raises(ValueError):
        scope.fit_linear_svm(train.limit(0), "vec", "y")


def test_k_means_on_separable_groups(spark):
    rng = np.random.default_rng(5)
    angles = [0.2, 0.9, np.pi + 0.2, np.pi + 0.9]  # two pairs of groups, as bisection can part them
    centres = 10 * np.array([[np.cos(a), np.sin(a)] for a in angles])
    rows = [(i, [float(x) for x in centres[i % 4] + 0.1 * rng.normal(size=2)]) for i in range(80)]
    rows += [(100, [0.0] * 2), (101, None)]
    table = spark.createDataFrame(rows, "id long, vec array<double>")
    for distance in ("cosine", "euclidean"):
        for parts in (1, 5):
            got = {r.id: r.prediction for r in flat.bisecting_k_means(table.repartition(parts), "vec", 4, distance=distance).collect()}
            groups = {frozenset(i for i in range(80) if got[i] == c) for c in {got[i] for i in range(80)}}
            assert groups == {frozenset(range(k, 80, 4)) for k in range(4)} and got[101] is None
            assert (got[100] is None) == (distance == "cosine")


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_fitted_plane_is_nearly_the_best(spark, folder):
    train, _ = halves(spark, f"/root/testdata/{folder}")
    model = scope.fit_linear_svm(train, "embedding", "flag")
    found = scope.duality_gap(model, train, "embedding", "flag").head()
    assert found.dual > 0 and -1e-9 <= found.gap <= 0.02 * found.primal


def test_gap_of_a_worse_plane_is_larger(spark):
    train, _ = halves(spark, "/root/testdata/sf0.001")
    train = train.select("vec_id", "embedding", "flag")
    worse = scope.fit_linear_svm(train, "embedding", "flag", max_iter=1)
    better = scope.fit_linear_svm(train, "embedding", "flag")
    gaps = [scope.duality_gap(model, train, "embedding", "flag").head().gap for model in (worse, better)]
    assert gaps[0] > 2 * gaps[1]


def test_stop_words_make_the_word_vectors_once(spark):
    """Vectors that are costly to make are read from a table wherever they are needed."""
    turns = spark.createDataFrame([(k, ["good", "fine"] if k % 2 else ["bad", "poor"], bool(k % 2)) for k in range(40)], "id long, tokens array<string>, inRel boolean")
    articles = spark.createDataFrame([(1, "Good", "poor fine."), (2, "bad", "other")], "doc_id long, title string, abstract string")
    words = spark.createDataFrame([("good", 1.0), ("fine", 0.9), ("bad", -1.0), ("poor", -0.8), ("unseen", -1.0)], "word string, x double")
    vectors = words.select("word", F.array(F.col("x").cast("float"), F.length(F.sha2("word", 256)).cast("float") * 0).alias("vec"))
    found = discover_stop_words(turns, articles, "doc_id", vectors, 2, c=1.0)
    assert "sha2" not in found._jdf.queryExecution().toString()
    assert sorted(r.word for r in found.collect()) == ["bad", "poor"]

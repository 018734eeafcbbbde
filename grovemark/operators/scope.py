"""Linear classifiers over mean word vectors: words out of scope, and rounds of annotation."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovemark.operators.metrics import binary_scores, confusion
from grovemark.operators.sampling import sample_exact, sample_per_class
from grovemark.session import cut

ROWS_PER_TASK = 20_000
MAX_PARALLEL_FITS = 5


def with_features(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vec).cast("array<double>")))


def fit_linear_svm(
    training: DataFrame, vec: str, label: str, c: float = 1.0, max_iter: int = 100, tol: float = 1e-4
) -> LinearSVCModel:
    """A linear support vector machine with penalty c per row (the sum of losses is turned into a mean)."""
    rows = cut(with_features(training, vec).select("features", F.col(label).cast("double").alias("label")))
    n = rows.count()
    if n == 0:
        raise ValueError("there are no training rows")
    # Every step of the optimiser is a job, so a small training set should not be many tasks.
    rows = rows.coalesce(math.ceil(n / ROWS_PER_TASK))
    return LinearSVC(
        regParam=1.0 / (c * n), maxIter=max_iter, tol=tol, standardization=False, fitIntercept=True
    ).fit(rows)


def decisions(model: LinearSVCModel, df: DataFrame, vec: str) -> DataFrame:
    """Add decision, the signed distance to the separating plane, and prediction."""
    scored = model.transform(with_features(df, vec))
    return scored.withColumn("decision", vector_to_array("rawPrediction")[1]).drop("features", "rawPrediction")


def stop_words(model: LinearSVCModel, vocabulary: DataFrame, word_vectors: DataFrame) -> DataFrame:
    """(word): words of a corpus on the negative side of the plane. Each distinct word is scored once."""
    known = word_vectors.join(vocabulary.select("word").distinct(), "word", "left_semi")
    return decisions(model, known, "vec").filter("decision < 0").select("word")


def test_scores(model: LinearSVCModel, test: DataFrame, vec: str, label: str) -> DataFrame:
    return binary_scores(confusion(decisions(model, test, vec), label, "prediction"))


def _scores_of_each(names: list[int], name: str, trainings: list[DataFrame], test: DataFrame, vec: str, label: str) -> DataFrame:
    """One row of test scores per training set. The fits do not depend on each other, so their jobs overlap.

    A training set with one class only predicts that class for every row.
    """

    def scored(training: DataFrame) -> DataFrame:
        classes = [row[0] for row in training.select(F.col(label).cast("double")).distinct().limit(2).collect()]
        if len(classes) == 1:
            return binary_scores(confusion(test.withColumn("prediction", F.lit(classes[0])), label, "prediction"))
        return test_scores(fit_linear_svm(training, vec, label), test, vec, label)

    with ThreadPoolExecutor(MAX_PARALLEL_FITS) as pool:
        scores = list(pool.map(scored, trainings))
    rows = [row.select(F.lit(value).alias(name), "*") for value, row in zip(names, scores)]
    return reduce(DataFrame.unionByName, rows)


def annotation_sets(train: DataFrame, key: str, label: str, rounds: int = 5, batch: int = 100, n_negative: int = 50, seed: int = 0) -> list[DataFrame]:
    """The training rows of each round, a row as often as it was annotated.

    Every round annotates batch more random training rows (a row can come again) and trains on all positive
    annotations and up to n_negative negative ones.
    """
    annotated, trainings = [], []
    for i in range(rounds):
        new = cut(sample_exact(train, key, batch, seed + i))
        annotated.append(new.withColumn("_copy", F.concat(F.lit(f"{i}:"), F.col(key).cast("string"))))
        pool = reduce(DataFrame.unionByName, annotated)
        trainings.append(sample_per_class(pool, "_copy", label, {1: None, 0: n_negative}, seed + i))
    return trainings


def annotation_rounds(
    train: DataFrame,
    test: DataFrame,
    key: str,
    vec: str,
    label: str,
    rounds: int = 5,
    batch: int = 100,
    n_negative: int = 50,
    seed: int = 0,
) -> DataFrame:
    """One row of test scores per round of annotation_sets."""
    train, test = cut(train.select(key, vec, label)), cut(test.select(vec, label))
    trainings = annotation_sets(train, key, label, rounds, batch, n_negative, seed)
    return _scores_of_each(list(range(rounds)), "round", trainings, test, vec, label)


def sets_by_size(train: DataFrame, key: str, sizes: list[int], seed: int = 0) -> list[DataFrame]:
    """A training set for each size; a smaller one is part of every larger one."""
    return [sample_exact(train, key, size, seed) for size in sizes]


def scores_by_training_size(
    train: DataFrame, test: DataFrame, key: str, vec: str, label: str, sizes: list[int], seed: int = 0
) -> DataFrame:
    """One row of test scores per training size."""
    train, test = cut(train.select(key, vec, label)), cut(test.select(vec, label))
    return _scores_of_each(sizes, "n_train", sets_by_size(train, key, sizes, seed), test, vec, label)


def duality_gap(model: LinearSVCModel, training: DataFrame, vec: str, label: str, c: float = 1.0, steps: int = 40) -> DataFrame:
    """(primal, dual, gap): how far at most the fitted plane is from the best one, in the objective it was fitted to.

    The objective is the mean hinge loss plus half of 1 / (c n) times the squared length of the weights. Weights between 0 and
    1 / n for the rows, with equal sums in both classes, bound it from below. They are taken from the margins: 1 / n inside
    the margin, 0 beyond it and a share on a band around it, whose width is the best of `steps` halvings; the larger class
    is scaled down to the sum of the smaller one. A share cannot change which bound holds, only how close it is.
    """
    y = F.when(F.col(label).cast("double") > 0.5, 1.0).otherwise(-1.0)
    rows = training.select(y.alias("y"), F.col(vec).cast("array<double>").alias("x"))
    w, intercept = model.coefficients.toArray(), model.intercept
    best = (-math.inf, 0.0)
    bands, width = 2.0 ** -np.arange(steps), 1 + len(w)

    def summed(batches):
        total, seen = np.zeros((2, steps, width)), np.zeros(2)
        for batch in batches:
            sign = batch.column(0).to_numpy()
            x = np.asarray(batch.column(1).flatten(), float).reshape(-1, width - 1)
            m = sign * (x @ w + intercept)
            seen += len(m), np.maximum(1 - m, 0).sum()
            shares = np.clip((1 + bands[:, None] - m) / (2 * bands[:, None]), 0, 1)
            for k, own in enumerate((sign > 0, sign < 0)):
                total[k] += shares[:, own] @ np.column_stack([np.ones(own.sum()), x[own]])
        cells = np.concatenate([total.ravel(), seen])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "value"])

    cells = rows.mapInArrow(summed, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    found = np.zeros(2 * steps * width + 2)
    for row in cells.collect():  # two classes, steps bands, a sum for each dimension
        found[row["cell"]] = row["value"]
    n, loss = found[-2:].tolist()
    weight = 1.0 / (c * n)
    primal = loss / n + weight / 2 * float(w @ w)
    found = found[:-2].reshape(2 * steps, width)
    for above, below in zip(found[:steps], found[steps:]):
        total = float(min(above[0], below[0]))
        if total > 0:
            pull = total * (above[1:] / above[0] - below[1:] / below[0]) / n
            # Any part of these weights is allowed too; this is the best part.
            length = float(pull @ pull) / weight
            part = min(1.0, 2 * total / n / length) if length > 0 else 1.0
            best = max(best, (part * 2 * total / n - part * part * length / 2, part))
    dual = max(best[0], 0.0)
    return rows.sparkSession.createDataFrame([(primal, dual, primal - dual)], "primal double, dual double, gap double")

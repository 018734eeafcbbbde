"""A quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a row of numeric features, each cut into bins at quantiles. Boosting goes round the features: a shallow
tree over one feature's bins is fitted to what the model leaves open and added to that feature's lookup table. Then the
pairs of features with the strongest interaction get tables of their own in the same way, by trees with one cut in each
feature. A score is the logistic function of the intercept and the sum of one entry of each table, so scoring is a lookup
and an addition for each bin, over whole columns.

The model is fitted on the `sample_rows` labelled rows with the smallest hash of the id (the bound of what reaches the
driver: that many rows of features); every text is scored, in one pass without a shuffle.

Defined cases: a null text is an empty one, whose features are all 0; labels other than 0 and 1 count as null and teach
nothing; where an id has several labels their mean counts; if only one class is labelled its share, drawn in by one row of
each class, is every score; without labels every score is 0.5; rows that repeat and null ids are rows like others.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovemark.llm.columns import unused

FEATURES = (
    "log_bytes", "log_words", "word_length", "letters", "capitals", "digits", "spaces", "marks", "beyond_ascii", "distinct_words",
    "top_word", "bare_marks", "marked_ends", "short_words", "line_length", "repeated_lines", "distinct_pairs", "capital_starts",
)
BARE = re.compile(rb"[0-9A-Za-z\x80-\xff]")  # a word without any of these is of marks only
BYTE_CLASSES = np.zeros((256, 6))
for _k, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c")):
    BYTE_CLASSES[list(_set), _k] = 1
BYTE_CLASSES[128:, 4] = 1
BYTE_CLASSES[33:127, 5] = 1 - BYTE_CLASSES[33:127, :3].sum(axis=1)


def features(text: str | None) -> list[float]:
    """The numbers in FEATURES for one text."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    small, large, digit, space, beyond, mark = (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ BYTE_CLASSES).tolist()
    size, n = len(data), len(words)
    solid, letters = size - space, small + large
    distinct = Counter(words)
    forms = list(distinct.items())
    bare = sum(k for w, k in forms if not BARE.search(w))
    ends = sum(k for w, k in forms if len(w) > 2 and w[-1] < 128 and w[-2] < 128 and not chr(w[-1]).isalnum() and not chr(w[-2]).isalnum())
    short = sum(k for w, k in forms if len(w) <= 3)
    starts = sum(k for w, k in forms if 65 <= w[0] <= 90)
    lines = [line for line in data.split(b"\n") if line]
    return [
        np.log1p(size), np.log1p(n), solid / n, letters / solid, large / max(1.0, letters), digit / solid, space / size, mark / solid,
        beyond / solid, len(forms) / n, max(distinct.values()) / n, bare / n, ends / n, short / n, np.log1p(size / len(lines)),
        1 - len(set(lines)) / len(lines), len(set(zip(words, words[1:]))) / max(1, n - 1), starts / n,
    ]


class Model(NamedTuple):
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        if self.edges:
            fine = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]
            wide = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.coarse)]
            for f, table in enumerate(self.tables):
                total += table[fine[f]]
            for (f, g), table in self.pairs.items():
                total += table[wide[f], wide[g]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def best_cut(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, int]:
    """The gain of the best cut of a row of bins, and the bin at which its right side begins."""
    g, h = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
    if not len(g):
        return 0.0, 0
    gain = g**2 / (h + ridge) + (grad.sum() - g) ** 2 / (hess.sum() - h + ridge)
    k = int(np.argmax(gain))
    return float(gain[k] - grad.sum() ** 2 / (hess.sum() + ridge)), k + 1


def shallow_tree(grad: np.ndarray, hess: np.ndarray, ridge: float) -> np.ndarray:
    """What a tree of depth two over the bins adds to each bin."""
    parts = [(0, len(grad))]
    for _ in range(2):
        after = []
        for a, b in parts:
            gain, k = best_cut(grad[a:b], hess[a:b], ridge)
            after += [(a, a + k), (a + k, b)] if gain > 1e-9 else [(a, b)]
        parts = after
    out = np.empty(len(grad))
    for a, b in parts:
        out[a:b] = grad[a:b].sum() / (hess[a:b].sum() + ridge)
    return out


def quadrants(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best tree with one cut in each of two features: its gain and what it adds to each cell."""
    best = (0.0, np.zeros_like(grad))
    whole = grad.sum() ** 2 / (hess.sum() + ridge)
    for i in range(1, grad.shape[0]):
        up, down = (grad[:i].sum(axis=0), hess[:i].sum(axis=0)), (grad[i:].sum(axis=0), hess[i:].sum(axis=0))
        sides = [(np.cumsum(g)[:-1], np.cumsum(h)[:-1], g.sum(), h.sum()) for g, h in (up, down)]
        gain = sum(g**2 / (h + ridge) + (tg - g) ** 2 / (th - h + ridge) for g, h, tg, th in sides) - whole
        j = int(np.argmax(gain)) + 1 if len(gain) else 0
        if j and gain[j - 1] > best[0]:
            add = np.empty_like(grad)
            for rows in (slice(None, i), slice(i, None)):
                for cols in (slice(None, j), slice(j, None)):
                    add[rows, cols] = grad[rows, cols].sum() / (hess[rows, cols].sum() + ridge)
            best = (float(gain[j - 1]), add)
    return best


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 250, pair_rounds: int = 60, n_pairs: int = 12, bins: int = 32, coarse_bins: int = 8,
    rate: float = 0.1, ridge: float = 4.0,
) -> Model:
    """The additive model of labels y (0 to 1) on features x."""
    share = (y.sum() + 1) / (len(y) + 2)
    intercept = float(np.log(share / (1 - share))) if len(y) else 0.0
    if len(y) < 2 or np.ptp(y) == 0:
        return Model(intercept, [], [], [], {})
    cuts = lambda n: [np.unique(np.quantile(c, np.arange(1, n) / n)) for c in x.T]
    edges, coarse = cuts(bins), cuts(coarse_bins)
    fine = [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T)]
    wide = [np.searchsorted(e, c, side="right") for e, c in zip(coarse, x.T)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(tables):
            grad, hess = slopes()
            step = rate * shallow_tree(np.bincount(fine[f], grad, len(table)), np.bincount(fine[f], hess, len(table)), ridge)
            table += step
            total += step[fine[f]]

    def cells(f: int, g: int, values: np.ndarray) -> np.ndarray:
        shape = (len(coarse[f]) + 1, len(coarse[g]) + 1)
        return np.bincount(wide[f] * shape[1] + wide[g], values, shape[0] * shape[1]).reshape(shape)

    grad, hess = slopes()
    gains = {(f, g): quadrants(cells(f, g, grad), cells(f, g, hess), ridge)[0] for f, g in combinations(range(len(edges)), 2)}
    chosen = sorted(gains, key=lambda pair: (-gains[pair], pair))[:n_pairs]
    pairs = {pair: np.zeros((len(coarse[pair[0]]) + 1, len(coarse[pair[1]]) + 1)) for pair in chosen}
    for _ in range(pair_rounds):
        for (f, g), table in pairs.items():
            grad, hess = slopes()
            step = rate * quadrants(cells(f, g, grad), cells(f, g, hess), ridge)[1]
            table += step
            total += step[wide[f], wide[g]]
    return Model(intercept, edges, tables, coarse, pairs)


def train(docs: DataFrame, labels: DataFrame, chosen: Column, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = 20_000) -> Model:
    """Fit on the labelled rows for which `chosen`, a condition on the key, holds."""
    wanted = labels.filter(chosen & F.col(key).isNotNull() & F.col(label).isin(0, 1))
    wanted = wanted.groupBy(F.col(key).alias("_key")).agg(F.avg(label).alias("_y"))
    sample = wanted.orderBy(F.xxhash64("_key"), "_key").limit(sample_rows)  # the bound of the broadcast below
    joined = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).join(F.broadcast(sample), "_key")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(value.as_py()) for value in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["y", "x"])

    rows = joined.select("_text", "_y").mapInArrow(made, "y double, x array<double>")
    rows = rows.orderBy(F.xxhash64("x"), "y").limit(sample_rows).collect()
    x = np.array([row["x"] for row in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([row["y"] for row in rows], float))


def score(
    docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3, keep: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")
) -> DataFrame:
    """The columns `keep` (all by default) of docs, with score and predicted, or by the names given for these."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = keep or docs.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(value.as_py()) for value in batch.column(len(kept))]
            found = shared.value.scores(np.array(rows, float).reshape(len(rows), len(FEATURES)))
            added = [pa.array(found), pa.array((found >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *added], names=[*kept, *names])

    both = docs.select(*kept, F.col(text).cast("string").alias(*unused(docs, "_text")))
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in both.dtypes[:-1])
    return both.mapInArrow(scored, f"{kinds}, `{names[0]}` double, `{names[1]}` int")

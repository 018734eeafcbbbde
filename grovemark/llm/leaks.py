"""Benchmark decontamination: CGK embedding and bit-sampling LSH over item-sized windows, verified by edit distance.

Texts and items are sequences of words (runs of letters, digits and underscores, lower-cased). A document holds an item of
W words if some window of W of its words (the whole text, if it has fewer) is within floor(max_share * W) insertions,
deletions and substitutions of words from the item.

Windows that cannot match are left out first, without loss: a window within k edits of an item shares at least
W - q + 1 - q k of its q-grams, with q as large as keeps that positive, at most 3. For every other window the CGK random
walk is taken: step j writes the word at the current place and moves on by a random bit that depends on j and the word, so
that few edits become few differing places. A repetition has a walk of its own and samples `sampled` places of the
embedding; a window and an item of its length meet if they agree there in any repetition. The number of repetitions is set
so that, over random edits of the items at the largest allowed number, at least `recall` of windows meet their item. What
meets is verified by the exact distance.

The documents are read in one pass without a shuffle. Items go to the tasks in slices of at most MAX_WORDS words; a larger
benchmark takes one pass for each slice, so what is broadcast stays bounded.

Defined cases: null or empty texts hold nothing; null or empty items are in nothing; rows with one id, and items with one
id, are rows and items of their own; texts of any length are taken whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovemark.llm.columns import unused

MAX_WORDS = 2_000_000
WORD = re.compile(r"\w+")
STRETCH = 3  # steps of a walk for each word
SAMPLED = 2
MAX_REPETITIONS = 128
END = -1  # what a walk writes after its last word


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sampled_keys(rows: np.ndarray, width: int, repetitions: int) -> np.ndarray:
    """[row, repetition]: a hash of the sampled places of each row's embedding; rows hold words as numbers."""
    n, length = rows.shape
    rng = np.random.default_rng(width)
    places = np.sort(rng.integers(0, STRETCH * width, (repetitions, SAMPLED)), axis=1)
    salts = rng.integers(0, 2**63, repetitions, dtype=np.uint64)
    padded = np.concatenate([rows, np.full((n, 1), END)], axis=1).astype(np.int64)
    at = np.zeros((n, repetitions), np.int64)
    keys = np.zeros((n, repetitions), np.uint64)
    index = np.arange(n)[:, None]
    for step in range(int(places.max(initial=-1)) + 1):
        word = padded[index, at].astype(np.uint64)
        taken = (places == step).any(axis=1)
        if taken.any():
            keys[:, taken] = mixed(keys[:, taken] * np.uint64(31) + word[:, taken] + np.uint64(1))
        move = mixed(word * np.uint64(0x9E3779B97F4A7C15) + salts + np.uint64(step)) >> np.uint64(63)
        at = np.minimum(at + move.astype(np.int64), length)
    return keys


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The edit distance of each row of a from the same row of b."""
    n, width = b.shape
    column = np.arange(width + 1)
    before = np.tile(column, (n, 1))
    for k in range(a.shape[1]):
        step = np.empty_like(before)
        step[:, 0] = k + 1
        step[:, 1:] = np.minimum(before[:, 1:] + 1, before[:, :-1] + (a[:, k, None] != b))
        before = np.minimum.accumulate(step - column, axis=1) + column
    return before[:, -1]


def allowed_edits(width: int, max_share: float) -> int:
    return int(max_share * width + 1e-9)


def randomly_edited(row: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """row after so many random edits, at its own length again."""
    out = row.tolist()
    for kind in rng.integers(0, 3, edits):
        place = int(rng.integers(0, len(out) + 1)) if kind == 1 or not out else int(rng.integers(0, len(out)))
        if kind == 1:
            out.insert(place, 0)
        elif kind == 2 and out:
            del out[place]
        elif out:
            out[place] = 0
    return np.array((out + [0] * len(row))[: len(row)])


class Items:
    """The items of one slice: words as numbers from 1, by length; what tells which windows are worth a walk."""

    def __init__(self, rows: list[tuple[int, str]], max_share: float, recall: float):
        self.vocabulary: dict[str, int] = {}
        self.by_width: dict[int, tuple[list[int], np.ndarray]] = {}
        sequences = []
        for number, (item, text) in enumerate(rows):
            found = words_of(text)
            if found:
                sequences.append((item, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found]))
        grouped: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
        for item, sequence in sequences:
            grouped[len(sequence)].append((item, sequence))
        self.base = len(self.vocabulary) + 1
        self.grams: dict[int, dict[int, list[tuple[int, int]]]] = {}
        self.need, self.edits, self.q = {}, {}, {}
        for width, members in grouped.items():
            self.by_width[width] = ([item for item, _ in members], np.array([s for _, s in members], np.int64))
            k = allowed_edits(width, max_share)
            q = max(1, min(3, width // (k + 1)))
            self.edits[width], self.q[width], self.need[width] = k, q, max(1, width - q + 1 - q * k)
            for n, (_, s) in enumerate(members):
                for code in {self.code(s[p : p + q]) for p in range(width - q + 1)}:
                    self.grams.setdefault(q, {}).setdefault(code, []).append((width, n))
        self.sorted_codes = {q: np.array(sorted(found), np.int64) for q, found in self.grams.items()}
        self.repetitions = self.enough_repetitions(recall)
        self.keys = {width: sampled_keys(rows, width, self.repetitions) for width, (_, rows) in self.by_width.items()}

    def code(self, words) -> int:
        code = 0
        for word in words:
            code = code * self.base + word
        return code

    def enough_repetitions(self, recall: float) -> int:
        """The smallest number for which random edits leave at least `recall` of up to 400 items meeting themselves."""
        rng, met = np.random.default_rng(5), []
        for width, (_, rows) in sorted(self.by_width.items()):
            rows = rows[: max(1, 400 // len(self.by_width))]
            edited = np.stack([randomly_edited(row, self.edits[width], rng) for row in rows])
            met.append(sampled_keys(rows, width, MAX_REPETITIONS) == sampled_keys(edited, width, MAX_REPETITIONS))
        if not met:
            return 1
        reached = np.maximum.accumulate(np.concatenate(met), axis=1).mean(axis=0)
        return int(np.argmax(reached >= recall)) + 1 if reached[-1] >= recall else MAX_REPETITIONS

    def worthwhile(self, words: np.ndarray, start: np.ndarray) -> dict[int, set[tuple[int, int]]]:
        """By width, the (document, first word) of the windows that share enough q-grams with some item of that width."""
        out: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for q, codes in self.sorted_codes.items():
            if len(words) < q:
                continue
            value, known = np.zeros(len(words) - q + 1, np.int64), np.ones(len(words) - q + 1, bool)
            for k in range(q):
                part = words[k : len(words) - q + 1 + k]
                known &= part > 0
                value = value * self.base + part
            at = np.flatnonzero(known)
            at = at[codes[np.minimum(np.searchsorted(codes, value[at]), len(codes) - 1)] == value[at]]
            document = np.searchsorted(start, at, side="right") - 1
            held: dict[tuple[int, int, int], list[int]] = defaultdict(list)
            for place, doc, code in zip(at.tolist(), document.tolist(), value[at].tolist()):
                if place + q <= start[doc + 1]:
                    for width, n in self.grams[q][code]:
                        held[doc, width, n].append(place - int(start[doc]))
            for (doc, width, _), hits in held.items():
                need, size = self.need[width], int(start[doc + 1] - start[doc])
                for k in range(len(hits) - need + 1):
                    first, last = hits[k], hits[k + need - 1]
                    if last - first <= width - q:
                        for s in range(max(0, last - width + q), min(first, max(0, size - width)) + 1):
                            out[width].add((doc, s))
        return out

    def matches(self, words: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item, first word, width of the window, distance) of all verified windows."""
        for width, windows in self.worthwhile(words, start).items():
            by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for doc, s in sorted(windows):
                by_length[min(width, int(start[doc + 1] - start[doc]))].append((doc, s))
            names, items = self.by_width[width]
            for length, found in by_length.items():
                for k in range(0, len(found), 20_000):
                    some = np.array(found[k : k + 20_000])
                    rows = words[(start[some[:, 0]] + some[:, 1])[:, None] + np.arange(length)]
                    keys, met = sampled_keys(rows, width, self.repetitions), set()
                    for r in range(self.repetitions):
                        order = np.argsort(self.keys[width][:, r], kind="stable")
                        ranked = self.keys[width][order, r]
                        low, high = np.searchsorted(ranked, keys[:, r]), np.searchsorted(ranked, keys[:, r], side="right")
                        for w in np.flatnonzero(high > low):
                            met.update((int(w), int(i)) for i in order[low[w] : high[w]])
                    if met:
                        w, i = np.array(sorted(met)).T
                        distance = edit_distances(rows[w], items[i])
                        for hit in np.flatnonzero(distance <= self.edits[width]):
                            doc, s = found[k + w[hit]]
                            yield doc, names[i[hit]], s, length, int(distance[hit])


def leaks_of_slice(docs: DataFrame, items: Items) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            ids, texts, rows = batch.column(0), batch.column(1), []
            for first in range(0, len(ids), 1_000):
                part = [value.as_py() for value in texts[first : first + 1_000]]
                listed = [words_of(text) for text in part]
                start = np.concatenate(([0], np.cumsum([len(w) for w in listed])))
                words = np.fromiter((n for w in listed for n in map(items.vocabulary.get, w, repeat(0))), np.int64, int(start[-1]))
                best: dict[tuple[int, int], tuple[int, int, int]] = {}
                for doc, item, s, length, distance in items.matches(words, start):
                    best[doc, item] = min(best.get((doc, item), (distance, s, length)), (distance, s, length))
                for (doc, item), (distance, s, length) in sorted(best.items()):
                    places = [m.span() for m in WORD.finditer(part[doc].lower())]
                    rows.append((ids[first + doc].as_py(), item, distance, length, places[s][0], places[s + length - 1][1]))
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            names = ["doc_id", "item_id", "distance", "n_words", "start", "end"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return docs.mapInArrow(found, "doc_id long, item_id long, distance int, n_words int, start int, end int")


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    max_share: float = 0.2, recall: float = 0.999,
) -> DataFrame:
    """(doc_id, item_id, distance, n_words, start, end) for every document and item it holds: the nearest window, then the first.

    start and end count characters of the lower-cased text, which are code points of the text wherever lower-casing keeps
    its length.
    """
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    items = benchmark.select(F.col(item_key).cast("long").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    made, held, size = None, [], 0
    for row in items.orderBy("item", "text").toLocalIterator():
        held.append((row["item"], row["text"]))
        size += len(row["text"].split())
        if size >= MAX_WORDS:
            part = leaks_of_slice(narrow, Items(held, max_share, recall))
            made, held, size = part if made is None else made.unionByName(part), [], 0
    if held or made is None:
        part = leaks_of_slice(narrow, Items(held, max_share, recall))
        made = part if made is None else made.unionByName(part)
    return made


def remove_leaks(docs: DataFrame, leaks: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without the documents that hold an item. Rows with a null key are kept unless such a row holds one."""
    (name,) = unused(docs, "_held")
    held = leaks.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(held, F.col(key).cast("long").eqNullSafe(F.col(name)), "left_anti")

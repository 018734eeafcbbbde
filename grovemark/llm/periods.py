"""Periodic runs of words, found by block convolution.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of max(`least_words`,
`repeats` q) words or more, that no neighbouring word extends. Words are coded as numbers, and the texts of a batch are laid
end to end, parted by numbers that occur once, so that no run crosses from one text into the next.

For each block length B = 1, 2, 4, ... the sequence is cut into blocks of B words. A run with B <= q < 2B and at least four
periods holds a whole block that occurs again q words later, so the occurrences of each block at the distances B to 2B - 1
are looked for: the sum of squared differences of a block and every stretch of the window behind it is a sum of squares
less twice a correlation, and the correlations of all blocks come from number-theoretic transforms over a prime field, in
integers. The sum is zero where block and stretch agree; it may be zero by chance only where it is a multiple of the prime,
and the stretches found are compared word by word, so the result is exact. Blocks with a word that does not come back
within 2B words cannot occur again and are left out. Adjacent blocks with the same distance belong to one stretch, which
then reaches less than B words beyond them on either side; these are compared directly. A stretch whose distance is a
multiple of the period of a shorter-period run over the same words is that run again.

Texts do not move: each task works on the rows it reads, a bounded number of words (or one text) at a time.

Defined cases: a null text has no words; texts without words, with fewer words than a run needs, and empty tables have no
runs; texts of any length are taken whole; equal rows are rows of their own; null ids stay null; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = 998_244_353  # 119 * 2^23 + 1, so it has roots of unity of every order up to 2^23
GENERATOR = 3
SLAB_WORDS = 400_000  # words worked on at a time, unless one text has more
CELLS = 1 << 19  # numbers transformed at a time
SPACES = "[\\x20\\x09-\\x0D]+"
RUNS = "array<struct<start:long,length:long,period:long>>"


@lru_cache(maxsize=64)
def powers(half: int, inverse: bool) -> np.ndarray:
    """The first half of the powers of a root of unity of order 2 * half."""
    root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
    root = pow(root, PRIME - 2, PRIME) if inverse else root
    out = np.ones(1, np.uint64)
    while len(out) < half:
        out = np.concatenate([out, out * np.uint64(pow(root, len(out), PRIME)) % np.uint64(PRIME)])
    return out


def forward(rows: np.ndarray) -> np.ndarray:
    """The transform of each row, in bit-reversed order."""
    n, size = rows.shape
    p, half = np.uint64(PRIME), size // 2
    while half:
        pairs = rows.reshape(n, -1, 2, half)
        u, v = pairs[:, :, 0], pairs[:, :, 1]
        out = np.empty_like(pairs)
        out[:, :, 0] = (u + v) % p
        out[:, :, 1] = (u + p - v) * powers(half, False) % p
        rows, half = out.reshape(n, size), half // 2
    return rows


def backward(rows: np.ndarray) -> np.ndarray:
    """The rows from their transforms in bit-reversed order."""
    n, size = rows.shape
    p, half = np.uint64(PRIME), 1
    while half < size:
        pairs = rows.reshape(n, -1, 2, half)
        u, v = pairs[:, :, 0], pairs[:, :, 1] * powers(half, True) % p
        out = np.empty_like(pairs)
        out[:, :, 0] = (u + v) % p
        out[:, :, 1] = (u + p - v) % p
        rows, half = out.reshape(n, size), half * 2
    return rows * np.uint64(pow(size, PRIME - 2, PRIME)) % p


def occurrences(x: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) where the block of `size` numbers of x at starts[block] occurs again, for distances in
    [size, 2 size); by convolution, modulo PRIME. x has 3 * size numbers behind every start."""
    p = np.uint64(PRIME)
    found: list[np.ndarray] = []
    for first in range(0, len(starts), max(1, CELLS // (2 * size))):
        at = starts[first : first + max(1, CELLS // (2 * size))]
        block = x[at[:, None] + np.arange(size)]
        window = x[at[:, None] + size + np.arange(2 * size)]
        turned = np.zeros_like(window)
        turned[:, -np.arange(size)] = block  # entry -k (modulo 2 size) holds the k-th number
        product = backward(forward(turned) * forward(window) % p)[:, :size]
        sums = np.cumsum(window * window % p, axis=1)
        sums = np.concatenate([np.zeros((len(at), 1), np.uint64), sums], axis=1)
        there = sums[:, size : 2 * size] - sums[:, :size]
        here = (block * block % p).sum(axis=1, dtype=np.uint64)
        rows, lags = np.nonzero((here[:, None] + there) % p == product * np.uint64(2) % p)
        found.append(np.stack([rows + first, lags + size]))
    return tuple(np.concatenate(found, axis=1)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def reach(x: np.ndarray, at: np.ndarray, distance: np.ndarray, step: int, most: int) -> np.ndarray:
    """How many of the numbers at, at + step, at + 2 step, ... equal those `distance` further on, up to `most`."""
    out = np.zeros(len(at), np.int64)
    rows = max(1, CELLS // most)
    for first in range(0, len(at), rows):
        part = slice(first, first + rows)
        here = at[part, None] + step * np.arange(most)
        there = here + distance[part, None]
        inside = (here >= 0) & (there < len(x))
        same = inside & (x[np.where(inside, here, 0)] == x[np.where(inside, there, 0)])
        out[part] = np.where(same.all(axis=1), most, (~same).argmax(axis=1))
    return out


def stretches(x: np.ndarray, start: int, end: int, distance: int) -> list[tuple[int, int]]:
    """The parts of [start, end) whose numbers equal those `distance` further on: one unless a zero was by chance."""
    differ = np.flatnonzero(x[start:end] != x[start + distance : end + distance])
    edges = [start - 1, *(differ + start).tolist(), end]
    return [(a + 1, b) for a, b in zip(edges, edges[1:]) if b > a + 1]


def next_gaps(x: np.ndarray) -> np.ndarray:
    """How far on each number occurs again; far beyond the end where it does not."""
    order = np.argsort(x, kind="stable")
    gaps = np.full(len(x), 4 * len(x) + 4)
    again = x[order[1:]] == x[order[:-1]]
    gaps[order[:-1][again]] = (order[1:] - order[:-1])[again]
    return gaps


def sequence_runs(x: np.ndarray, longest: int, least_words: int = 6, repeats: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of x, by start, then period; no run has more than `longest` numbers.

    Numbers are below PRIME. repeats is four or more, which the choice of blocks rests on.
    """
    if repeats < 4:
        raise ValueError("blocks find runs of four periods or more")
    n, gaps, size = len(x), next_gaps(x), 1
    runs: dict[tuple[int, int], int] = {}
    owner, known = np.full(n, -1), []
    while repeats * size <= longest:
        blocks = n // size
        back = gaps[: blocks * size].reshape(blocks, size).max(axis=1) < 2 * size
        starts = np.flatnonzero(back) * size
        if len(starts):
            beyond = np.full(3 * size, PRIME - 1, np.uint64)  # no number of x
            block, distance = occurrences(np.concatenate([x.astype(np.uint64), beyond]), starts, size)
            at = starts[block]
        if len(starts) and len(at):
            order = np.lexsort((at, distance))
            at, distance = at[order], distance[order]
            new = np.ones(len(at), bool)
            new[1:] = (distance[1:] != distance[:-1]) | (at[1:] != at[:-1] + size)
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(at)) - 1
            low, high, period = at[heads], at[tails] + size, distance[heads]
            inside = high + period <= n
            own = owner[np.minimum(low, n - 1)]
            if known:
                ends, periods = np.array(known).T
                inside &= ~((own >= 0) & (ends[own] >= high + period) & (period % periods[own] == 0))
            low, high, period = low[inside], high[inside], period[inside]
            left = reach(x, low - 1, period, -1, size)
            right = reach(x, high, period, 1, size)
            made = []
            for a, b, q in zip((low - left).tolist(), (high + right).tolist(), period.tolist()):
                if b - a + q >= max(least_words, repeats * q):
                    made += [(s, e - s + q, q) for s, e in stretches(x, a, b, q)]
            for s, length, q in made:
                if length >= max(least_words, repeats * q) and (s, length) not in runs:
                    runs[s, length] = q
                    owner[s : s + length] = len(known)
                    known.append((s + length, q))
        size *= 2
    return sorted(((s, length, q) for (s, length), q in runs.items()), key=lambda r: (r[0], r[2]))


def batch_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as its words."""
    code: dict = defaultdict(count().__next__)
    flat: list[int] = []
    starts = []
    for k, words in enumerate(texts):
        starts.append(len(flat))
        flat.extend(map(code.__getitem__, words))
        flat.append(code[k])  # a number of its own between texts: words are bytes, never integers
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = sequence_runs(np.array(flat, np.int64), max(map(len, texts), default=0))
    home = np.searchsorted(starts, [start for start, _, _ in found], side="right") - 1
    for k, (start, length, period) in zip(home.tolist(), found):
        out[k].append((start - starts[k], length, period))
    return out


def collapsed_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run has after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return list(compress(words, (np.cumsum(change)[:-1] == 0).tolist()))


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed): every run of each text as (start, length, period) in words, by start, then period, and
    the text without the words that a run repeats, joined by one space."""
    schema = pa.schema([
        ("doc_id", pa.int64()),
        ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
        ("collapsed", pa.string()),
    ])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list = []
            held: list[list[bytes]] = []
            n_words = 0

            def close() -> pa.RecordBatch:
                found = batch_runs(held)
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in one] for one in found]
                rest = [b" ".join(collapsed_words(words, one)).decode() for words, one in zip(held, found)]
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(runs, schema.field(1).type), pa.array(rest, pa.string())], schema=schema)

            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (body.as_py() or "").encode().split()  # bytes part at ASCII white space only
                if held and n_words + len(words) > SLAB_WORDS:
                    yield close()
                    ids, held, n_words = [], [], 0
                ids.append(name)
                held.append(words)
                n_words += len(words)
            if held:
                yield close()

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(made, f"doc_id long, runs {RUNS}, collapsed string")


def planted(key: str, text: str) -> Column:
    """The text with repeats laid into a tenth of the documents: with h = crc32 of the id as text, g = h // 10 and n words,
    if h % 10 = 0 and n > 0 each word i >= a becomes word a + (i - a) % p, where a = g % n and
    p = 1 + (n - a) // (3 + g % 8). Other texts, null ones and those with a null id stay as they are."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.array_remove(F.split(F.col(text), SPACES), "")
    n = F.size(words).cast("long")

    def repeated(state: Column) -> Column:
        w, a, p = state["w"], state["a"], state["p"]
        return F.array_join(F.transform(w, lambda word, i: F.when(i < a, word).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    a = g % n
    state = F.struct(words.alias("w"), a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).cast("long").alias("p"))
    laid = F.get(F.transform(F.array(state), repeated), F.lit(0))
    return F.when(F.coalesce((h % 10 == 0) & (n > 0), F.lit(False)), laid).otherwise(F.col(text))


def run_report(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with the greatest length / period (start, length, period, exponent_milli) and digests."""
    nothing = F.lit(None).cast("struct<start:long,length:long,period:long>")
    larger = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    best = F.aggregate("runs", nothing, lambda best, run: F.when(larger(best, run), run).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("best"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )

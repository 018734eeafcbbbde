"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors gives a graph of nearest neighbours. The graph is cut into balanced parts, so that
neighbours mostly lie in the same part and no part is more than a little larger than the mean; a small softmax classifier
learns the part of a vector. The number of parts grows with the square root of the rows: where it passes PARTS, each part
is parted again in the same way by a sample of its own rows, in a task of its own, and the probability of a leaf is the
product along its path. Every row is filed under its most probable leaf; a query is sent to its most probable leaves, as
many as MEASURED_ROWS sampled rows need for the target recall of their true neighbours in the whole table, and is ranked there by the exact inner product.

A leaf may hold many rows; they are cut into blocks by a hash, and a query meets every block of its leaves. A candidate is
moved once: rows and queries are shuffled to their block and sorted, so that a task holds one block and the queries stream
past it. Of equal vectors only the k + 1 smallest ids can ever be among the best k of a query, so the others need not be
compared: a vector that holds a third of all rows costs k + 1 of them. A block gives the best k of each of its queries.

Defined cases: vectors that are null, empty, zero, of another length than most, or that hold a null or a number that is
not finite take no part; equal scores go to the smaller id; a repeated id is a row of its own; with fewer candidates than
k all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovemark.session import cut

SAMPLE_ROWS = 6_000
PARTS = 16
MAX_CHILDREN = 256  # leaves of one part
CHILD_ROWS = 64  # sampled rows a leaf, on average, that part a part again
BLOCK_ROWS = 4_096
MEASURED_ROWS = 256  # rows whose neighbours in the whole table set the number of leaves that are searched


class Router(NamedTuple):
    """A softmax classifier of the parts of a vector; one without parts has a single part."""

    centre: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def log_shares(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) @ self.weights + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


class Tree(NamedTuple):
    """A router of parts and, where there are several leaves a part, a router of the leaves of each part."""

    root: Router
    children: dict[int, Router]
    leaves: int  # of each part

    def log_shares(self, x: np.ndarray) -> np.ndarray:
        """[row, leaf]; leaf k of part p is column p * leaves + k, and a part that has no router has only its first."""
        parts = self.root.log_shares(x)
        if self.leaves == 1:
            return parts
        out = np.full((len(x), parts.shape[1] * self.leaves), -np.inf)
        for part in range(parts.shape[1]):
            child = self.children.get(part)
            own = np.zeros((len(x), 1)) if child is None else child.log_shares(x)
            out[:, part * self.leaves : part * self.leaves + own.shape[1]] = parts[:, [part]] + own
        return out


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """[row, rank]: the rows with the largest inner product, by blocks of rows."""
    out = np.empty((len(x), degree), np.int64)
    for k in range(0, len(x), 1_000):
        near = x[k : k + 1_000] @ x.T
        near[np.arange(len(near)), np.arange(k, k + len(near))] = -np.inf
        out[k : k + 1_000] = np.argpartition(-near, degree - 1, axis=1)[:, :degree]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 0.1) -> np.ndarray:
    """A part for each row: label propagation over the graph with a bound on sizes, from a start by projections."""
    n, most = len(x), int(np.ceil((1 + slack) * len(x) / parts))
    label, rng = np.zeros(n, np.int64), np.random.default_rng(11)
    groups = [np.arange(n)]
    while len(groups) < parts:  # cut the largest group at the median of its main direction
        groups.sort(key=len)
        group = groups.pop()
        spread = x[group] - x[group].mean(axis=0)
        direction = np.linalg.svd(spread.T @ spread)[0][:, 0]
        order = group[np.argsort(spread @ direction, kind="stable")]
        groups += [order[: len(order) // 2], order[len(order) // 2 :]]
    for part, group in enumerate(groups):
        label[group] = part
    heads, tails = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (heads, label[tails]), 1)
        np.add.at(votes, (tails, label[heads]), 1)
        wish = votes.argmax(axis=1)
        gain = votes[np.arange(n), wish] - votes[np.arange(n), label]
        sizes = np.bincount(label, minlength=parts)
        for row in np.argsort(-gain + rng.random(n) * 1e-6):
            if gain[row] <= 0:
                break
            if sizes[wish[row]] < most:
                sizes[label[row]] -= 1
                sizes[wish[row]] += 1
                label[row] = wish[row]
    return label


def softmax_classifier(x: np.ndarray, label: np.ndarray, parts: int, steps: int = 300, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of multinomial logistic regression, by full-batch Adam."""
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    state = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(b), np.zeros_like(b)]]
    target = np.eye(parts)[label]
    for step in range(1, steps + 1):
        z = x @ w + b
        z = np.exp(z - z.max(axis=1, keepdims=True))
        error = (z / z.sum(axis=1, keepdims=True) - target) / len(x)
        for value, grad, (m, v) in zip((w, b), (x.T @ error + 1e-4 * w, error.sum(axis=0)), state):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad**2 - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w, b


def single(width: int) -> Router:
    return Router(np.zeros(width), np.zeros((width, 1)), np.zeros(1))


def fit_router(x: np.ndarray, parts: int) -> Router:
    """Balanced parts of the neighbour graph of x, and a classifier of them."""
    if len(x) < 8 * parts:
        return single(x.shape[1])
    label = balanced_parts(x, neighbour_graph(x, min(16, len(x) - 1)), parts)
    centre = x.mean(axis=0)
    return Router(centre, *softmax_classifier(x - centre, label, parts))


def probes_needed(tree: Tree, filed: DataFrame, x: np.ndarray, ids: np.ndarray, k: int, recall: float) -> int:
    """How many leaves the rows x must be sent to for `recall` of their best k rows in the whole table, found exactly.

    Each task keeps the best k of each of the few rows x, so the shuffle holds len(x) * k rows for each task.
    """
    width = x.shape[1]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, leaf = np.full((len(x), k), -np.inf), np.zeros((len(x), k), np.int32)
        for batch in batches:
            near = x @ matrix(batch.column(1), width).T
            near[ids[:, None] == batch.column(0).to_numpy()[None, :]] = -np.inf
            near = np.concatenate([score, near], axis=1)
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            leaves = np.broadcast_to(batch.column(2).to_numpy(), (len(x), batch.num_rows))
            score, leaf = np.take_along_axis(near, top, axis=1), np.take_along_axis(np.concatenate([leaf, leaves], axis=1), top, axis=1)
        row, column = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(leaf[row, column]), pa.array(score[row, column])], names=["row", "leaf", "score"])

    place = F.expr("row_number() OVER (PARTITION BY row ORDER BY score DESC, leaf)")
    near = filed.select("id", "v", "leaf").mapInArrow(best, "row long, leaf int, score double")
    near = near.withColumn("place", place).filter(F.col("place") <= k).select("row", "leaf").toPandas()
    if not len(near):
        return 1
    ranks = np.argsort(np.argsort(-tree.log_shares(x), axis=1, kind="stable"), axis=1)
    reached = np.cumsum(np.bincount(ranks[near["row"], near["leaf"]], minlength=ranks.shape[1])) / len(near)
    return int(np.searchsorted(reached, min(recall, 1.0) - 1e-12)) + 1


def leaves_of_part(total: int) -> int:
    """About sqrt(total) / 4 leaves in all, a power of two in each part."""
    wanted = total**0.5 / (4 * PARTS)
    return 1 if wanted < 2 else min(MAX_CHILDREN, 1 << int(np.log2(wanted)))


def fit_tree(rows: DataFrame, x: np.ndarray, total: int) -> Tree:
    """The root from the sample x; the children each in a task, from a sample of rows that does not grow with the table."""
    root, leaves = fit_router(x, PARTS), leaves_of_part(total)
    if leaves == 1 or root.weights.shape[1] == 1:
        return Tree(root, {}, 1)
    width, share = x.shape[1], min(1.0, CHILD_ROWS * leaves * PARTS / total)

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = root.log_shares(matrix(batch.column(1), width)).argmax(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=["id", "v", "part"])

    def child(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        fitted = fit_router(np.unique(np.stack(group["v"].to_numpy()), axis=0), leaves)
        return pd.DataFrame([(int(group["part"].iloc[0]), *(a.astype(float).tobytes() for a in fitted))], columns=["part", "centre", "weights", "bias"])

    some = rows.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))
    fitted = some.mapInArrow(parted, "id long, v array<double>, part int").groupBy("part").applyInPandas(child, "part int, centre binary, weights binary, bias binary")
    numbers = lambda data: np.frombuffer(data, float)
    children = {r["part"]: Router(numbers(r["centre"]), numbers(r["weights"]).reshape(width, -1), numbers(r["bias"])) for r in fitted.collect()}  # PARTS at most
    return Tree(root, children, leaves)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): the rows that take part, v as doubles; a table."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(fine & F.col("id").isNotNull())
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return cut(rows.filter(F.size("v") == (sizes[0]["size"] if sizes else 0)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), width)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with the same rows of b; equal rows give equal sums wherever they stand."""
    return np.add.reduce(a * b, axis=1)


def best_of_block(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, own_ids: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of one block for each query, with whole ties at the border told apart by id."""
    for first in range(0, len(queries), 512):
        q, own = queries[first : first + 512], own_ids[first : first + 512]
        near = q @ x.T
        near[own[:, None] == ids[None, :]] = -np.inf
        if len(ids) > k:
            border = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k]
        else:
            border = np.full(len(q), -1e300)
        margin = 1e-9 * (np.abs(border) + np.abs(q).sum(axis=1) * np.abs(x).max())
        rows, cols = np.nonzero((near >= (border - margin)[:, None]) & (near > -np.inf))
        score = exact_scores(q[rows], x[cols])
        order = np.lexsort((ids[cols], -score, rows))
        rows, cols, score = rows[order], cols[order], score[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        top = rank < k
        yield pa.RecordBatch.from_arrays([pa.array(own[rows[top]]), pa.array(ids[cols[top]]), pa.array(score[top])], names=["query_id", "vec_id", "score"])


def ranked(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """The best rows of each block for the queries behind it, in rows sorted by (leaf, block, is_query)."""
    key, held, block = None, [], None
    for batch in batches:
        leaf, number, side, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
        v = matrix(batch.column(4), width)
        change = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(number) != 0) | (np.diff(side) != 0)) + 1
        for a, b in zip([0, *change.tolist()], [*change.tolist(), len(ids)]):
            if a == b:
                continue
            if (leaf[a], number[a]) != key:
                key, held, block = (leaf[a], number[a]), [], None
            if not side[a]:
                held.append((v[a:b], ids[a:b]))
            elif held:
                if block is None:
                    block = [np.concatenate(x) for x in zip(*held)]
                yield from best_of_block(*block, v[a:b], ids[a:b], k)


def first_of_equal(rows: DataFrame, k: int) -> DataFrame:
    """The rows that can be among the best k of a query: of equal vectors those with the k + 1 smallest ids."""
    place = F.expr("row_number() OVER (PARTITION BY v ORDER BY id)")
    return rows.withColumn("place", place).filter(F.col("place") <= k + 1).drop("place")


def search(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, recall: float = 0.96) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows found for each row for which is_query, a condition on `id`, holds.

    recall is what MEASURED_ROWS sampled rows reach; it sets the number of leaves that a query is sent to.
    """
    rows = usable(vectors, key, vector)
    spark, total = rows.sparkSession, rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toPandas()
    x = np.stack(sample["v"].to_numpy()).astype(float)
    tree, width = fit_tree(rows, x, total), x.shape[1]

    def routed(most: int):
        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first in range(0, batch.num_rows, 1_024):
                    some = batch.slice(first, 1_024)
                    shares = tree.log_shares(matrix(some.column(1), width))
                    best = np.argsort(-shares, axis=1, kind="stable")[:, :most].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(list(best), pa.list_(pa.int32()))], names=["id", "v", "leaves"])

        return made

    schema = "id long, v array<double>, leaves array<int>"
    filed = cut(first_of_equal(rows, k).mapInArrow(routed(1), schema).select("id", "v", F.get("leaves", F.lit(0)).alias("leaf")))
    probes = probes_needed(tree, filed, x[:MEASURED_ROWS], sample["id"].to_numpy()[:MEASURED_ROWS], k, recall)
    sizes = filed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))  # PARTS * MAX_CHILDREN rows at most
    sizes = F.broadcast(cut(sizes))
    block = F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int")
    left = filed.join(sizes, "leaf").select("leaf", block.alias("block"), F.lit(0).alias("side"), "id", "v")
    asked = rows.filter(is_query).mapInArrow(routed(probes), schema).select("id", "v", F.explode("leaves").alias("leaf"))
    right = asked.join(sizes, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "id", "v")
    # A set number, because a few bytes mean much work here and small partitions would be united.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    meeting = left.unionByName(right).repartition(tasks, "leaf", "block").sortWithinPartitions("leaf", "block", "side")
    found = meeting.mapInArrow(lambda batches: ranked(batches, width, k), "query_id long, vec_id long, score double")
    place = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)")
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

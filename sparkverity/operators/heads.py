"""Logistic heads for many labels at once: every step is one pass over the rows, whatever the number of labels.

Minimised for each label is the mean log loss plus ``penalty`` / 2 times the squared weights (the bias is
free). Rows are laid out once, in blocks of numbers kept by row and by feature, which all steps read. Tasks
work out the gradients of all labels on their blocks against the weights, which are broadcast (features times
labels numbers, bounded by the vocabulary and the label list); their sums are added up, in a tree if they are
many. Rows that have few labels among many cost their own features times the labels, nothing more; equal
sparse rows are worked on once, weighted by their number.

Up to ``OUTER`` features, as embeddings have: the sum of outer products of the rows is collected once; a
quarter of it bounds the second derivative whatever the weights, so its inverse turns every gradient into a
step that can't overshoot (a Newton step with a fixed matrix). More features, as texts have: steps of 1 /
bound. Both with momentum that starts anew for a label whose steps run uphill, and both end when no weight
moves by more than ``TOLERANCE``.

A label that all rows have, or none, has no finite optimum: its weights are 0, its bias the log odds of its
rows plus one half against the others plus one half. Rows without features are left out; without rows all
weights are 0.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENALTY = 0.01
TOLERANCE = 1e-10
OUTER = 1_024
#: Numbers that are worked on at once; bytes of all tasks' sums that the driver adds up itself.
AT_ONCE, DIRECT = 1 << 19, 1 << 26


def label_places(labels: list[str]) -> Column:
    """The places in the label list of a row's labels that are in it, in order."""
    place = F.array(*(F.lit(x) for x in labels)).cast("array<string>")
    known = F.transform(F.filter(F.array_distinct("labels"), lambda x: F.array_contains(place, x)), lambda x: (F.array_position(place, x) - 1).cast("int"))
    return F.array_sort(F.coalesce(known, F.array().cast("array<int>")))


def label_rows(rows: DataFrame, labels: list[str]) -> DataFrame:
    """at, x (places and values of features; at is null for all in order) and labels, as rows to fit: y holds places in the label list."""
    return rows.select(F.col("at").cast("array<int>").alias("at"), F.col("x").cast("array<double>").alias("x"), label_places(labels).alias("y")).where("size(x) > 0")


def distinct_rows(ready: DataFrame) -> DataFrame:
    """Equal rows once, with their number as times; dense rows as they are."""
    sparse = ready.where("at IS NOT NULL").groupBy("at", "x", "y").agg(F.count("*").alias("times"))
    return sparse.unionByName(ready.where("at IS NULL").withColumn("times", F.lit(1).cast("bigint")))


def _parts(batch: pa.RecordBatch, width: int, labels: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a batch, some at a time: the row, feature and value of each number, and the labels (0 or 1) of each row."""
    x, at = batch.column("x"), batch.column("at")
    n = x.value_lengths().to_numpy()
    ends = np.concatenate([[0], np.cumsum(n)])
    values = x.flatten().to_numpy()
    place = np.concatenate([np.arange(k) for k in n]) if at.null_count == len(at) else at.flatten().to_numpy()
    own = batch.column("y").to_pylist() if "y" in batch.schema.names else [()] * len(n)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + AT_ONCE // max(labels, 1), side="right")) - 1)
        truth = np.zeros((hi - lo, labels))
        for k, ys in enumerate(own[lo:hi]):
            truth[k, list(ys)] = 1.0
        cut = slice(ends[lo], ends[hi])
        yield np.repeat(np.arange(hi - lo), n[lo:hi]), np.minimum(place[cut], width), values[cut], truth
        lo = hi


def _sums(key: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
    """The rows of terms added up by key."""
    out = np.zeros((n, terms.shape[1]))
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    if len(keys):
        out[keys] = np.add.reduceat(terms[order], first, axis=0)
    return out


def logits(row, place, values, weights: np.ndarray, n_rows: int) -> np.ndarray:
    """weights: a row per feature, the last one the bias."""
    return _sums(row, values[:, None] * weights[place], n_rows) + weights[-1]


def _blocks(ready: DataFrame, features: int, labels: int) -> RDD:
    """Rows to fit as pickled blocks, on every core: features and values in order of rows, where rows begin, rows and values
    in order of features, the features and where they begin, the labels (row, label) and how often each row counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times, lo = batch.column("times").to_numpy(), 0
            for row, place, values, truth in _parts(batch, features, labels):
                order = np.argsort(place, kind="stable")
                keys, first = np.unique(place[order], return_index=True)
                begins = np.flatnonzero(np.diff(row, prepend=-1))
                block = (place, values, begins, row[order], values[order], keys, first, np.nonzero(truth), times[lo : lo + len(truth)].astype(float))
                lo += len(truth)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])

    blocks, cores = ready.mapInArrow(run, "block binary").rdd.map(lambda r: bytes(r[0])), ready.sparkSession.sparkContext.defaultParallelism
    if blocks.getNumPartitions() < cores:  # every step runs over these parts
        blocks = blocks.mapPartitionsWithIndex(lambda k, own: ((k + j, b) for j, b in enumerate(own))).partitionBy(cores, lambda k: k).values()
    return blocks.persist(StorageLevel.MEMORY_AND_DISK)


def _added(parts: RDD, terms: Callable[[Iterator], Iterator[np.ndarray]], shape: tuple[int, ...]) -> np.ndarray:
    """The arrays of all parts, added up."""

    def run(own: Iterator) -> Iterator[np.ndarray]:
        total = np.zeros(shape)
        for term in terms(own):
            total += term
        yield total

    depth = 1 if parts.getNumPartitions() * np.prod(shape) * 8 <= DIRECT else 2
    return parts.mapPartitions(run).treeAggregate(np.zeros(shape), np.add, np.add, depth)


def gradients(blocks: RDD, weights: np.ndarray) -> np.ndarray:
    """The sum over all rows of (probability - label) times features, for all labels: one pass."""
    sent, shape = blocks.context.broadcast(weights), weights.shape

    def run(own: Iterator[bytes]) -> Iterator[np.ndarray]:
        w, total = sent.value, np.zeros(shape)
        for place, values, begins, by_row, by_value, keys, first, truth, times in map(pickle.loads, own):
            wrong = 1 / (1 + np.exp(-(np.add.reduceat(values[:, None] * w[place], begins, axis=0) + w[-1])))
            wrong[truth] -= 1.0
            wrong *= times[:, None]
            total[keys] += np.add.reduceat(by_value[:, None] * wrong[by_row], first, axis=0)
            total[-1] += wrong.sum(0)
        yield total

    out = _added(blocks, run, shape)
    sent.destroy()
    return out


def outer_products(blocks: RDD, features: int) -> np.ndarray:
    """The sum over all rows of x x', with a 1 for the bias as last component."""

    some = max(1, AT_ONCE // (features + 1))

    def run(own: Iterator[bytes]) -> Iterator[np.ndarray]:
        for place, values, begins, *_, times in map(pickle.loads, own):
            row = np.repeat(np.arange(len(times)), np.diff(begins, append=len(place)))
            for lo in range(0, len(times), some):
                cut, weight = slice(*np.searchsorted(row, [lo, lo + some])), times[lo : lo + some, None]
                x = np.zeros((len(weight), features + 1))
                x[row[cut] - lo, place[cut]], x[:, -1] = values[cut], 1.0
                yield x.T @ (x * weight)

    return _added(blocks, run, (features + 1, features + 1))


def fit(rows: DataFrame, labels: list[str], features: int, *, penalty: float = PENALTY, steps: int = 500, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights, a row per feature and the bias last, a column per label. rows: at, x, labels."""
    return fit_ready(distinct_rows(label_rows(rows, labels)), len(labels), features, penalty=penalty, steps=steps, tolerance=tolerance)


def fit_ready(ready: DataFrame, labels: int, features: int, *, penalty: float = PENALTY, steps: int = 500, tolerance: float = TOLERANCE) -> np.ndarray:
    """The same of rows at, x, y (places in the label list) and times."""
    blocks = _blocks(ready, features, labels)
    n, w = float(blocks.map(lambda b: pickle.loads(b)[-1].sum()).sum()), np.zeros((features + 1, labels))
    if n and labels:
        shrink = np.full((features + 1, 1), penalty)
        shrink[-1] = 0.0
        if features <= OUTER:
            inverse = np.linalg.pinv(outer_products(blocks, features) / (4 * n) + np.diag(shrink[:, 0]))
            move = lambda g: inverse @ g
        else:
            most = (blocks.map(pickle.loads).map(lambda b: float(np.add.reduceat(b[1] ** 2, b[2]).max())).max() + 1) / 4 + penalty
            move = lambda g: g / most
        ahead, age, constant = w, np.zeros(labels), None
        for _ in range(steps):
            slope = gradients(blocks, ahead)
            if constant is None:  # at weights of zero the bias's slope tells how many rows have the label
                have = n / 2 - slope[-1]
                constant = (have < 0.5) | (have > n - 0.5)
                share = np.log((have + 0.5) / (n - have + 0.5))
            slope = slope / n + shrink * ahead
            new = np.where(constant, w, ahead - move(slope))
            age = np.where((slope * (new - w)).sum(0) > 0, 0.0, age + 1)  # a label that runs uphill starts anew
            moved = np.abs(new - w).max()
            ahead, w = new + (age / (age + 3)) * (new - w), new
            if moved < tolerance:
                break
        if constant is not None:
            w[-1, constant] = share[constant]
    blocks.unpersist()
    return w


def as_rows(spark, weights: np.ndarray, labels: list[str]) -> DataFrame:
    """label, weights and bias: a row per label."""
    return spark.createDataFrame([(x, weights[:-1, k].tolist(), float(weights[-1, k])) for k, x in enumerate(labels)], "label string, weights array<double>, bias double")


def probabilities(rows: DataFrame, heads: list, key: str) -> DataFrame:
    """key, code and prob for every label of every row (at, x) of a sparse or dense kind. heads: rows label, weights, bias."""
    weights = np.array([[*h.weights, h.bias] for h in heads]).T if heads else np.zeros((1, 0))
    sent, names = rows.sparkSession.sparkContext.broadcast(weights), [h.label for h in heads]
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for row, place, values, truth in _parts(batch, len(weights) - 1, len(names)):
                p, own = 1 / (1 + np.exp(-logits(row, place, values, sent.value, len(truth)))), batch.column(key).slice(lo, len(truth))
                lo += len(truth)
                yield pa.RecordBatch.from_arrays([own.take(pa.array(np.repeat(np.arange(len(truth)), len(names)))), pa.array(names * len(truth), pa.string()), pa.array(p.ravel())], names=[key, "code", "prob"])

    out = rows.select(key, F.col("at").cast("array<int>").alias("at"), F.coalesce(F.col("x").cast("array<double>"), F.array().cast("array<double>")).alias("x"))
    return out.mapInArrow(run, f"{key} {kind}, code string, prob double")

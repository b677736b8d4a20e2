"""Naive Bayes support vectors: a linear hinge-loss model over n-gram indicators scaled by class log-count ratios.

Features are hashed to a fixed range, so the model has a fixed size. It is fitted by dual coordinate descent
in one task on a bounded sample of labelled rows; margins of rows held back from the fit give the sigmoid that
turns margins into probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (bytes, offsets) of a run of texts to one array of distinct feature numbers for each.
Featurizer = Callable[[np.ndarray, np.ndarray], Iterator[np.ndarray]]


@dataclass(frozen=True)
class LinearModel:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, features: np.ndarray) -> float:
        """Probability of label 1; a text without features gets that of the bias alone."""
        margin = float(self.weights[features].sum()) + self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500))))


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray, size: int, smoothing: float) -> np.ndarray:
    counts = np.full((2, size), smoothing)
    for x, y in zip(rows, labels, strict=True):
        counts[int(y != 1)][x] += 1.0
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: np.ndarray, epochs: int, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights of indicators (the ratios multiplied in) and bias of the L2-regularised hinge loss.

    What is kept is the product of weight and ratio, so no scaled copy of the rows is needed.
    """
    y, w, bias, squared = np.where(labels == 1, 1.0, -1.0), np.zeros(len(ratio)), 0.0, ratio * ratio
    square = np.array([squared[x].sum() + 1.0 for x in rows])
    alpha, order = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]].sum() + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if step := (new - alpha[i]) * y[i]:
                alpha[i], bias = new, bias + step
                w[rows[i]] += step * squared[rows[i]]
                largest = max(largest, abs(step) * square[i])
        if largest < 1e-3:
            break
    return w, bias


def sigmoid_fit(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1 given the margin (Newton steps on smoothed targets)."""
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (n1 + 1.0) / (n1 + 2.0), 1.0 / (n0 + 2.0))
    a, b = 1.0, float(np.log((n1 + 1.0) / (n0 + 1.0)))
    scale = max(float(np.std(margins)), 1e-9)
    x = margins / scale
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * x + b, -500, 500)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-12)
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, [(g * x).sum() + 1e-3 * (a - 1), g.sum()])
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return max(a, 1e-3) / scale, b


def fit(rows: list[np.ndarray], labels: np.ndarray, size: int, cost: float = 1.0, smoothing: float = 1.0, epochs: int = 12) -> LinearModel:
    """A model of label 1 against label 0. With one class only (or no rows) it scores every text with the smoothed share of label 1."""
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    if not n1 or not n0:
        return LinearModel(np.zeros(size, np.float32), 0.0, 1.0, float(np.log((n1 + 1.0) / (n0 + 1.0))))

    def model_of(chosen: np.ndarray) -> tuple[np.ndarray, float]:
        own, y = [rows[i] for i in chosen], labels[chosen]
        return dual_coordinate_descent(own, y, log_count_ratio(own, y, size, smoothing), np.full(len(y), cost), epochs)

    fold = np.arange(len(rows)) % 4
    if min(n1, n0) < 8:
        w, bias = model_of(np.arange(len(rows)))
        margins, held = np.array([w[x].sum() + bias for x in rows]), labels
    else:  # margins of rows that the fit hasn't seen, for each label alike
        for label in (0, 1):
            fold[np.flatnonzero(labels == label)] = np.arange((labels == label).sum()) % 4
        margins, held = [], []
        for part in (0, 2):
            w, bias = model_of(np.flatnonzero(fold != part))
            out = np.flatnonzero(fold == part)
            margins += [w[rows[i]].sum() + bias for i in out]
            held += labels[out].tolist()
        margins, held = np.array(margins), np.array(held)
        w, bias = model_of(np.arange(len(rows)))
    slope, offset = sigmoid_fit(margins, held)
    return LinearModel(w.astype(np.float32), bias, slope, offset)


def fit_on_sample(docs: DataFrame, labels: DataFrame, train: Column, featurize: Callable[[pa.Array], Iterator[np.ndarray]], size: int, most_rows: int = 10_000, most_features: int = 30_000_000, classes: int = 0) -> LinearModel | list[LinearModel]:
    """Fit on labelled rows where ``train`` holds: at most ``most_rows`` ids (by hash) and ``most_features`` features in all.

    With ``classes``, labels are 0 to classes - 1, and there is a model of each against the others.
    ``docs(doc_id, text)``, ``labels(doc_id, label)``; null ids and labels are not learned from, and of an id with
    several labels the largest counts. The sample's ids are broadcast; they are as few as that bound.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("label").between(0, max(1, classes - 1)) & train).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def features(batches):
        for batch in batches:
            out = [x.astype(np.int32).tobytes() for x in featurize(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(out, pa.binary())], ["doc_id", "label", "features"])

    def train_one(batches):
        rows, labels, left = [], [], most_features
        for batch in batches:
            for y, x in zip(batch.column("label").to_pylist(), batch.column("features"), strict=True):
                own = np.frombuffer(x.as_buffer(), np.int32).copy()
                if (left := left - len(own)) < 0:
                    break
                rows.append(own)
                labels.append(y)
        y = np.array(labels, int)
        for n in range(max(1, classes)):
            m = fit(rows, (y == n).astype(int) if classes else y, size)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([m.weights.astype(np.float32).tobytes()], pa.binary()), *(pa.array([v], pa.float64()) for v in (m.bias, m.slope, m.offset))], ["n", "weights", "bias", "slope", "offset"])

    made = rows.mapInArrow(features, "doc_id long, label int, features binary")
    made = made.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "features")
    found = made.mapInArrow(train_one, "n int, weights binary, bias double, slope double, offset double").collect()
    models = [LinearModel(np.frombuffer(r.weights, np.float32), r.bias, r.slope, r.offset) for r in sorted(found)]
    if not models:
        models = [fit([], np.zeros(0, int), size)] * max(1, classes)
    return models if classes else models[0]


def score_texts(docs: DataFrame, model: LinearModel, featurize: Callable[[pa.Array], Iterator[np.ndarray]]) -> DataFrame:
    """``docs`` with a column ``score``, which takes the place of one of that name; ``docs`` has a string column ``text`` (null: empty). Every row is scored on its own, also where rows repeat."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.columns

    def run(batches):
        for batch in batches:
            scores = [shared.value.score(x) for x in featurize(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores, pa.float64())], [*kept, "score"])

    return docs.mapInArrow(run, docs.withColumn("score", F.lit(0.0)).schema)

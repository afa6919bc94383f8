"""Weighted logistic fits of many models at once, each on its own training rows.

A Newton step needs of every model only the sum of gradients and curvatures over its rows.
One pass over the examples forms them for all models (a task holds one block per model),
blocks are summed in groups of tasks, and the driver solves systems of the size of a model.
The number of passes is that of the slowest model, not the sum over models.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups of tasks whose sums are formed before they meet, and rows multiplied at once.
GROUPS, SLICE = 32, 4096


@dataclass(frozen=True)
class Model:
    """One model: it trains on rows whose fold of ``set_number`` is not ``fold``."""

    name: int
    set_number: int
    fold: int
    penalty: float = 0.0
    max_iter: int = 20


@dataclass(frozen=True)
class Fit:
    weights: np.ndarray
    bias: float
    iterations: int
    converged: bool


def _features(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("features")
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)
    return np.concatenate([rows, np.ones((len(rows), 1))], axis=1)


def _folds(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("folds")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def probability(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0, e) / (1.0 + e)


def _summed(examples: DataFrame, models: Sequence[Model], size: int, block) -> np.ndarray:
    """(models, size) sums of ``block(x, y, train)`` over the training rows of every model."""
    sets = [m.set_number - 1 for m in models]
    own = [m.fold for m in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(models), size))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                x, folds = _features(part), _folds(part)
                y = part.column("y").to_numpy(zero_copy_only=False).astype(float)
                for k in range(len(models)):
                    train = folds[:, sets[k]] != own[k]
                    total[k] += block(k, x[train], y[train])
        yield pa.record_batch([pa.array([total.tobytes()])], ["sums"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py()) for b in group.column("sums"))
        return pa.table([pa.array([total.tobytes()])], ["sums"])

    parts = examples.select("features", "y", "folds").mapInArrow(run, "sums binary")
    parts = parts.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    rows = parts.groupBy("g").applyInArrow(add, "sums binary").collect()  # at most GROUPS blocks
    return sum((np.frombuffer(r["sums"]) for r in rows), np.zeros(len(models) * size)).reshape(len(models), size)


def fit_all(examples: DataFrame, models: Sequence[Model], *, tolerance: float = 1e-10) -> tuple[list[Fit], np.ndarray]:
    """The fits in the order of ``models``, and each model's weight of a positive row.

    ``examples`` is ``(features, y, folds)``, written once and read in every pass; ``folds``
    has a row's fold per set. Positives weigh negatives / max(1, positives) of the training
    rows. The penalty is on squared weights of standardised features, per unit of weight.
    """
    first = examples.select(F.size("features").alias("n")).first()
    if first is None or not models:
        raise ValueError("nothing to fit")
    d = first["n"]

    # positives, all, and sums of x and x squared by class, for weights and spreads
    def moments(k: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        plain = x[:, :-1]
        return np.concatenate([[y.sum(), len(y)], *((plain[y == c]).sum(axis=0) for c in (0, 1)), *((plain[y == c] ** 2).sum(axis=0) for c in (0, 1))])

    sums = _summed(examples, models, 2 + 4 * d, moments)
    positives, rows = sums[:, 0], sums[:, 1]
    if (rows == 0).any():
        raise ValueError("a model has no training rows")
    heavy = (rows - positives) / np.maximum(1.0, positives)
    whole = rows - positives + heavy * positives
    whole = np.where(whole > 0, whole, 1.0)
    x0, x1, q0, q1 = (sums[:, 2 + i * d : 2 + (i + 1) * d] for i in range(4))
    mean = (x0 + heavy[:, None] * x1) / whole[:, None]
    spread = np.maximum((q0 + heavy[:, None] * q1) / whole[:, None] - mean**2, 0.0)
    ridge = np.array([m.penalty for m in models])[:, None] * np.concatenate([spread, np.zeros((len(models), 1))], axis=1)

    beta = np.zeros((len(models), d + 1))
    iterations, done = np.zeros(len(models), int), np.zeros(len(models), bool)
    while not done.all():
        live = np.flatnonzero(~done).tolist()
        now, weight = beta[live], heavy[live]

        def newton(k: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            p = probability(x @ now[k])
            w = np.where(y == 1, weight[k], 1.0)
            return np.concatenate([x.T @ (w * (p - y)), ((x * (w * p * (1 - p))[:, None]).T @ x).reshape(-1)])

        for at, found in zip(live, _summed(examples, [models[i] for i in live], (d + 1) * (d + 2), newton)):
            slope = found[: d + 1] / whole[at] + ridge[at] * beta[at]
            curve = found[d + 1 :].reshape(d + 1, d + 1) / whole[at] + np.diag(ridge[at])
            step = np.linalg.lstsq(curve, slope, rcond=1e-12)[0]
            longest = np.abs(step).max()
            beta[at] -= step * min(1.0, 5.0 / max(longest, 1e-300))
            iterations[at] += 1
            done[at] = longest < tolerance or iterations[at] >= models[at].max_iter
            if longest < tolerance:
                iterations[at] = -iterations[at]
    return [Fit(b[:-1], float(b[-1]), abs(int(n)), bool(n < 0)) for b, n in zip(beta, iterations)], heavy


def score_held_out(examples: DataFrame, models: Sequence[Model], fits: Sequence[Fit]) -> DataFrame:
    """``(model, id, y, logit, p)`` of every row in the fold that a model holds out, in one pass."""
    kind = examples.schema["id"].dataType.simpleString()
    plan = [(m.name, m.set_number - 1, m.fold, np.append(f.weights, f.bias)) for m, f in zip(models, fits)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, folds = _features(batch), _folds(batch)
            for name, column, fold, beta in plan:
                rows = np.flatnonzero(folds[:, column] == fold)
                if len(rows):
                    z = x[rows] @ beta
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), name, np.int32)), batch.column("id").take(take), batch.column("y").take(take), pa.array(z), pa.array(probability(z))],
                        ["model", "id", "y", "logit", "p"])

    return examples.select("id", "features", "y", "folds").mapInArrow(run, f"model int, id {kind}, y int, logit double, p double")

"""Linear models by distributed gradients: mini-batch descent and L-BFGS.

Data frames have ``label`` double and ``features`` array<double>.  A round
sends the weights as a broadcast, sums gradients per partition in numpy and then
per weight on the cluster; only the summed gradient, one number per weight,
comes back.  Data is read again each round, so the caller may persist it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_WEIGHTS = 5_000_000

# A gradient maps (features block, labels, weights) to (summed gradient, summed loss).
Gradient = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, float]]
# An updater maps (weights, gradient, step, round, regularisation) to (new weights, penalty).
Updater = Callable[[np.ndarray, np.ndarray, float, int, float], tuple[np.ndarray, float]]


def logistic(x, y, w):
    margin = x @ w
    p = 1 / (1 + np.exp(-margin))
    loss = np.logaddexp(0, -margin) + (1 - y) * margin
    return x.T @ (p - y), float(loss.sum())


def least_squares(x, y, w):
    error = x @ w - y
    return 2 * (x.T @ error), float((error**2).sum())


def hinge(x, y, w):
    sign = 2 * y - 1
    gap = 1 - sign * (x @ w)
    inside = gap > 0
    return -(x[inside].T @ sign[inside]), float(gap[inside].sum())


def plain(w, g, step, i, reg):
    return w - step / np.sqrt(i) * g, 0.0


def squared_l2(w, g, step, i, reg):
    rate = step / np.sqrt(i)
    new = w * (1 - rate * reg) - rate * g
    return new, 0.5 * reg * float(new @ new)


def soft_threshold_l1(w, g, step, i, reg):
    rate = step / np.sqrt(i)
    moved = w - rate * g
    new = np.sign(moved) * np.maximum(np.abs(moved) - reg * rate, 0)
    return new, reg * float(np.abs(new).sum())


def summed_gradient(data: DataFrame, gradient: Gradient, weights: np.ndarray) -> tuple[np.ndarray, float, int]:
    """(gradient sum, loss sum, rows) over the frame."""
    if len(weights) > MAX_WEIGHTS:
        raise ValueError(f"more than {MAX_WEIGHTS} weights")
    shared = data.sparkSession.sparkContext.broadcast(weights)

    def partial(batches: Iterable[pd.DataFrame]):
        w = shared.value
        total, loss, count = np.zeros_like(w), 0.0, 0
        for rows in batches:
            if len(rows):
                g, e = gradient(np.stack(rows.features.to_numpy()), rows.label.to_numpy(), w)
                total, loss, count = total + g, loss + e, count + len(rows)
        yield pd.DataFrame({"i": np.arange(-2, len(w)), "v": np.concatenate([[loss, count], total])})

    parts = data.select("label", "features").mapInPandas(partial, "i int, v double")
    sums = parts.groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i").v.to_numpy()
    shared.unpersist()
    if not len(sums):
        return np.zeros_like(weights), 0.0, 0
    return sums[2:], float(sums[0]), int(sums[1])


def minibatch_sgd(
    data: DataFrame, gradient: Gradient, updater: Updater, weights: np.ndarray, step: float = 1.0, rounds: int = 10,
    fraction: float = 1.0, reg: float = 0.0, seed: int = 0,
) -> tuple[np.ndarray, list[float]]:
    """Mini-batch descent: returns weights and the loss of every round."""
    weights = np.asarray(weights, dtype="float64")
    _, penalty = updater(weights, np.zeros_like(weights), 0.0, 1, reg)
    losses = []
    for i in range(1, rounds + 1):
        batch = data if fraction >= 1 else data.sample(False, fraction, seed + i)
        g, loss, n = summed_gradient(batch, gradient, weights)
        if n:
            losses.append(loss / n + penalty)
            weights, penalty = updater(weights, g / n, step, i, reg)
    return weights, losses


def lbfgs(
    data: DataFrame, gradient: Gradient, weights: np.ndarray, rounds: int = 20, history: int = 10, reg: float = 0.0,
    tolerance: float = 1e-6,
) -> tuple[np.ndarray, list[float]]:
    """Limited-memory quasi-Newton with squared-L2 penalty; cost and gradient are one job each."""

    def cost(w):
        g, loss, n = summed_gradient(data, gradient, w)
        return loss / n + 0.5 * reg * float(w @ w), g / n + reg * w

    w = np.asarray(weights, dtype="float64")
    f, g = cost(w)
    steps, changes, losses = [], [], [f]
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y in zip(reversed(steps), reversed(changes)):
            a = (s @ q) / (y @ s)
            alphas.append(a)
            q -= a * y
        if steps:
            q *= (steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
        for s, y, a in zip(steps, changes, reversed(alphas)):
            q += s * (a - (y @ q) / (y @ s))
        rate = 1.0 if steps else min(1.0, 1 / max(np.abs(g).sum(), 1e-12))
        while True:
            new_f, new_g = cost(w - rate * q)
            if new_f <= f - 1e-4 * rate * (g @ q) or rate < 1e-10:
                break
            rate /= 2
        s, y = -rate * q, new_g - g
        w, f, g = w - rate * q, new_f, new_g
        losses.append(f)
        if s @ y > 1e-12:
            steps, changes = (steps + [s])[-history:], (changes + [y])[-history:]
        if abs(losses[-2] - f) <= tolerance * max(abs(losses[-2]), abs(f), 1.0):
            break
    return w, losses


def labels_are_binary(data: DataFrame) -> bool:
    """True if every label is 0 or 1; stops at the first other one."""
    return data.filter(~F.col("label").isin(0, 1)).isEmpty()


def train_linear(data, rounds=20, step=0.1, fraction=1.0, width=None, seed=0):
    return minibatch_sgd(data, least_squares, plain, _zeros(data, width), step, rounds, fraction, 0.0, seed)


def train_lasso(data, rounds=20, step=0.1, reg=0.01, fraction=1.0, width=None, seed=0):
    return minibatch_sgd(data, least_squares, soft_threshold_l1, _zeros(data, width), step, rounds, fraction, reg, seed)


def train_ridge(data, rounds=20, step=0.1, reg=0.01, fraction=1.0, width=None, seed=0):
    return minibatch_sgd(data, least_squares, squared_l2, _zeros(data, width), step, rounds, fraction, reg, seed)


def train_logistic(data, rounds=20, step=1.0, reg=0.0, fraction=1.0, width=None, seed=0):
    if not labels_are_binary(data):
        raise ValueError("labels must be 0 or 1")
    return minibatch_sgd(data, logistic, squared_l2, _zeros(data, width), step, rounds, fraction, reg, seed)


def train_svm(data, rounds=20, step=1.0, reg=0.01, fraction=1.0, width=None, seed=0):
    if not labels_are_binary(data):
        raise ValueError("labels must be 0 or 1")
    return minibatch_sgd(data, hinge, squared_l2, _zeros(data, width), step, rounds, fraction, reg, seed)


def _zeros(data, width):
    return np.zeros(width or data.select(F.size("features")).first()[0])

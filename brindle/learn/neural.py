"""Multi-layer perceptron: sigmoid hidden layers, softmax output, trained on stacked mini-batches.

Weights travel as one flat vector: per layer the matrix (out x in, row by row)
and then the bias.  Targets are one-hot.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.learn.linear import MAX_WEIGHTS
from brindle.session import cut_lineage


def layer_shapes(topology: Sequence[int]) -> list[tuple[int, int]]:
    return list(zip(topology[1:], topology[:-1]))


def split_weights(flat: np.ndarray, topology: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for rows, cols in layer_shapes(topology):
        matrix = flat[at : at + rows * cols].reshape(rows, cols)
        at += rows * cols
        out.append((matrix, flat[at : at + rows]))
        at += rows
    return out


def join_weights(layers) -> np.ndarray:
    return np.concatenate([part.ravel() for layer in layers for part in layer])


def initial_weights(topology: Sequence[int], seed: int = 0) -> np.ndarray:
    """Uniform within +-sqrt(6 / (in + out)), zero bias."""
    rng = np.random.default_rng(seed)
    layers = []
    for rows, cols in layer_shapes(topology):
        span = np.sqrt(6 / (rows + cols))
        layers.append((rng.uniform(-span, span, (rows, cols)), np.zeros(rows)))
    return join_weights(layers)


def forward(x: np.ndarray, layers) -> list[np.ndarray]:
    """Activations of every layer, the input first; rows are examples."""
    acts = [x]
    for depth, (matrix, bias) in enumerate(layers):
        z = acts[-1] @ matrix.T + bias
        if depth == len(layers) - 1:
            z = np.exp(z - z.max(axis=1, keepdims=True))
            acts.append(z / z.sum(axis=1, keepdims=True))
        else:
            acts.append(1 / (1 + np.exp(-z)))
    return acts


def block_gradient(x: np.ndarray, y: np.ndarray, flat: np.ndarray, topology: Sequence[int]) -> tuple[np.ndarray, float]:
    """Summed gradient and cross entropy of one stacked block."""
    layers = split_weights(flat, topology)
    acts = forward(x, layers)
    delta, grads = acts[-1] - y, []
    for depth in range(len(layers) - 1, -1, -1):
        grads.append((delta.T @ acts[depth], delta.sum(axis=0)))
        if depth:
            delta = (delta @ layers[depth][0]) * acts[depth] * (1 - acts[depth])
    loss = -np.log(np.maximum((acts[-1] * y).sum(axis=1), 1e-300)).sum()
    return join_weights(reversed(grads)), float(loss)


def stack_rows(data: DataFrame, size: int) -> DataFrame:
    """Rows (features, targets, n): up to ``size`` examples laid end to end, within partitions."""

    def run(batches):
        rest = None
        for rows in batches:
            rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
            full = len(rows) // size * size
            for at in range(0, full, size):
                yield _stacked(rows.iloc[at : at + size])
            rest = rows.iloc[full:]
        if rest is not None and len(rest):
            yield _stacked(rest)

    return data.select("features", "target").mapInPandas(run, "features array<double>, targets array<double>, n int")


def _stacked(rows: pd.DataFrame) -> pd.DataFrame:
    x, y = np.concatenate(rows.features.to_list()), np.concatenate(rows.target.to_list())
    return pd.DataFrame({"features": [x], "targets": [y], "n": [len(rows)]})


class AdaDelta:
    """Step sizes from running averages of squared gradients and squared steps."""

    def __init__(self, size: int, rho: float = 0.99, epsilon: float = 1e-8):
        self.rho, self.epsilon = rho, epsilon
        self.gradients, self.steps = np.zeros(size), np.zeros(size)

    def __call__(self, gradient: np.ndarray) -> np.ndarray:
        self.gradients = self.rho * self.gradients + (1 - self.rho) * gradient**2
        step = gradient * np.sqrt(self.epsilon + self.steps) / np.sqrt(self.epsilon + self.gradients)
        self.steps = self.rho * self.steps + (1 - self.rho) * step**2
        return step


def _weight_mask(topology) -> np.ndarray:
    """1 for matrix cells, 0 for biases: the penalty leaves biases alone."""
    return join_weights([(np.ones((r, c)), np.zeros(r)) for r, c in layer_shapes(topology)])


def train(
    data: DataFrame, topology: Sequence[int], rounds: int = 10, batch: int = 32, fraction: float = 1.0, step: float = 1.0,
    reg: float = 0.0, adaptive: bool = True, seed: int = 0,
) -> tuple[np.ndarray, list[float]]:
    """Train on (features, target) rows; returns flat weights and the loss (with penalty) per round.

    A round averages the mean gradients of its stacked blocks.
    """
    flat, mask = initial_weights(topology, seed), _weight_mask(topology)
    if len(flat) > MAX_WEIGHTS:
        raise ValueError(f"more than {MAX_WEIGHTS} weights")
    blocks = cut_lineage(stack_rows(data, batch))
    rule, losses = AdaDelta(len(flat)), []
    spark = data.sparkSession
    for i in range(1, rounds + 1):
        shared = spark.sparkContext.broadcast(flat)

        def partial(batches):
            w = shared.value
            total, loss, count = np.zeros_like(w), 0.0, 0
            for rows in batches:
                for x, y, n in zip(rows.features, rows.targets, rows.n):
                    g, e = block_gradient(x.reshape(n, -1), y.reshape(n, -1), w, topology)
                    total, loss, count = total + g / n, loss + e / n, count + 1
            yield pd.DataFrame({"i": np.arange(-2, len(w)), "v": np.concatenate([[loss, count], total])})

        chosen = blocks if fraction >= 1 else blocks.sample(False, fraction, seed + i)
        sums = chosen.mapInPandas(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
        sums = sums.toPandas().sort_values("i").v.to_numpy()
        loss, count, gradient = sums[0], max(sums[1], 1.0), sums[2:]
        gradient = gradient / count + reg * mask * flat
        losses.append(loss / count + 0.5 * reg * float((mask * flat) @ flat))
        flat = flat - step * (rule(gradient) if adaptive else gradient)
        shared.unpersist()
    return flat, losses


def predict(data: DataFrame, flat: np.ndarray, topology: Sequence[int], out: str = "prediction") -> DataFrame:
    """Index of the largest output."""
    shared = data.sparkSession.sparkContext.broadcast(flat)

    @F.pandas_udf("int")
    def best(v: pd.Series) -> pd.Series:
        return pd.Series(forward(np.stack(v.to_numpy()), split_weights(shared.value, topology))[-1].argmax(axis=1))

    return data.withColumn(out, best("features"))


def error_rate(data: DataFrame, flat: np.ndarray, topology: Sequence[int]) -> DataFrame:
    """One row: share of examples whose predicted class differs from the one-hot target."""
    wanted = F.array_position("target", F.array_max("target")) - 1
    return predict(data, flat, topology).agg(F.avg((F.col("prediction") != wanted).cast("double")).alias("error"))


# --- training through a parameter table ------------------------------------------------------


def parameter_table(spark, topology: Sequence[int], seed: int = 0, span: float = 0.1) -> DataFrame:
    """Rows (layer, row, col, value), column 0 the bias; weights random within +-span."""
    frames = None
    for layer, (rows, cols) in enumerate(layer_shapes(topology)):
        cell = spark.range(rows * (cols + 1))
        part = cell.select(
            F.lit(layer).alias("layer"), F.floor(F.col("id") / (cols + 1)).cast("int").alias("row"), (F.col("id") % (cols + 1)).cast("int").alias("col"),
            F.when(F.col("id") % (cols + 1) == 0, 0.0).otherwise((F.rand(seed + layer) * 2 - 1) * span).alias("value"),
        )
        frames = part if frames is None else frames.unionAll(part)
    return frames


def merge_gradients(params: DataFrame, gradients: DataFrame, rate: float) -> DataFrame:
    """value + rate * mean of the pending gradients of the cell; cells without any stay.

    The table holds negated gradients, so the sum descends.
    """
    means = gradients.groupBy("layer", "row", "col").agg(F.avg("gradient").alias("g"))
    moved = params.join(means, ["layer", "row", "col"], "left")
    return moved.select("layer", "row", "col", (F.col("value") + rate * F.coalesce("g", F.lit(0.0))).alias("value"))


def _flat_from_table(params: DataFrame, topology) -> np.ndarray:
    rows = params.toPandas()
    layers = []
    for layer, (r, c) in enumerate(layer_shapes(topology)):
        cells = np.zeros((r, c + 1))
        part = rows[rows.layer == layer]
        cells[part.row, part.col] = part.value
        layers.append((cells[:, 1:], cells[:, 0]))
    return join_weights(layers)


def shard_gradients(data: DataFrame, params: DataFrame, topology: Sequence[int], batch: int = 32) -> DataFrame:
    """Gradient table (layer, row, col, gradient): each stacked block appends the negated mean gradient of every cell."""
    if sum(r * (c + 1) for r, c in layer_shapes(topology)) > MAX_WEIGHTS:
        raise ValueError(f"more than {MAX_WEIGHTS} weights")
    shared = data.sparkSession.sparkContext.broadcast(_flat_from_table(params, topology))

    def run(batches):
        for rows in batches:
            for x, y, n in zip(rows.features, rows.targets, rows.n):
                g, _ = block_gradient(x.reshape(n, -1), y.reshape(n, -1), shared.value, topology)
                for layer, (matrix, bias) in enumerate(split_weights(-g / n, topology)):
                    cells = np.column_stack([bias, matrix])
                    r, c = np.indices(cells.shape)
                    yield pd.DataFrame({"layer": layer, "row": r.ravel(), "col": c.ravel(), "gradient": cells.ravel()})

    return stack_rows(data, batch).mapInPandas(run, "layer int, row int, col int, gradient double")


def train_through_table(data: DataFrame, topology: Sequence[int], rounds: int = 3, rate: float = 1.0, batch: int = 32, seed: int = 0) -> DataFrame:
    """Rounds of: shards append gradients, one job averages them and rewrites the table."""
    params = cut_lineage(parameter_table(data.sparkSession, topology, seed))
    for _ in range(rounds):
        params = cut_lineage(merge_gradients(params, shard_gradients(data, params, topology, batch), rate))
    return params

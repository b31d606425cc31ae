"""Small networks: fitted on a bounded sample of rows (``learned.MOST_ROWS``), applied to all rows in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.learned import sample


@dataclass(frozen=True)
class Layers:
    """(matrix, bias) for each layer; rectified between layers. last: sigmoid, softmax or none."""

    layers: tuple[tuple[np.ndarray, np.ndarray], ...]
    last: str = "sigmoid"

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(self.layers):
            x = x @ w + b
            if i + 1 < len(self.layers):
                x = np.maximum(x, 0.0)
        if self.last == "sigmoid":
            return 1 / (1 + np.exp(-x))
        if self.last == "softmax":
            e = np.exp(x - x.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)
        return x


def fit_layers(x: np.ndarray, slope: Callable[[np.ndarray], np.ndarray], sizes: tuple[int, ...], last: str = "sigmoid", steps: int = 400, rate: float = 0.02, seed: int = 0) -> Layers:
    """Layers fitted by Adam on all rows of ``x`` at once, which is a bounded sample. slope: the loss's slope at the outputs. Inputs are brought to mean 0 and deviation 1, and that is folded into the first layer."""
    g = np.random.default_rng(seed)
    mean, std = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    values = [v for a, b in zip(sizes, sizes[1:]) for v in (g.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b))]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    z = (x - mean) / std
    for t in range(1, steps + 1):
        held = [z]
        for i in range(0, len(values) - 2, 2):
            held.append(np.maximum(held[-1] @ values[i] + values[i + 1], 0.0))
        out = Layers(((values[-2], values[-1]),), last)(held[-1])
        d = slope(out)
        d = d * out * (1 - out) if last == "sigmoid" else out * (d - (d * out).sum(axis=1, keepdims=True)) if last == "softmax" else d
        slopes: list[np.ndarray] = []
        for i in range(len(values) - 2, -1, -2):
            h = held[i // 2]
            slopes = [h.T @ d, d.sum(axis=0), *slopes]
            d = (d @ values[i].T) * (h > 0)
        for i, (v, s) in enumerate(zip(values, slopes)):
            first[i] = 0.9 * first[i] + 0.1 * s
            second[i] = 0.999 * second[i] + 0.001 * s * s
            values[i] = v - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    values[1] = values[1] - (mean / std) @ values[0]
    values[0] = values[0] / std[:, None]
    return Layers(tuple(zip(values[::2], values[1::2])), last)


def _sample(rows: DataFrame, key: str, columns: list[str]) -> np.ndarray:
    held = sample(rows.select(key, *columns), key).select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns)).toPandas()  # about MOST_ROWS rows at most
    return np.nan_to_num(held.to_numpy(dtype=float))


def fit_penalty(rows: DataFrame, features: list[str], label: str, key: str = "id", hidden: tuple[int, ...] = (32, 32), steps: int = 400) -> Layers:
    """The network of ``group_penalty``: what is left of a rank is drawn to 0.1 for a labelled vertex and to 1 for others, by squared error."""
    data = _sample(rows, key, [*features, label])
    x, y = data[:, :-1], data[:, -1:]
    return fit_layers(x, lambda out: 1.8 * (0.1 + 0.9 * out - (1 - 0.9 * y)) / len(y), (x.shape[1], *hidden, 1), "sigmoid", steps)


def fit_weights(rows: DataFrame, features: list[str], scores: list[str], label: str, key: str = "id", hidden: tuple[int, ...] = (32,), steps: int = 400) -> Layers:
    """The network that weighs several scores of a vertex: the weighted sum is drawn to the label, by squared error."""
    data = _sample(rows, key, [*features, *scores, label])
    n = len(features)
    x, s, y = data[:, :n], data[:, n:-1], data[:, -1:]
    return fit_layers(x, lambda out: 2 * ((out * s).sum(axis=1, keepdims=True) - y) * s / len(y), (n, *hidden, len(scores)), "softmax", steps)


def apply_layers(net: Layers, *inputs: Column) -> Column:
    """The outputs as an array of doubles; NULL and NaN inputs count 0."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(*columns: pd.Series) -> pd.Series:
        x = np.nan_to_num(np.stack([c.to_numpy(dtype=float, na_value=0.0) for c in columns], axis=1))
        return pd.Series(list(net(x)))

    return run(*(F.coalesce(c.cast("double"), F.lit(0.0)) for c in inputs))


def group_penalty(net: Layers, *inputs: Column) -> Column:
    """What is left of a rank in a closed group, learned: from 0.1 to 1."""
    return 0.1 + 0.9 * apply_layers(net, *inputs)[0]


def attention(net: Layers, gate: np.ndarray, *inputs: Column) -> Column:
    """Three weights: a softmax over the inputs, the middle one raised by up to 3 times where the gate finds structure, brought to 1."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(*columns: pd.Series) -> pd.Series:
        x = np.nan_to_num(np.stack([c.to_numpy(dtype=float, na_value=0.0) for c in columns], axis=1))
        w = net(x)
        w[:, 1] *= 1 + 2 * (1 / (1 + np.exp(-(x @ gate)))).mean(axis=1)
        return pd.Series(list(w / w.sum(axis=1, keepdims=True)))

    return run(*(F.coalesce(c.cast("double"), F.lit(0.0)) for c in inputs))

"""Two-dimensional views of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points that the neighbour embedding takes at most; its work grows with their square.
MOST = 5000


def principal(rows: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """(key, point): the k principal components; any number of rows."""
    held = rows.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(held).transform(held).select(key, vector_to_array("_p").alias("point"))


def tsne(x: np.ndarray, rounds: int = 200, rate: float = 500.0, perplexity: float = 30.0, seed: int = 123) -> np.ndarray:
    """t-distributed stochastic neighbour embedding into the plane, exact."""
    n = len(x)
    if n < 3:
        return np.zeros((n, 2))
    square = (x * x).sum(1)
    distance = np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0)
    np.fill_diagonal(distance, np.inf)
    goal, p = np.log(min(perplexity, (n - 1) / 3)), np.zeros((n, n))
    for i in range(n):
        low, high, beta = 0.0, np.inf, 1.0 / max(np.median(distance[i][np.isfinite(distance[i])]), 1e-12)
        for _ in range(50):
            w = np.exp(-(distance[i] - distance[i].min()) * beta)
            q = w / w.sum()
            entropy = -(q[q > 0] * np.log(q[q > 0])).sum()
            if abs(entropy - goal) < 1e-5:
                break
            low, high = (beta, high) if entropy > goal else (low, beta)
            beta = beta * 2 if np.isinf(high) else (low + high) / 2
        p[i] = q
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    rng = np.random.default_rng(seed)
    y, move, gain = rng.normal(0, 1e-4, (n, 2)), np.zeros((n, 2)), np.ones((n, 2))
    for t in range(rounds):
        s = (y * y).sum(1)
        near = 1 / (1 + s[:, None] + s[None, :] - 2 * y @ y.T)
        np.fill_diagonal(near, 0)
        force = (p * (4 if t < 50 else 1) - np.maximum(near / near.sum(), 1e-12)) * near
        slope = 4 * (np.diag(force.sum(1)) - force) @ y
        gain = np.maximum(np.where(np.sign(slope) != np.sign(move), gain + 0.2, gain * 0.8), 0.01)
        move = (0.5 if t < 20 else 0.8) * move - min(rate, n * 2.0) * gain * slope
        y = y + move
        y -= y.mean(0)
    return y


def neighbour_map(rows: DataFrame, key: str, vector: str, label: str, **settings) -> DataFrame:
    """(key, label, x, y) of at most ``MOST`` rows; more are an error, as no part of them would be the whole picture."""
    held = rows.select(key, label, vector).orderBy(key).limit(MOST + 1).toPandas()
    if len(held) > MOST:
        raise ValueError(f"at most {MOST} points; use principal components")
    y = tsne(np.stack(held[vector].to_list()).astype(float), **settings) if len(held) else np.zeros((0, 2))
    return rows.sparkSession.createDataFrame(pd.DataFrame({key: held[key], label: held[label], "x": y[:, 0], "y": y[:, 1]}), f"{key} string, {label} string, x double, y double")


def whole_map(rows: DataFrame, key: str, vector: str, label: str, *order, most: int = MOST, near: int = 10, **settings) -> DataFrame:
    """(key, label, x, y) of all rows: the first ``most`` of the order are embedded, each further one is placed at the mean of the ``near`` embedded ones nearest to it, by the inverse of the squared distance."""
    held = rows.orderBy(*order, key).limit(most).select(key, vector).toPandas()
    x = np.stack(held[vector].to_list()).astype(float) if len(held) else np.zeros((0, 1))
    shared = rows.sparkSession.sparkContext.broadcast((dict(zip(held[key], range(len(held)), strict=True)), x, tsne(x, **settings)))  # at most ``most`` points

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, x, y = shared.value
        for frame in frames:
            for start in range(0, len(frame), 500):
                part = frame.iloc[start : start + 500]
                v = np.stack(part[vector].to_list()).astype(float)
                distance = np.maximum((v * v).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * v @ x.T, 1e-12)
                best = np.argpartition(distance, min(near, len(x)) - 1, axis=1)[:, :near]
                weight = 1 / np.take_along_axis(distance, best, 1)
                point = (y[best] * weight[:, :, None]).sum(1) / weight.sum(1)[:, None]
                for i, k in enumerate(part[key]):
                    if k in at:
                        point[i] = y[at[k]]
                yield pd.DataFrame({key: part[key], label: part[label], "x": point[:, 0], "y": point[:, 1]})

    return rows.select(key, label, vector).mapInPandas(place, f"{key} string, {label} string, x double, y double")

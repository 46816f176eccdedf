"""Small neural nets in numpy, one for each label: feed-forward with tanh layers and a recurrent one with peephole gates.

Training is synchronous and data-parallel: in each round every task starts from the broadcast weights, runs RMSProp over its own rows in mini-batches as they stream
by, and gives its weights and its number of rows; the weighted mean starts the next round. Rows are spread once, into tasks of about ``ROWS`` rows, as many as the collection needs. No task holds more than a
mini-batch of rows; means are taken by a tree of ``WIDTH`` sets of weights a node, so what the driver gets is ``WIDTH`` sets, whose size the layers fix.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Rows of a task's part of the collection at most and, where there are tasks to spare, at least, about; sets of weights that one task or the driver takes the mean of, at most; nets that are trained in the same passes.
ROWS, FEW, WIDTH, TOGETHER = 20_000, 500, 32, 16


def _xavier(rng: np.random.Generator, n: int, m: int) -> np.ndarray:
    return rng.normal(0, np.sqrt(2.0 / (n + m)), (n, m))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class FeedForward:
    """Layers of tanh and a softmax output of two classes."""

    layers: tuple[int, ...]
    seed: int = 123
    weights: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not self.weights:
            rng = np.random.default_rng(self.seed)
            for n, m in zip(self.layers, self.layers[1:], strict=False):
                self.weights += [_xavier(rng, n, m), np.zeros(m)]

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i in range(0, len(self.weights), 2):
            z = out[-1] @ self.weights[i] + self.weights[i + 1]
            out.append(np.tanh(z) if i + 2 < len(self.weights) else _softmax(z))
        return out

    def probability(self, x: np.ndarray, length: np.ndarray | None = None) -> np.ndarray:
        """Of the label being true."""
        return self.forward(x)[-1][:, 1]

    def gradients(self, x: np.ndarray, y: np.ndarray, length: np.ndarray | None = None) -> list[np.ndarray]:
        out = self.forward(x)
        delta, grads = (out[-1] - np.eye(2, dtype=out[-1].dtype)[y]) / len(x), []
        for i in range(len(self.weights) - 2, -1, -2):
            grads = [out[i // 2].T @ delta, delta.sum(0), *grads]
            if i:
                delta = (delta @ self.weights[i].T) * (1 - out[i // 2] ** 2)
        return grads


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _softsign(z: np.ndarray) -> np.ndarray:
    return z / (1 + np.abs(z))


def _softsign_slope(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.abs(z)) ** 2


@dataclass
class Recurrent:
    """Gated recurrent cells with peepholes and softsign, softmax at a sequence's last real step. Gradients are clipped to -1 to 1."""

    size: int
    hidden: int = 10
    seed: int = 123
    weights: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not self.weights:
            rng, h = np.random.default_rng(self.seed), self.hidden
            bias = np.zeros(4 * h)
            bias[h : 2 * h] = 1.0  # remember at first
            self.weights = [_xavier(rng, self.size, 4 * h), _xavier(rng, h, 4 * h), bias, rng.normal(0, 0.1, (3, h)), _xavier(rng, h, 2), np.zeros(2)]

    def forward(self, x: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, list]:
        wx, wh, b, peep, wo, bo = self.weights
        n, h = len(x), self.hidden
        hidden, cell, steps = np.zeros((n, h)), np.zeros((n, h)), []
        for t in range(x.shape[1]):
            z = x[:, t] @ wx + hidden @ wh + b
            i, f = _sigmoid(z[:, :h] + peep[0] * cell), _sigmoid(z[:, h : 2 * h] + peep[1] * cell)
            g = _softsign(z[:, 2 * h : 3 * h])
            new = f * cell + i * g
            o = _sigmoid(z[:, 3 * h :] + peep[2] * new)
            out = o * _softsign(new)
            live = (t < length)[:, None]
            steps.append((hidden, cell, z, i, f, g, new, o, live))
            hidden, cell = np.where(live, out, hidden), np.where(live, new, cell)
        return _softmax(hidden @ wo + bo), [*steps, hidden]

    def probability(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.forward(x, length)[0][:, 1]

    def gradients(self, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        wx, wh, b, peep, wo, bo = self.weights
        p, steps = self.forward(x, length)
        last, h = steps.pop(), self.hidden
        delta = (p - np.eye(2)[y]) / len(x)
        grads = [np.zeros_like(w) for w in self.weights]
        grads[4], grads[5] = last.T @ delta, delta.sum(0)
        dh, dc = delta @ wo.T, np.zeros_like(last)
        for t in range(len(steps) - 1, -1, -1):
            hidden, cell, z, i, f, g, new, o, live = steps[t]
            d_out, d_new = np.where(live, dh, 0), np.where(live, dc, 0)
            do = d_out * _softsign(new) * o * (1 - o)
            d_new = d_new + d_out * o * _softsign_slope(new) + do * peep[2]
            di, df = d_new * g * i * (1 - i), d_new * cell * f * (1 - f)
            dz = np.concatenate([di, df, d_new * i * _softsign_slope(z[:, 2 * h : 3 * h]), do], 1)
            grads[0] += x[:, t].T @ dz
            grads[1] += hidden.T @ dz
            grads[2] += dz.sum(0)
            grads[3] += np.stack([(di * cell).sum(0), (df * cell).sum(0), (do * new).sum(0)])
            dh = np.where(live, dz @ wh.T, dh)
            dc = np.where(live, d_new * f + di * peep[0] + df * peep[1], dc)
        return [np.clip(g, -1, 1) for g in grads]


def _batches(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for at in range(0, len(frame), size):
            yield frame.iloc[at : at + size]


def _arrays(frame: pd.DataFrame, net) -> tuple[np.ndarray, np.ndarray]:
    """Features of a mini-batch, and the real length of each sequence."""
    if isinstance(net, FeedForward) and len(frame) and not isinstance(frame["features"].iloc[0], (list, np.ndarray)):  # places and weights of a bag
        x = np.zeros((len(frame), net.layers[0]))
        for i, bag in enumerate(frame["features"]):
            x[i, np.asarray(bag["indices"], int)] = np.asarray(bag["weights"], float)
        return x, np.ones(len(frame), int)
    if isinstance(net, FeedForward):
        return np.stack([np.asarray(v, float) for v in frame["features"]]), np.ones(len(frame), int)
    real = [[s for s in steps if s is not None] for steps in frame["features"]]
    length = np.array([len(s) for s in real])
    x = np.zeros((len(real), max(1, length.max()), net.size))
    for i, steps in enumerate(real):
        if steps:
            x[i, : len(steps)] = np.stack([np.asarray(s, float) for s in steps])
    return x, length


def _mean(sets: list[tuple[list[np.ndarray], int]]) -> tuple[list[np.ndarray], int]:
    """The mean of sets of weights by their rows, one after the other, and the rows of all."""
    total = sum(n for _, n in sets)
    mean = [np.zeros(w.shape) for w in sets[0][0]]
    for own, n in sets:
        for m, w in zip(mean, own, strict=True):
            m += w * (n / total)
    return mean, total


def _averaged(frame: pd.DataFrame) -> pd.DataFrame:
    """One row of the mean of the sets of weights of a node."""
    mean, n = _mean([(pickle.loads(w), int(k)) for w, k in zip(frame["weights"], frame["n"], strict=True)])
    return pd.DataFrame({"node": [int(frame["node"].iloc[0])], "net": [int(frame["net"].iloc[0])], "weights": [pickle.dumps(mean)], "n": [n]})


def spread(rows: DataFrame, workers: int | None = None) -> tuple[DataFrame, int]:
    """Rows written once in parts, numbered, and how many; a part is one task's."""
    from pyspark.sql import functions as F

    from tidewire.storage import cut

    if not workers:
        n = rows.count()
        workers = max(1, -(-n // ROWS), min(rows.sparkSession.sparkContext.defaultParallelism, n // FEW))
    return cut(rows.repartition(workers).withColumn("part", F.spark_partition_id()), "spread"), workers


def fit(rows: DataFrame, net, rounds: int = 5, rate: float = 0.01, batch: int = 50, decay: float = 0.95, workers: int | None = None):
    """The net trained on rows (features, label). features: an array of numbers, (indices, weights) of a bag, or for a recurrent net an array of arrays, padded with nulls. rate: the step of RMSProp. workers: parts of the rows, in place of as many as they need."""
    from pyspark.sql import functions as F

    data, workers = spread(rows.select("features", F.array("label").alias("labels")), workers)
    return _fit(data, workers, [net], rounds, rate, batch, decay)[0]


def _fit(data: DataFrame, workers: int, nets: list, rounds: int, rate: float, batch: int, decay: float) -> list:
    """``fit`` of several nets in the same passes, on rows (features, labels, part) that are spread already; labels has 0 or 1 for each net."""
    from pyspark.sql import functions as F

    context, kinds = data.sparkSession.sparkContext, "node int, net int, weights binary, n long"
    for _ in range(rounds):
        shared = context.broadcast(nets)

        def train(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own = pickle.loads(pickle.dumps(shared.value))
            for net in own:
                net.weights = [w.astype(np.float32) for w in net.weights]  # half the memory to move; means are taken in double precision
            means = [[np.zeros_like(w) for w in net.weights] for net in own]
            spare = [np.zeros_like(w) for w in own[0].weights] if own else []
            seen, part_of = 0, 0
            for part in _batches(frames, batch):
                x, length = _arrays(part, own[0])
                x, labels = x.astype(np.float32), np.stack([np.asarray(v, int) for v in part["labels"]])
                for k, net in enumerate(own):
                    for w, g, m, t in zip(net.weights, net.gradients(x, labels[:, k], length), means[k], spare, strict=True):
                        m *= np.float32(decay)
                        np.multiply(g, g, out=t)
                        t *= np.float32(1 - decay)
                        m += t
                        np.sqrt(m, out=t)
                        t += np.float32(1e-8)
                        np.divide(g, t, out=t)
                        t *= np.float32(rate)
                        w -= t
                seen += len(part)
                part_of = int(part["part"].iloc[0])
            if seen:
                for k, net in enumerate(own):
                    yield pd.DataFrame({"node": [part_of], "net": [k], "weights": [pickle.dumps(net.weights)], "n": [seen]})

        sets, width = data.mapInPandas(train, kinds), workers
        while width > max(1, WIDTH // len(nets)):  # parts of several files may give several sets; they meet here
            width = max(1, -(-width // WIDTH))
            sets = sets.withColumn("node", F.pmod("node", F.lit(width)).cast("int")).groupBy("net", "node").applyInPandas(_averaged, kinds)
        got: dict[int, list] = {}
        for r in sets.collect():  # WIDTH at most, or one for each net
            got.setdefault(r["net"], []).append((pickle.loads(r["weights"]), r["n"]))
        if not got:
            break
        for k, own in got.items():
            nets[k].weights = _mean(own)[0]
    return nets


def fit_each(rows: DataFrame, labels: str, categories: list[str], make, rounds: int = 5, rate: float = 0.01, batch: int = 50, decay: float = 0.95, workers: int | None = None) -> dict:
    """A net for each category, from ``make()``; rows have features and an array of labels. The rows are spread once, and ``TOGETHER`` nets are trained in the same passes."""
    from pyspark.sql import functions as F

    held = F.coalesce(F.col(labels), F.array().cast("array<string>"))
    data, workers = spread(rows.select("features", held.alias("_held")), workers)
    out = {}
    for i in range(0, len(categories), TOGETHER):
        some = categories[i : i + TOGETHER]
        marks = F.array(*[F.array_contains("_held", c).cast("int") for c in some]).alias("labels")
        out |= dict(zip(some, _fit(data.select("features", "part", marks), workers, [make() for _ in some], rounds, rate, batch, decay), strict=True))
    return out


def predict(rows: DataFrame, nets: dict, key: str = "id") -> DataFrame:
    """(key, pred): the sorted categories whose net gives more than a half; in batches as they stream by."""
    shared = rows.sparkSession.sparkContext.broadcast(nets)
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _batches(frames, 500):
            said = {c: net.probability(*_arrays(frame, net)) > 0.5 for c, net in shared.value.items()}
            yield pd.DataFrame({key: frame[key], "pred": [sorted(c for c in said if said[c][i]) for i in range(len(frame))]})

    return rows.select(key, "features").mapInPandas(run, f"{key} {kind}, pred array<string>")


def grid(rates: list[float], batches: list[int]) -> list[dict]:
    """Settings of a search over step and mini-batch."""
    return [{"rate": r, "batch": b} for r in rates for b in batches]


def log_means(log: DataFrame, back: int = 100, short: int = 8) -> DataFrame:
    """A training log (run, iteration, score) with the mean of the last ``back`` scores and the mean change over the last ``short``."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    w = Window.partitionBy("run").orderBy("iteration")
    change = F.col("score") - F.lag("score").over(w)
    return log.withColumn("mean_score", F.avg("score").over(w.rowsBetween(1 - back, 0))).withColumn("_d", change).withColumn("mean_change", F.avg("_d").over(w.rowsBetween(1 - short, 0))).drop("_d")

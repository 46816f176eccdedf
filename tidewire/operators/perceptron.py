"""Spark's multilayer perceptron in numpy, for several labels at a time: a task has all rows and trains one label's net.

Spark's own trainer runs a job over the cluster for each gradient of each label. Here the rows are sent to as many tasks as there are labels, once, and what a step needs stays in its task. Steps are those of
``MultilayerPerceptronClassifier`` with its solver l-bfgs on the same rows in one partition, in the order of ``ordered``: the same first weights, blocks, line search and end. A row goes through a net in
single precision, unless double is asked for; sums over batches, losses, steps and what follows from them are in double, and a net whose line search fails goes on in double.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a block, each of which counts as much as any other; rows that go through a net at once; pairs of steps and changes of the gradient that are kept.
BLOCK, BATCH, KEPT = 128, 512, 10
#: Numbers of the features of all rows, at most, that a task holds.
MOST = 1 << 25


class Failed(Exception):
    """A line search found no step, or what is kept of steps is of no use."""


def parts(layers: list[int], flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of the weights (from, to) and biases of each layer."""
    out, at = [], 0
    for n, m in zip(layers, layers[1:], strict=False):
        out.append((flat[at : at + n * m].reshape(n, m), flat[at + n * m : at + n * m + m]))
        at += n * m + m
    return out


def forward(net: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> list[np.ndarray]:
    """What each layer gives, from the features on: sigmoid, at last softmax."""
    out = [x]
    with np.errstate(over="ignore"):
        for w, b in net[:-1]:
            z = out[-1] @ w
            np.exp(np.subtract(-b, z, out=z), out=z)
            z += 1
            out.append(np.divide(1, z, out=z))
    w, b = net[-1]
    z = (out[-1] @ w + b).astype(float)
    z = np.exp(z - z.max(1, keepdims=True))
    return [*out, z / z.sum(1, keepdims=True)]


def ordered(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the rows in an order that is theirs, as they come as the shuffle gives them, but has nothing to do with their features' size: by a hash of features and label."""
    return np.argsort([zlib.crc32(row.tobytes(), int(label)) for row, label in zip(x, y, strict=True)], kind="stable")


class Loss:
    """Cross-entropy of rows, and its gradient: the mean of blocks, as the last one may have fewer rows. Rows with the same features go through a net once, with the weights of all of them."""

    def __init__(self, layers: list[int], x: np.ndarray, y: np.ndarray) -> None:
        n, blocks, place = len(x), -(-len(x) // BLOCK), {}
        share = np.full(n, 1 / (BLOCK * blocks))
        share[(blocks - 1) * BLOCK :] = 1 / ((n - (blocks - 1) * BLOCK) * blocks)
        order = ordered(x, y)
        at = np.array([place.setdefault(x[i].tobytes(), len(place)) for i in order])
        self.layers, self.x, self.first = layers, x, order[np.unique(at, return_index=True)[1]]
        self.target = np.zeros((len(place), layers[-1]))  # the weight of the rows with each label
        np.add.at(self.target, (at, y[order]), share)

    def __call__(self, flat: np.ndarray, kind: type = np.float64) -> tuple[float, np.ndarray]:
        net, total, loss = parts(self.layers, flat.astype(kind, copy=False)), np.zeros_like(flat), 0.0
        grads, spare = parts(self.layers, total), [np.empty(w.shape, kind) for w, _ in net]
        for at in range(0, len(self.first), BATCH):
            target = self.target[at : at + BATCH]
            out = forward(net, self.x[self.first[at : at + BATCH]].astype(kind, copy=False))
            with np.errstate(divide="ignore", invalid="ignore"):
                loss -= float((target * np.log(out[-1])).sum())
            delta = (out[-1] * target.sum(1, keepdims=True) - target).astype(kind)
            for i in range(len(net) - 1, -1, -1):
                w, b = grads[i]
                w += np.matmul(out[i].T, delta, out=spare[i])
                b += delta.sum(0)
                if i:
                    delta = delta @ net[i][0].T
                    delta *= out[i]
                    np.subtract(1, out[i], out=out[i])
                    delta *= out[i]
        return loss, total


def _cubic(a: tuple[float, float, float], b: tuple[float, float, float]) -> float:
    """The least place of a cubic between two (place, value, slope), not close to either."""
    (s, f, df), (t, g, dg) = sorted((a, b))
    d1 = df + dg - 3 * (f - g) / (s - t)
    square = d1 * d1 - df * dg
    d2 = math.sqrt(square) if square >= 0 else math.nan
    under = dg - df + 2 * d2
    at = t - (t - s) * (dg + d2 - d1) / under if under else math.nan
    low, high = s + 0.1 * (t - s), s + 0.9 * (t - s)
    return low if at < low else high if at > high else at


def _search(phi: Callable[[float], tuple[float, float, float]], low: tuple[float, float, float], t: float) -> float:
    """A step that the strong Wolfe conditions allow. low: (0, value, slope) at the start."""
    _, first, slope = low
    if slope > 0:
        raise Failed

    def zoom(low: tuple[float, float, float], high: tuple[float, float, float]) -> float:
        for _ in range(10):
            c = phi(_cubic(low, high))
            if c[1] > first + 1e-4 * c[0] * slope or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= 0.9 * abs(slope):
                return c[0]
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise Failed

    for i in range(10):
        c = phi(t)
        if not math.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > first + 1e-4 * t * slope or (c[1] >= low[1] and i > 0):
            return zoom(low, c)
        if abs(c[2]) <= 0.9 * abs(slope):
            return c[0]
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise Failed


def _direction(grad: np.ndarray, steps: list[np.ndarray], changes: list[np.ndarray]) -> np.ndarray:
    """Downhill by what is kept, the newest first."""
    scale = 1.0
    if steps:
        product = float(steps[0] @ changes[0])
        if not product >= 0:
            raise Failed
        square = float(changes[0] @ changes[0])
        scale = product / square if square else math.nan
    out, kept = grad.copy(), []
    for s, c in zip(steps, changes, strict=True):
        rho = float(s @ c)
        a = float(s @ out) / rho if rho else math.nan
        if math.isnan(a):
            raise Failed
        out -= a * c
        kept.append((rho, a))
    out *= scale
    for s, c, (rho, a) in zip(reversed(steps), reversed(changes), reversed(kept), strict=True):
        out += (a - float(c @ out) / rho) * s
    return np.negative(out, out=out)


def descend(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, exact: Callable[[np.ndarray], tuple[float, np.ndarray]] | None = None, tolerance: float = 1e-6) -> tuple[np.ndarray, list[float]]:
    """L-BFGS from ``x``: the weights, and the loss at first and after each round. exact: takes the place of ``loss`` once a search has failed."""
    value, grad = loss(x)
    history, recent, steps, changes, failed = [value], [math.inf], [], [], False
    while len(history) <= rounds:
        flat = len(recent) >= 2 and abs(value - max(recent)) <= tolerance * history[0]
        if flat or float(np.linalg.norm(grad)) <= max(tolerance * value, 1e-8):
            break
        try:
            down = _direction(grad, steps, changes)
            seen: dict = {}

            def phi(t: float, x=x, down=down, seen=seen) -> tuple[float, float, float]:
                seen["x"] = x + down * t
                seen["value"], seen["grad"] = loss(seen["x"])
                return t, seen["value"], float(seen["grad"] @ down)

            t = _search(phi, (0.0, value, float(grad @ down)), 1.0 if len(history) > 1 else 1 / float(np.linalg.norm(down)))
            if t * float(np.linalg.norm(grad)) < 1e-10:
                raise Failed
        except Failed:
            if failed:
                break
            failed, steps, changes = True, [], []
            if exact:
                loss, exact = exact, None
                value, grad = loss(x)
            continue
        failed = False
        steps, changes = [seen["x"] - x, *steps[: KEPT - 1]], [seen["grad"] - grad, *changes[: KEPT - 1]]
        x, value, grad = seen["x"], seen["value"], seen["grad"]
        history.append(value)
        recent = [*recent, value][-20:]
    return x, history


def _numbers(column: pa.Array, size: int) -> np.ndarray:
    """Rows of ``size`` numbers of a column of arrays."""
    if column.null_count or set(np.diff(column.offsets.to_numpy())) - {size}:
        raise ValueError(f"features must have {size} numbers")
    return column.flatten().to_numpy().reshape(-1, size)


def fit(rows: DataFrame, layers: list[int], first: np.ndarray, labels: int, rounds: int, kind: type = np.float32) -> list[np.ndarray]:
    """Weights of a net for each label, on rows (numbers, marks): marks has 0 or 1 for each label."""
    from pyspark.sql import functions as F

    from tidewire.storage import cut

    start = rows.sparkSession.sparkContext.broadcast(first)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, marks, net = [], [], None
        for batch in batches:
            if batch.num_rows:
                net = batch.column(0)[0].as_py()
                marks.append(batch.column(1).to_numpy().astype(int))
                held.append(_numbers(batch.column(2), layers[0]).copy())
        if net is None:
            return
        x, at = np.empty((sum(map(len, held)), layers[0])), 0
        while held:
            some = held.pop(0)
            x[at : at + len(some)] = some
            at += len(some)
        if not np.isfinite(x).all():
            raise ValueError("features must be finite")
        loss = Loss(layers, x, np.concatenate(marks))
        weights, _ = descend(partial(loss, kind=kind), start.value.copy(), rounds, loss if kind != np.float64 else None)
        yield pa.RecordBatch.from_pydict({"net": pa.array([net], pa.int32()), "weights": pa.array([weights.tobytes()], pa.binary())})

    each = rows.select(F.posexplode("marks").alias("net", "mark"), "numbers").repartitionById(labels, F.col("net"))
    done = cut(each.mapInArrow(train, "net int, weights binary"), "nets")
    return [np.frombuffer(done.where(F.col("net") == i).first()["weights"]) for i in range(labels)]  # one after the other, as the driver has little room


def predict(rows: DataFrame, nets: dict[str, tuple[list[int], np.ndarray]], key: str) -> DataFrame:
    """(key, pred) of rows (key, numbers): the sorted names whose net finds the second side likelier than the first."""
    shared = rows.sparkSession.sparkContext.broadcast(nets)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said: list[list[str]] = [[] for _ in range(batch.num_rows)]
            for at in range(0, batch.num_rows, BATCH):
                part = batch.column(1).slice(at, BATCH)
                for name, (layers, weights) in sorted(shared.value.items()):
                    out = forward(parts(layers, weights), _numbers(part, layers[0]))[-1]
                    for i in np.flatnonzero(out[:, 1] > out[:, 0]):
                        said[at + i].append(name)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.list_(pa.string()))], names=[key, "pred"])

    return rows.select(key, "numbers").mapInArrow(run, f"`{key}` {kind}, pred array<string>")

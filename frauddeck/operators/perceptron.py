"""Training of Spark ML's perceptron by numpy sums over Spark partitions.

The layers, their weights' order, the loss and the training are those of
``MultilayerPerceptronClassifier``: sigmoid layers, softmax at the end, mean cross entropy, L-BFGS of ten
corrections with a strong Wolfe line search, from the classifier's own first weights. It spends its time on
products of small matrices; here a task takes them over blocks of ``BLOCK`` rows in numpy, in single
precision, and adds up blocks in double. Blocks are packed and kept once (memory, then the executors' disks); an evaluation is one job, whose tasks return
one vector of the weights' size, added up in a tree. A row counts ``weight`` times, which is what repeating it would do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, MEMORY = 512, 10


def _layers(flat: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights of inputs x outputs, bias) of each layer, as views."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def loss_and_gradient(flat: np.ndarray, sizes: list[int], x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Cross entropy of a block of rows and its gradient, summed over the rows' weights; layers have the precision of ``x``."""
    layers, seen = _layers(flat.astype(x.dtype), sizes), [x]
    for i, (a, b) in enumerate(layers):
        z = seen[-1] @ a
        z += b
        if i < len(layers) - 1:
            np.clip(z, -80, 80, out=z)
            np.negative(z, out=z)
            np.exp(z, out=z)
            z += 1
            np.reciprocal(z, out=z)
        seen.append(z)
    z = seen.pop().astype(float)
    z -= z.max(axis=1, keepdims=True)
    rows, p = np.arange(len(y)), np.exp(z)
    total = p.sum(axis=1)
    loss = float((w * (np.log(total) - z[rows, y])).sum())
    p /= total[:, None]
    p[rows, y] -= 1.0
    p *= w[:, None]
    p, parts = p.astype(x.dtype), []
    for (a, _), h in zip(reversed(layers), reversed(seen)):
        parts = [(h.T @ p).ravel(), p.sum(axis=0), *parts]
        if h is not x:
            p = p @ a.T
            p *= h
            p *= 1 - h
    return loss, np.concatenate(parts, dtype=float)


def packed(df: DataFrame, features: list[str], label: str, mean: np.ndarray, scale: np.ndarray, weight: float) -> RDD:
    """Blocks (rows, labels, weights) of standardised rows, evenly dealt and kept; rows with label 1 weigh ``weight``."""
    n = len(features)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = np.stack([part.column(1 + i).to_numpy(zero_copy_only=False) for i in range(n)], axis=1)
                y = part.column(0).to_numpy(zero_copy_only=False)
                if not (np.isin(y, (0, 1)).all() and np.isfinite(x).all()):
                    raise ValueError("the perceptron takes labels 0 and 1 and finite features")
                yield pa.record_batch([pa.array([y.astype(np.int8).tobytes()], pa.binary()),
                                       pa.array([((x - mean) * scale).astype(np.float32).tobytes()], pa.binary())], ["y", "x"])

    def unpacked(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y = np.frombuffer(row["y"], np.int8).astype(np.intp)
        return np.frombuffer(row["x"], np.float32).reshape(len(y), n), y, np.where(y == 1, float(weight), 1.0)
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    blocks = df.select(F.col(label).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)]).mapInArrow(pack, "y binary, x binary")
    return blocks.repartition(tasks).rdd.map(unpacked).persist(StorageLevel.MEMORY_AND_DISK)


def evaluation(blocks: RDD, sizes: list[int]) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """The function (weights) -> (mean loss, its gradient), one job a call."""
    def evaluate(flat: np.ndarray) -> tuple[float, np.ndarray]:
        sent = blocks.context.broadcast(flat)

        def summed(rows):
            total = np.zeros(len(sent.value) + 2)
            for x, y, w in rows:
                loss, grad = loss_and_gradient(sent.value, sizes, x, y, w)
                total[0] += loss
                total[1] += w.sum()
                total[2:] += grad
            yield total
        total = blocks.mapPartitions(summed).treeReduce(np.add)
        sent.destroy()
        return float(total[0] / total[1]), total[2:] / total[1]
    return evaluate


def _cubic(lo: tuple, hi: tuple) -> float:
    """Between two steps (place, value, slope), the least point of the cubic through them, well inside."""
    (a, fa, da), (b, fb, db) = lo, hi
    d1 = da + db - 3 * (fa - fb) / (a - b)
    d2 = np.sign(b - a) * np.sqrt(max(d1 * d1 - da * db, 0.0))
    bottom = db - da + 2 * d2
    t = b - (b - a) * (db + d2 - d1) / bottom if bottom else np.nan
    left, right = min(a, b), max(a, b)
    room = 0.1 * (right - left)
    return float(min(max(t, left + room), right - room)) if np.isfinite(t) else (a + b) / 2


def _wolfe(along: Callable[[float], tuple], first: tuple, t: float) -> tuple | None:
    """A step (place, value, slope, gradient) that meets the strong Wolfe conditions (1e-4, 0.9), or None."""
    f0, d0 = first[1], first[2]

    def zoom(lo: tuple, hi: tuple) -> tuple | None:
        for _ in range(10):
            at = along(_cubic(lo[:3], hi[:3]))
            if not at[1] <= f0 + 1e-4 * at[0] * d0 or at[1] >= lo[1]:
                hi = at
            else:
                if abs(at[2]) <= 0.9 * abs(d0):
                    return at
                hi = lo if at[2] * (hi[0] - lo[0]) >= 0 else hi
                lo = at
        return lo if lo[0] > 0 else None
    low = first
    for i in range(10):
        at = along(t)
        if not np.isfinite(at[1]):
            t /= 2
            continue
        if at[1] > f0 + 1e-4 * t * d0 or (at[1] >= low[1] and i > 0):
            return zoom(low, at)
        if abs(at[2]) <= 0.9 * abs(d0):
            return at
        if at[2] >= 0:
            return zoom(at, low)
        low, t = at, t * 1.5
    return low if low[0] > 0 else None


def minimum(evaluate: Callable, flat: np.ndarray, rounds: int, tolerance: float) -> np.ndarray:
    """L-BFGS with the classifier's ends: ``rounds``, a gradient of almost nothing, or a loss that
    changes by less than ``tolerance`` of the first one over 20 rounds."""
    value, grad = evaluate(flat)
    first, values, pairs = value, [], []
    for i in range(rounds):
        if np.linalg.norm(grad) <= max(tolerance * value, 1e-8):
            break
        q, alphas = grad.copy(), []
        for s, y in reversed(pairs):
            alphas.append(s @ q / (s @ y))
            q -= alphas[-1] * y
        if pairs:
            q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
        for (s, y), a in zip(pairs, reversed(alphas)):
            q += s * (a - y @ q / (s @ y))

        def along(t: float, q=q):
            v, g = evaluate(flat - t * q)
            return t, v, float(-(g @ q)), g
        found = _wolfe(along, (0.0, value, float(-(grad @ q))), 1.0 if pairs else 1.0 / np.linalg.norm(q)) if grad @ q > 0 else None
        if found is None:
            if not pairs:
                break
            pairs = []  # once more, straight down
            continue
        step = -found[0] * q
        if (change := found[3] - grad) @ step > 0:
            pairs = [*pairs, (step, change)][-MEMORY:]
        flat, value, grad = flat + step, found[1], found[3]
        values = [*values, value][-20:]
        if len(values) == 20 and abs(value - max(values)) <= tolerance * first:
            break
    return flat

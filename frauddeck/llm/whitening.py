"""Whitening of embeddings by a bit-sliced scatter matrix.

A component ``c`` becomes the whole number ``floor(scale * c) + base``. The fit list holds each
distinct vector of them once. Its cross-products are counted, not multiplied: in a block of rows
each dimension's numbers, shifted by their least, are cut into bit planes; a plane packs one bit
of 64 rows into a word. The product sum of dimensions i and j is the sum over planes a, b of
2^(a+b) times the population count of ``plane(i, a) AND plane(j, b)``. Blocks undo their shifts
exactly; Spark adds the blocks' sums as decimals. The covariance is centred in whole numbers,
``(n * sum(x_i x_j) - S_i S_j) / n^2``, and only then rounded to doubles for ``eigh``.

A task holds one block (``BLOCK`` rows) and its planes. Vectors are shuffled once, to tell equal
ones, with copies dropped before it; the driver holds numbers by dimension and by pairs of
dimensions, whatever the number of rows.

Defined results: rows with a null vector, an unusual length (see :mod:`frauddeck.llm.vectors`)
or a null or non-finite component are left out; null ids and repeated rows stay, repeated
vectors count once. Components whose variance is not told from rounding (1e-11 of the largest)
have no whitened values and are left out, so a single distinct vector gives no rows, as does an
empty table. Numbers beyond 2^62 stay there. A deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frauddeck.llm import common as C
from frauddeck.llm import vectors as V

BLOCK = 1 << 16
#: Sums cross Spark as two numbers: the multiple of 2^60, and the rest.
LOW_BITS = 60
TOLD_FROM_ZERO = 1e-11


@dataclass
class Whitening:
    """A fitted transform: what all rows need, of a size given by the dimensions."""
    length: int
    scale: float
    base: int
    n: int
    sums: list[int]
    variances: np.ndarray  # by component, falling
    axes: np.ndarray  # a unit eigenvector in each column
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], object)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole.astype(np.int64)).astype(np.float64) - part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.axes / np.sqrt(self.variances))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """``sum((n x - S)^2)`` of each row, exactly."""
        sums = np.array(self.sums, object)
        top = max((max(abs(self.n * int(a) - s), abs(self.n * int(b) - s)) for a, b, s in zip(x.min(axis=0), x.max(axis=0), self.sums)), default=0) if len(x) else 0
        if top * top * self.length < 1 << 63 and max(map(abs, self.sums)) < 1 << 62 and self.n * int(np.abs(x).max(initial=0)) < 1 << 62:
            d = self.n * x - sums.astype(np.int64)
            return (d * d).sum(axis=1).tolist()
        d = self.n * x.astype(object) - sums
        return [v if v < 1 << 63 else None for v in map(int, (d * d).sum(axis=1))]


def numbers(values: np.ndarray, scale: float, base: int) -> np.ndarray:
    return V.floored(values, scale) + base


def planes(u: np.ndarray) -> list[np.ndarray]:
    """Bit planes of a matrix of unsigned numbers: for each bit, words of 64 rows by dimension."""
    rows, dims = u.shape
    full = np.zeros((-(-rows // 64) * 64, dims), np.uint64)
    full[:rows] = u
    out = []
    for b in range(int(u.max(initial=0)).bit_length()):
        bits = np.packbits(((full >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=0)
        out.append(np.ascontiguousarray(bits.T).view(np.uint64))
    return out


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and product sums of the columns of whole numbers, as Python integers."""
    n, dims = x.shape
    least = x.min(axis=0)
    cut = planes((x - least).view(np.uint64))
    sums, products = np.zeros(dims, object), np.zeros((dims, dims), object)
    for a, p in enumerate(cut):
        sums += np.bitwise_count(p).sum(axis=1, dtype=np.int64).astype(object) << a
        for b in range(a, len(cut)):
            counts = np.empty((dims, dims), np.int64)
            for i in range(dims):
                counts[i] = np.bitwise_count(p[i] & cut[b]).sum(axis=1, dtype=np.int64)
            counts = counts.astype(object) << (a + b)
            products += counts if a == b else counts + counts.T
    m = least.astype(object)
    products += np.outer(sums, m) + np.outer(m, sums) + n * np.outer(m, m)
    return sums + n * m, products


def usable(rows: DataFrame, ids: list[str], vector: str, length: int, scale: float, base: int) -> DataFrame:
    """``ids`` and ``x``, the packed whole numbers, of the rows that take part."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([T.StructField(f"c{i}", kinds[c]) for i, c in enumerate(ids)] + [T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, values = V.finite(batch.column(batch.num_columns - 1), length)
            keep = pa.array(mask)
            yield pa.record_batch([*[batch.column(i).filter(keep) for i in range(len(ids))], V.packed(numbers(values, scale, base))], schema.names)

    chosen = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(ids)], F.col(f"`{vector}`").alias("of"))
    return chosen.mapInArrow(run, schema)


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[np.ndarray]:
    held, n = [], 0
    for batch in batches:
        x = V.unpacked(batch.column(0), length)
        for s in range(0, len(x), BLOCK):
            held.append(x[s:s + BLOCK])
            n += len(held[-1])
            if n >= BLOCK:
                yield np.concatenate(held)
                held, n = [], 0
    if n:
        yield np.concatenate(held)


def fit(rows: DataFrame, vector: str, *, scale: float = 64.0, base: int = 1_000_000, components: int = 16) -> Whitening | None:
    """The transform of the rows' distinct vectors; None if there is nothing to fit."""
    length = V.usual_length(rows, vector)
    if not length:
        return None
    distinct = C.written(usable(rows, [], vector, length, scale, base).dropDuplicates(["x"]))
    ij = [(i, j) for i in range(length) for j in range(i, length)]

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(length, object), np.zeros((length, length), object)
        for x in _blocks(batches, length):
            s, p = cross_products(x)
            n, sums, products = n + len(x), sums + s, products + p
        if n:
            found = [n, *sums, *[products[i, j] for i, j in ij]]
            at = [(-1, -1), *[(i, -1) for i in range(length)], *ij]
            yield pa.record_batch([pa.array([i for i, _ in at], pa.int32()), pa.array([j for _, j in at], pa.int32()),
                                   pa.array([Decimal(int(v) >> LOW_BITS) for v in found], pa.decimal128(38, 0)),
                                   pa.array([int(v) & ((1 << LOW_BITS) - 1) for v in found], pa.int64())], ["i", "j", "high", "low"])

    parts = distinct.mapInArrow(scatter, "i int, j int, high decimal(38,0), low long")
    sums = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect()
    total = {(r["i"], r["j"]): (int(r["high"]) << LOW_BITS) + int(r["low"]) for r in sums}
    n = total.get((-1, -1), 0)
    if not n:
        return None
    s = [total[i, -1] for i in range(length)]
    v = np.zeros((length, length))
    for i, j in ij:
        v[i, j] = v[j, i] = (n * total[i, j] - s[i] * s[j]) / (n * n)  # Python rounds the exact quotient
    variances, axes = np.linalg.eigh(v)
    variances, axes = variances[::-1], axes[:, ::-1]
    kept = int((variances > TOLD_FROM_ZERO * max(variances[0], 0.0)).sum()) if variances[0] > 0 else 0
    k = min(components, kept)
    if not k:
        return None
    axes = axes[:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])  # the largest entry of an axis is positive
    model = Whitening(length, scale, base, n, s, variances[:k].copy(), axes, float(np.trace(v)))
    model.identity_error = _identity_error(distinct, model)
    return model


def _identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, measured."""
    k = len(model.variances)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for x in _blocks(batches, model.length):
            w = model.whitened(x)
            total += w.sum(axis=0)
            products += w.T @ w
        yield pa.record_batch([pa.array(np.repeat(np.arange(k + 1), k), pa.int32()), pa.array(np.tile(np.arange(k), k + 1), pa.int32()),
                               pa.array(np.concatenate([products.ravel(), total]))], ["i", "j", "v"])

    found = distinct.mapInArrow(scatter, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    cov, mean = np.zeros((k, k)), np.zeros(k)
    for r in found:
        if r["i"] == k:
            mean[r["j"]] = r["v"] / model.n
        else:
            cov[r["i"], r["j"]] = r["v"] / model.n
    # values are centred before they are multiplied; the mean is what rounding leaves
    return float(np.abs(cov - np.outer(mean, mean) - np.eye(k)).max())


RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def transform(rows: DataFrame, model: Whitening | None, id_col: str, vector: str) -> DataFrame:
    """A row for each usable row and component: ``id_col`` and ``RESULT``."""
    kind = rows.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind)] + T.StructType.fromDDL(RESULT).fields)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    k = len(model.variances)
    explained = model.variances / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 4096):
                batch = whole.slice(s, 4096)
                x = V.unpacked(batch.column(1), model.length)
                n = len(x)
                which = pa.array(np.repeat(np.arange(n), k))
                deviation = pa.array(model.deviations(x), pa.int64())
                yield pa.record_batch([batch.column(0).take(which), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model.n)),
                                       deviation.take(which), pa.array(model.whitened(x).ravel()), pa.array(np.tile(explained, n)),
                                       pa.array(np.full(n * k, model.identity_error))], schema.names)

    return usable(rows, [id_col], vector, model.length, model.scale, model.base).mapInArrow(run, schema).withColumnRenamed("id", id_col)

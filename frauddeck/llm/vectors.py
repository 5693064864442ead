"""Helpers of the vector operators: usable rows, their length, whole numbers made of components.

A vector takes part if it has the usual length (that of most vectors, of equally frequent ones
the least) and all its components are finite numbers; NaN, infinity and null are not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Whole numbers stay within this, so that differences of two fit 64 bits.
LIMIT = (1 << 62) - 1


def usual_length(rows: DataFrame, vector: str) -> int:
    """The length of most vectors; 0 if there is none."""
    n = F.size(F.col(f"`{vector}`"))
    found = rows.select(n.alias("n")).where("n > 0").groupBy("n").count().orderBy(F.desc("count"), "n").head(1)
    return int(found[0]["n"]) if found else 0


def finite(vectors: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are usable, and these as the rows of a matrix of doubles."""
    fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(vectors), length), False).to_numpy(zero_copy_only=False), bool)
    flat = vectors.filter(pa.array(fits)).flatten().cast(pa.float64(), safe=False)
    values = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False).reshape(-1, length)
    good = np.isfinite(values).all(axis=1)
    keep = np.flatnonzero(fits)[good]
    mask = np.zeros(len(vectors), bool)
    mask[keep] = True
    return mask, values[good]


def floored(values: np.ndarray, scale: float) -> np.ndarray:
    """``floor(scale * value)`` as 64-bit integers; beyond ``LIMIT`` they stay there."""
    with np.errstate(over="ignore"):
        x = np.floor(scale * values)
    big = np.abs(x) >= float(1 << 62)
    out = np.where(big, 0.0, x).astype(np.int64)
    return np.where(big, np.where(x > 0, LIMIT, -LIMIT), out)


def packed(x: np.ndarray) -> pa.Array:
    """Each row of a matrix as the bytes of its numbers."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    data = pa.py_buffer(x.tobytes())
    offsets = np.arange(len(x) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), data]).cast(pa.binary())


def unpacked(column: pa.Array, length: int, kind: str = "<i8") -> np.ndarray:
    """The matrix whose rows ``packed`` has written (no nulls)."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros((0, length), kind)
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]].view(kind).reshape(len(column), length)

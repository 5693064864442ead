"""Helpers shared by the text operators: tables, folds, labelled samples, byte-level words.

The numpy helpers work on the UTF-8 buffer of an Arrow string array, in slices of a few
megabytes, so the memory of a task depends on neither the batch size nor the input size (a
single text larger than a slice is a slice of its own).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frauddeck.session import ensure_checkpoint_dir

SLICE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: str | Column, mod: int) -> Column:
    """``crc32(doc_id as text) mod`` (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % mod


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, bound: int) -> DataFrame:
    """At most ``bound`` labelled texts ``(doc_id, text, label)``, the same ones on every run.

    Ids are drawn in the order of a hash from label rows that satisfy ``keep`` (a Column over
    ``doc_id``) and carry a label; an id with several label rows takes the largest label, an
    id with several texts the smallest text, so no key is larger than one row. Null ids, null
    labels and ids without a text are left out.
    """
    ids = (labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
           .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & keep)
           .groupBy("doc_id").agg(F.max("label").alias("label"))
           .orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), "doc_id").limit(bound))
    return (docs.select("doc_id", "text").where(F.col("text").isNotNull())
            .join(F.broadcast(ids), "doc_id")  # at most `bound` rows of two numbers
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")))


# ---------------------------------------------------------------- numpy over Arrow texts

def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text, or of one row."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    a, n = 0, len(texts)
    while a < n:
        b = int(np.searchsorted(total, total[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one entry more than texts). Null: empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_table(ranges: list[tuple[int, int]]) -> np.ndarray:
    """uint8 table: 1 for bytes inside the inclusive ranges."""
    t = np.zeros(256, np.uint8)
    for lo, hi in ranges:
        t[lo:hi + 1] = 1
    return t


#: Bytes of `[^\x20\x09-\x0D]`.
NOT_SPACE = byte_table([(0, 8), (14, 31), (33, 255)])


def runs(kind: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one non-zero class that stay inside a text: starts, ends, text number."""
    n = len(kind)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:n])
    change[off] = True
    cut = np.flatnonzero(change)
    starts, ends = cut[:-1], cut[1:]
    keep = kind[starts] > 0
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = (1 << 20) + 1
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a multiply-shift finaliser)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run (starts ascending, runs disjoint)."""
    out = np.empty(len(starts), np.uint64)
    up, down = _powers()
    step, a = len(up) - 1, 0
    while a < len(starts):
        b = int(np.searchsorted(ends, starts[a] + step, side="right"))
        if b <= a:  # a run longer than a block: folded block by block
            h = np.uint64(0)
            for s in range(int(starts[a]), int(ends[a]), step):
                part = data[s:min(s + step, int(ends[a]))].astype(np.uint64) + np.uint64(1)
                h = mix(np.array([h]))[0] + (part * up[:len(part)]).sum(dtype=np.uint64)
            out[a] = h
            a += 1
            continue
        s0, e0 = int(starts[a]), int(ends[b - 1])
        total = np.zeros(e0 - s0 + 1, np.uint64)
        np.cumsum((data[s0:e0].astype(np.uint64) + np.uint64(1)) * up[:e0 - s0], out=total[1:])
        s, e = starts[a:b] - s0, ends[a:b] - s0
        out[a:b] = (total[e] - total[s]) * down[s]
        a = b
    return mix(out)


def combine(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive hashes (length shrinks by k - 1)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _BASE + hashes[i:i + n]
    return mix(out)


def within(row: np.ndarray, k: int) -> np.ndarray:
    """Which of the k-windows over items with ascending text number lie in one text."""
    n = len(row) - k + 1
    return row[:n] == row[k - 1:] if n > 0 else np.zeros(0, bool)


def per_text(docs: DataFrame, start, result: str, passed: list[str] | None = None) -> DataFrame:
    """Adds columns computed from each row's whole text; rows are neither moved nor lost.

    ``start()`` runs once in a task and returns a function from an Arrow array of texts (a
    slice of a batch) to the Arrow arrays of the ``result`` columns (DDL). The outcome has the
    ``passed`` columns (default ``doc_id``; they may have any names) and then the result's.
    """
    passed = ["doc_id"] if passed is None else passed
    kinds = {f.name: f for f in docs.schema.fields}
    names = [f"c{i}" for i in range(len(passed))]
    new = T.StructType.fromDDL(result)
    schema = T.StructType([T.StructField(x, kinds[c].dataType) for x, c in zip(names, passed)] + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for batch in batches:
            for a, b in slices(batch.column(batch.num_columns - 1)):
                part = batch.slice(a, b - a)
                yield pa.record_batch([*part.columns[:-1], *f(part.column(part.num_columns - 1))], schema.names)

    rows = docs.select(*[F.col(f"`{c}`").alias(x) for x, c in zip(names, passed)], F.col("text").cast("string").alias("whole_text"))
    out = rows.mapInArrow(run, schema)
    return out.toDF(*passed, *new.names)


def written(rows: DataFrame) -> DataFrame:
    """``rows`` as a Parquet table in the shared checkpoint folder, read again: cuts the lineage."""
    spark = rows.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)

"""SimHash near-dedup: 64-bit fingerprints, exact tiled comparison, connected components.

1. Fingerprints: XXH64 (seed 42) of every three-word shingle, a bit is one if it is set in
   over half of them. Null, empty and word-free texts have fingerprint zero.
2. Distinct fingerprints (copies collapse before anything else) lie in cells by the population
   counts of their four 16-bit words; a cell is dealt into tiles of about ``TILE`` rows. Two
   fingerprints within the radius lie in cells whose counts differ by no more than the radius
   in sum, so all other pairs of tiles are skipped; the rest is compared in full by numpy
   exclusive-or and bit counts. Nothing is sampled or capped, and a pair of tiles never holds
   more than about two tiles of rows, however large a group of near copies is.
3. A pair of tiles returns a spanning forest of its links (fewer rows than it has
   fingerprints). Components of those links come from alternating large-star and small-star
   rounds of joins and minima, each written to the checkpoint folder.

The cells' sizes are broadcast: at most 17**4 rows, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frauddeck.llm import common as C
from frauddeck.session import ensure_checkpoint_dir

SHINGLE, RADIUS, TILE, SEED = 3, 2, 1024, 42
_SIDE, _TILES = 40, 1 << 24  # base of a cell's number (counts 0-16, moved by the radius); tiles of a cell


def _fingerprints(texts: pa.Array, shingle: int) -> np.ndarray:
    raw, off = C.utf8(texts)
    kind = C.NOT_SPACE[raw]
    starts, ends, row = C.runs(kind, off)
    out = np.zeros(len(texts), np.uint64)
    n = len(starts)
    if not n:
        return out
    size = ends - starts
    begin = np.concatenate([[0], np.cumsum(size + 1)])  # words joined by one space each
    flat = np.full(int(begin[-1]), 32, np.uint8)
    letters = np.flatnonzero(kind)
    flat[np.arange(len(letters)) + np.repeat(np.arange(n), size)] = C.LOWER[raw[letters]]
    whole = flat.tobytes()
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    words = np.diff(first)
    # the shingles of a text: one for each word but the last ones, at least one if it has words
    count = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    text = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + first[text]
    stop = np.minimum(place + shingle, first[text + 1]) - 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(whole[s:e], SEED) for s, e in zip(begin[place].tolist(), (begin[stop] + size[stop]).tolist())], np.uint64)
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = np.flatnonzero(count)
    ones = np.add.reduceat(bits, (np.cumsum(count) - count)[full], axis=0, dtype=np.int32)
    out[full] = np.packbits(2 * ones > count[full, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, passed: list[str] | None = None) -> DataFrame:
    """The ``passed`` columns (default ``doc_id``) and ``fp``, the fingerprint as a signed long."""
    return C.per_text(docs, lambda: lambda texts: [pa.array(_fingerprints(texts, shingle).view(np.int64))], "fp long", passed)


def _forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (x, smallest of x's group) that span all links inside a, or between a and b."""
    nodes = a if b is None else np.concatenate([a, b])
    shift = 0 if b is None else len(a)
    other = a if b is None else b
    near = np.bitwise_count(a[:, None] ^ other[None, :]) <= radius
    i, j = np.nonzero(near)
    j = j + shift
    if b is None:
        i, j = i[i < j], j[i < j]
    label = np.arange(len(nodes))
    while len(i):
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links ``(u, v)`` of distinct fingerprints ``fp`` that span every pair within ``radius`` bits."""
    words = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))).cast("long") + radius for k in range(4)]
    placed = fps.select("fp", sum((w * _SIDE**k for k, w in enumerate(words)), F.lit(0)).alias("cell"))
    cells = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(tile)).cast("long").alias("tiles")).checkpoint()
    placed = placed.join(F.broadcast(cells), "cell").withColumn("own", F.col("cell") * _TILES + F.pmod(F.xxhash64("fp"), F.col("tiles")))
    steps = [sum(d * _SIDE**k for k, d in enumerate(x)) for x in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, x)) <= radius]
    near = cells.select(F.col("cell").alias("near"), F.col("tiles").alias("near_tiles"))
    dealt = (placed.select("fp", "own", F.explode(F.array([F.col("cell") + F.lit(s) for s in steps])).alias("near"))
             .join(F.broadcast(near), "near")
             .select("fp", "own", F.explode(F.sequence(F.col("near") * _TILES, F.col("near") * _TILES + F.col("near_tiles") - 1)).alias("other"))
             .select(F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("right"), "fp"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _then_none(batches):
            now = None if batch is None else [np.asarray(batch.column(k)) if k != 2 else np.asarray(batch.column(k).cast(pa.int8())) for k in range(4)]
            rows = now if rest is None else rest if now is None else [np.concatenate(x) for x in zip(rest, now)]
            if rows is None or not len(rows[0]):
                continue
            lo, hi, right, fp = rows
            cut = np.flatnonzero((lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            cut = np.concatenate([[0], cut, [len(lo)]])
            done = len(cut) - (1 if batch is None else 2)  # the last group may go on in the next batch
            us, vs = [], []
            for s, e in zip(cut[:done], cut[1:done + 1]):
                x = fp[s:e].view(np.uint64)
                if lo[s] == hi[s]:
                    u, v = _forest(x, None, radius)
                else:
                    split = int(np.searchsorted(right[s:e], 1))
                    if split in (0, e - s):
                        continue
                    u, v = _forest(x[:split], x[split:], radius)
                if len(u):
                    us.append(u)
                    vs.append(v)
            if us:
                yield pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], ["u", "v"])
            rest = [x[cut[done]:] for x in rows]

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "lo", "hi").sortWithinPartitions("lo", "hi", "right").mapInArrow(compare, "u long, v long")


def _then_none(batches):
    yield from batches
    yield None


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (u, v)``; root is its component's smallest node."""
    def total(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct().checkpoint()
    before = None
    while (now := total(e)) != before:
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.union(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, passed: list[str] | None = None) -> DataFrame:
    """The ``passed`` columns, ``fingerprint`` (hex) and ``component_id``, one row per document.

    ``component_id`` is the smallest ``doc_id`` of the documents reachable over links of at most
    ``radius`` differing bits, the document itself included; null ids count as largest (a
    component of null ids has a null ``component_id``). Repeated rows stay. ``passed`` must
    hold ``doc_id`` and should be narrow: these columns are written to the checkpoint folder.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    passed = ["doc_id"] if passed is None else passed
    names = [f"c{i}" for i in range(len(passed))]
    marked = fingerprints(docs, shingle, passed).toDF(*names, "fp").checkpoint()
    own = marked.select(F.col(names[passed.index("doc_id")]).alias("doc_id"), "fp")
    fps = own.groupBy("fp").agg(F.min("doc_id").alias("first")).checkpoint()
    roots = components(links(fps.select("fp"), radius))
    joined = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    table = joined.join(lowest, "root").select(F.col("fp").alias("of"), "component_id")
    return marked.join(table, F.col("fp") == F.col("of")).select(
        *[F.col(x).alias(c) for x, c in zip(names, passed)], F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

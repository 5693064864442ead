"""Hard negatives of anchors, searched in an STR-packed R-tree over whole-number vectors.

A component ``x`` becomes ``floor(scale * x)``; a row's score is its inner product with the
anchor. An anchor's positives are its best ``positives`` other rows of the same label; for each
of them the best ``negatives`` rows of other labels are wanted whose score lies between ``low``
and ``high`` per cent of the positive's. Higher scores come first, ties by smaller id.

* Index. Rows are packed by sort-tile-recursive: slabs of equal counts in the order of label and
  the widest coordinate, in each slab leaves of ``LEAF`` rows in the order of the second widest.
  Both orders are distributed row numbers (ids break ties, so copies of one vector are split
  too). The written index has a row for each leaf: its rows packed as bytes, its box (least and
  largest value of each coordinate) and its least and largest label.
* Search. A task gathers ``TREE`` leaves at a time, in packed order, and puts boxes of ``FANOUT``
  leaves above them. Boxes give an interval of inner products, coordinate by coordinate. Each
  anchor keeps a queue of boxes by falling upper end; a box is left out if its labels can't
  matter, if it lies outside all score windows, or if its upper end is strictly below the k-th
  score so far, which the anchor carries from tree to tree. Each task returns its best k for
  each list; Spark merges them.
* Anchors are a part of all rows, so they come in blocks of ``ANCHORS``, which are all that the
  driver and a broadcast hold; each block writes its result to the shared folder.

Boxes prune only where the data has shape; of vectors without any, every leaf is looked at, and
the work is then that of the stated search, anchors times rows.

Defined results: rows with a null id, a null label, a null vector, an unusual length (see
:mod:`frauddeck.llm.vectors`) or a null or non-finite component take no part. Repeated rows are
rows: they can be each other's positives, and a repeated anchor has its lists as often as it is
there. Scores of enormous components are exact; one beyond a long is null. An empty table, and
one without anchors, give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frauddeck.llm import common as C
from frauddeck.llm import vectors as V
from frauddeck.operators.globalrank import row_number_within

LEAF, FANOUT, TREE, ANCHORS = 256, 16, 256, 4096

INDEX = "leaf long, ids binary, labels binary, x binary, low binary, high binary"


class Index:
    """A written index: its leaves, the vectors' length and the numbers' width."""

    def __init__(self, leaves: DataFrame, length: int, kind: str, exact: bool):
        self.leaves, self.length, self.kind, self.exact = leaves, length, kind, exact


def _rows(rows: DataFrame, id_col: str, vector: str, label: str, length: int, scale: float) -> DataFrame:
    """``(id, label, x)`` of the rows that take part; x as packed 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, values = V.finite(batch.column(2), length)
            keep = pa.array(mask)
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep), V.packed(V.floored(values, scale))], ["id", "label", "x"])

    chosen = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").alias("of"))
    return chosen.where("id is not null and label is not null and of is not null").mapInArrow(run, "id long, label long, x binary")


def _spread(rows: DataFrame, length: int) -> tuple[int, int, list[int]]:
    """The number of rows, the largest absolute number, and the coordinates from wide to narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, top, s, q = 0, 0, np.zeros(length), np.zeros(length)
        for batch in batches:
            x = V.unpacked(batch.column(0), length)
            if len(x):
                n, top = n + len(x), max(top, int(np.abs(x).max()))
                s, q = s + x.sum(axis=0, dtype=float), q + (x.astype(float) ** 2).sum(axis=0)
        yield pa.record_batch([pa.array(np.arange(length)), pa.array(np.full(length, n)), pa.array(np.full(length, top)), pa.array(s), pa.array(q)], ["d", "n", "top", "s", "q"])

    parts = rows.select("x").mapInArrow(run, "d long, n long, top long, s double, q double")
    found = parts.groupBy("d").agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    if not found or not found[0]["n"]:
        return 0, 0, []
    wide = sorted(found, key=lambda r: (-(r["q"] / r["n"] - (r["s"] / r["n"]) ** 2), r["d"]))
    return found[0]["n"], found[0]["top"], [r["d"] for r in wide]


def build(rows: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0, leaf: int = LEAF) -> Index | None:
    """The index of all rows that take part; None without any."""
    length = V.usual_length(rows, vector)
    if not length:
        return None
    used = _rows(rows, id_col, vector, label, length, scale)
    n, top, wide = _spread(used, length)
    if not n:
        return None
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    width, first, second = np.dtype(kind).itemsize, wide[0], wide[min(1, len(wide) - 1)]

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = V.unpacked(batch.column(2), length)
            yield pa.record_batch([batch.column(0), batch.column(1), V.packed(x.astype(kind)), pa.array(x[:, first]), pa.array(x[:, second])], ["id", "label", "x", "a", "b"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pages(table: pa.Table) -> Iterator[pa.RecordBatch]:
            at = table.column("leaf").to_numpy()
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            whole = table.combine_chunks()
            for s, e in zip(cuts[:-1], cuts[1:]):
                part = whole.slice(s, e - s)
                x = V.unpacked(part.column("x").combine_chunks(), length, kind)
                labels = part.column("label").to_numpy().astype("<i8")
                yield pa.record_batch([pa.array([int(at[s])]), *[pa.array([v.tobytes()], pa.binary()) for v in (
                    part.column("id").to_numpy().astype("<i8"), labels, x, x.min(axis=0), x.max(axis=0))]], [f.split()[0] for f in INDEX.split(", ")])

        for batch in batches:
            held.append(batch)
            rest = pa.Table.from_batches(held)
            at = rest.column("leaf").to_numpy()
            begun = int(np.searchsorted(at, at[-1]))  # the last leaf may go on in the next batch
            if begun:
                yield from pages(rest.slice(0, begun))
                held = rest.slice(begun).combine_chunks().to_batches()
        if held:
            yield from pages(pa.Table.from_batches(held))

    count = -(-n // leaf)
    slab = -(-count // max(1, round(count ** 0.5))) * leaf  # rows of a slab: whole leaves
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = used.mapInArrow(narrow, "id long, label long, x binary, a long, b long")
    ordered = row_number_within(ordered, [], [F.col("label"), F.col("a"), F.col("id")])
    ordered = ordered.withColumn("slab", F.floor((F.col("_rn") - 1) / slab)).drop("_rn")
    ordered = row_number_within(ordered, [], [F.col("slab"), F.col("b"), F.col("id")])
    ordered = ordered.select("id", "label", "x", F.floor((F.col("_rn") - 1) / leaf).alias("leaf"))
    packed = ordered.repartitionByRange(parts, "leaf").sortWithinPartitions("leaf", "id").mapInArrow(leaves, INDEX)
    return Index(C.written(packed), length, kind, top * top * length < 1 << 53)


class Tree:
    """``TREE`` leaves at most, with the boxes above them. Numbers are doubles (or, if those weren't
    exact, Python integers)."""

    def __init__(self, rows: list[tuple], length: int, kind: str, exact: bool):
        number = np.float64 if exact else object
        self.leaf = [r[0] for r in rows]
        self.ids = [np.frombuffer(r[1], "<i8") for r in rows]
        self.labels = [np.frombuffer(r[2], "<i8") for r in rows]
        self.x = [np.frombuffer(r[3], kind).reshape(-1, length).astype(number) for r in rows]
        low = np.array([np.frombuffer(r[4], kind) for r in rows]).astype(number)
        high = np.array([np.frombuffer(r[5], kind) for r in rows]).astype(number)
        first, last = np.array([v.min() for v in self.labels]), np.array([v.max() for v in self.labels])
        n, m = len(rows), -(-len(rows) // FANOUT)
        cuts = np.arange(m) * FANOUT
        # the leaves, then the boxes above them
        self.low = np.concatenate([low, np.minimum.reduceat(low, cuts)])
        self.high = np.concatenate([high, np.maximum.reduceat(high, cuts)])
        self.first = np.concatenate([first, np.minimum.reduceat(first, cuts)])
        self.last = np.concatenate([last, np.maximum.reduceat(last, cuts)])
        self.n, self.tops = n, range(n, n + m)

    def below(self, box: int) -> range:
        a = (box - self.n) * FANOUT
        return range(a, min(a + FANOUT, self.n))

    def intervals(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product with each box, for each row of q."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T


class Best:
    """The k best (score, id, place), higher scores first, ties by smaller id."""
    __slots__ = ("k", "rows")

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def least(self):
        """What a score must reach; None while there is room."""
        return self.rows[-1][0] if len(self.rows) == self.k else None

    def add(self, scores: np.ndarray, ids: np.ndarray, places: list) -> None:
        if len(scores) > self.k:  # those at or above the k-th of them
            at = np.flatnonzero(scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k])
            scores, ids, places = scores[at], ids[at], [places[i] for i in at.tolist()]
        self.rows += zip(map(int, scores), ids.tolist(), places)
        self.rows.sort(key=lambda r: (-r[0], r[1]))
        del self.rows[self.k:]


def _visit(tree: Tree, least: np.ndarray, most: np.ndarray, wanted, look) -> None:
    """Looks at the leaves by falling upper end. ``wanted(box, least, most)``: whether a box can still matter."""
    queue = [(-most[b], b) for b in tree.tops if wanted(b, least[b], most[b])]
    heapq.heapify(queue)
    while queue:
        _, box = heapq.heappop(queue)
        if not wanted(box, least[box], most[box]):
            continue
        if box < tree.n:
            look(box)
        else:
            for b in tree.below(box):
                if wanted(b, least[b], most[b]):
                    heapq.heappush(queue, (-most[b], b))


def _positives(tree: Tree, q: np.ndarray, least, most, label: int, own: tuple[int, int], best: Best) -> None:
    def wanted(b, low, high):
        kth = best.least()
        return tree.first[b] <= label <= tree.last[b] and (kth is None or high >= kth)

    def look(b):
        scores = tree.x[b] @ q
        keep, kth = tree.labels[b] == label, best.least()
        if kth is not None:
            keep &= scores >= kth
        if tree.leaf[b] == own[0]:
            keep[own[1]] = False
        at = np.flatnonzero(keep)
        if len(at):
            best.add(scores[at], tree.ids[b][at], at.tolist())

    _visit(tree, least, most, wanted, look)


def _negatives(tree: Tree, q: np.ndarray, least, most, label: int, windows: list[tuple[int, int]], bests: list[Best]) -> None:
    def wanted(b, low, high):
        if tree.first[b] == label == tree.last[b]:
            return False
        for (a, z), best in zip(windows, bests):
            if high >= a and low <= z and ((kth := best.least()) is None or high >= kth):
                return True
        return False

    def look(b):
        scores, other = tree.x[b] @ q, tree.labels[b] != label
        floors = [a if (kth := best.least()) is None else max(a, kth) for (a, _), best in zip(windows, bests)]
        near = other & (scores >= min(floors))
        if not near.any():
            return
        for (_, z), floor, best in zip(windows, floors, bests):
            at = np.flatnonzero(near & (scores >= floor) & (scores <= z))
            if len(at):
                best.add(scores[at], tree.ids[b][at], at.tolist())

    _visit(tree, least, most, wanted, look)


def _trees(batches: Iterator[pa.RecordBatch], index: tuple[int, str, bool]) -> Iterator[Tree]:
    held: list[tuple] = []
    for batch in batches:
        for i in range(batch.num_rows):
            held.append(tuple(batch.column(c)[i].as_py() for c in range(6)))
            if len(held) == TREE:
                yield Tree(held, *index)
                held = []
    if held:
        yield Tree(held, *index)


def _long(v: int) -> int | None:
    return v if -(1 << 63) <= v < 1 << 63 else None


def _search(index: Index, spark: SparkSession, block: list[tuple], per_list: int, lists: str) -> DataFrame:
    """``(anchor, list, score, id)``: the best of each task. ``block``: an anchor's (vector, label, own
    place, windows); without windows its list 0 holds positives."""
    sent = spark.sparkContext.broadcast(block)
    about = (index.length, index.kind, index.exact)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = sent.value
        number = np.float64 if about[2] else object
        q = np.array([a[0] for a in anchors]).reshape(len(anchors), about[0]).astype(number)
        found = [[Best(per_list) for _ in (range(1) if lists == "positives" else a[3])] for a in anchors]
        for tree in _trees(batches, about):
            least, most = tree.intervals(q)
            for i, (_, label, own, windows) in enumerate(anchors):
                if lists == "positives":
                    _positives(tree, q[i], least[i], most[i], label, own, found[i][0])
                elif windows:
                    _negatives(tree, q[i], least[i], most[i], label, windows, found[i])
        out = [(i, j, str(r[0]), r[1]) for i, bests in enumerate(found) for j, best in enumerate(bests) for r in best.rows]
        columns = list(zip(*out)) if out else [()] * 4
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64()))], ["anchor", "list", "score", "id"])

    # a score may be larger than a long: 38 digits hold those of 62-bit numbers
    return index.leaves.mapInArrow(run, "anchor int, list int, score string, id long").withColumn("score", F.col("score").cast("decimal(38,0)"))


def _top(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "list").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(index: Index | None, spark: SparkSession, is_anchor: Column, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         anchors: int = ANCHORS) -> DataFrame:
    """A row for each anchor, positive and negative. ``is_anchor`` is a condition over ``id``."""
    if index is None:
        return spark.createDataFrame([], RESULT)
    length, kind = index.length, index.kind

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                leaf, ids, labels, x = (batch.column(c)[i].as_py() for c in range(4))
                n = len(ids) // 8
                yield pa.record_batch([pa.array([leaf] * n, pa.int64()), pa.array(np.arange(n)), pa.array(np.frombuffer(ids, "<i8")), pa.array(np.frombuffer(labels, "<i8")),
                                       V.packed(np.frombuffer(x, kind).reshape(n, length))], ["leaf", "place", "id", "label", "x"])

    chosen = index.leaves.mapInArrow(rows, "leaf long, place long, id long, label long, x binary").where(is_anchor)
    numbered = C.written(row_number_within(chosen, [], [F.col("leaf"), F.col("place")]).withColumn("block", F.floor((F.col("_rn") - 1) / anchors)))
    blocks = numbered.agg(F.max("block")).first()[0]
    results = []
    for b in range(0 if blocks is None else blocks + 1):
        block = numbered.where(F.col("block") == b).orderBy("_rn").collect()  # at most `anchors` rows
        about = [(np.frombuffer(bytes(r["x"]), kind), r["label"], (r["leaf"], r["place"]), []) for r in block]
        best = _top(_search(index, spark, about, positives, "positives"), positives).collect()
        found: dict[int, list] = {}
        for r in sorted(best, key=lambda r: (r["anchor"], r["rank"])):
            found.setdefault(r["anchor"], []).append((r["id"], int(r["score"])))
        windows = [[(-(-low * s // 100), high * s // 100) for _, s in found.get(i, [])] for i in range(len(block))]
        near = _top(_search(index, spark, [(*a[:3], w) for a, w in zip(about, windows)], negatives, "negatives"), negatives)
        pairs = [(i, j, block[i]["id"], p, _long(s)) for i, ps in found.items() for j, (p, s) in enumerate(ps)]
        told = spark.createDataFrame(pairs, "anchor int, list int, anchor_id long, positive_id long, positive_score long")
        # the table of a block's positives has at most anchors x positives rows
        result = near.join(F.broadcast(told), ["anchor", "list"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                                                                         F.expr("try_cast(score as long)").alias("negative_score"))
        results.append(C.written(result))
    return reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], T.StructType.fromDDL(RESULT))

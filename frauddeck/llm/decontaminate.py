"""Benchmark decontamination: prefix-filtered set join of documents with benchmark windows.

A window is ten consecutive words of an item (an item of one to nine words is one window).
Its tokens are its three-word shingles. Containment must be exact, so a window of n shingles
needs n - n + 1 = 1 prefix token: the shingle that is rarest over all documents, counted in a
first pass over them. A second pass joins the documents' shingles with those prefix tokens;
each meeting gives the one place where the window could begin, which must leave the whole
window inside the document (positional and length bound) and is then verified word by word.

Windows are written once and come in blocks of about ``block_windows`` rows; the driver and each task
hold one block (its size is that bound). One block, the usual case, runs past the documents
where they are. With more, the documents get a number each and are written once; every block
is a job of its own that writes the hits it found, a row for each document that has some, and
these meet the documents at the end. So no task holds two blocks, whatever the benchmark's size.

Defined results: null or word-free texts have ``n_words`` 0 and are clean; items without a
word and items with a null id are ignored; repeated item rows count once per item id;
repeated documents each get their own row; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frauddeck.llm import common as C

WINDOW, SHINGLE, BLOCK_WINDOWS = 10, 3, 200_000

#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing A-Z.
WORD = C.byte_table([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _words(texts: pa.Array):
    raw, off = C.utf8(texts)
    data = C.LOWER[raw]
    return data, *C.runs(WORD[data], off)


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct ``(window, item)``: the window's words joined by spaces, the item id as text."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in C.slices(batch.column(1)):
                data, starts, ends, row = _words(batch.column(1)[a:b])
                ids, out, names = batch.column(0)[a:b].to_pylist(), [], []
                word = [bytes(data[s:e]) for s, e in zip(starts, ends)]
                for r in np.unique(row):
                    lo, hi = np.searchsorted(row, [r, r + 1])
                    for i in range(lo, max(lo + 1, hi - window + 1)):
                        out.append(b" ".join(word[i:min(i + window, hi)]))
                        names.append(ids[r])
                yield pa.record_batch([pa.array(out, pa.binary()), pa.array(names, pa.string())], ["window", "item"])

    rows = (benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
            .where("item is not null and text is not null"))
    return rows.mapInArrow(cut, "window binary, item string").distinct()


class Block:
    """Windows of one block, with their shingles and (once counted) their prefix tokens."""

    def __init__(self, rows: list[tuple[bytes, str]]):
        texts = sorted({w for w, _ in rows})
        number = {w: i for i, w in enumerate(texts)}
        self.texts = texts
        self.items: list[list[str]] = [[] for _ in texts]
        for w, item in sorted(rows):
            self.items[number[w]].append(item)
        _, starts, ends, row = _words(pa.array([w.decode() for w in texts], pa.large_string()))
        data = np.frombuffer(b"".join(texts), np.uint8)
        word = C.run_hashes(data, starts, ends)
        self.length = np.bincount(row, minlength=len(texts))
        self.whole = np.zeros(len(texts), np.uint64)
        for n in np.unique(self.length):
            h, same = C.combine(word, int(n)), C.within(row, int(n))
            first = np.searchsorted(row, np.flatnonzero(self.length == n))
            self.whole[self.length == n] = h[first]
            assert same[first].all()
        parts = []  # shingle length, hash, window, position
        for k in range(1, SHINGLE + 1):
            h, same = C.combine(word, k), C.within(row, k)
            at = np.flatnonzero(same)
            at = at[np.minimum(self.length[row[at]], SHINGLE) == k]
            parts.append((np.full(len(at), k), h[at], row[at], at - np.searchsorted(row, row[at])))
        self.k, self.hash, self.window, self.place = (np.concatenate(x) for x in zip(*parts))

    def tables(self) -> dict[int, np.ndarray]:
        """Sorted shingle hashes by shingle length."""
        return {int(k): np.unique(self.hash[self.k == k]) for k in np.unique(self.k)}

    def prefixes(self, counts: dict[tuple[int, int], int]) -> None:
        """Keeps each window's rarest shingle; windows with a shingle that occurs nowhere go."""
        n = np.array([counts.get((int(k), int(h)), 0) for k, h in zip(self.k, self.hash.view(np.int64))], np.int64)
        order = np.lexsort((self.place, self.hash, n, self.window))
        order = order[np.concatenate([[True], self.window[order][1:] != self.window[order][:-1]])] if len(order) else order
        order = order[n[order] > 0]
        order = order[np.lexsort((self.hash[order], self.k[order]))]
        self.k, self.hash, self.window, self.place = (x[order] for x in (self.k, self.hash, self.window, self.place))


class _Probe:
    """Membership of many hashes in a small sorted table, most of them told by one bit table."""

    def __init__(self, table: np.ndarray):
        self.table, self.bits = table, np.zeros(1 << 20, bool)
        self.bits[(table & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def found(self, hashes: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.bits[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
        if not len(at) or not len(self.table):
            return at[:0]
        p = np.minimum(np.searchsorted(self.table, hashes[at]), len(self.table) - 1)
        return at[self.table[p] == hashes[at]]


def shingle_counts(docs: DataFrame, tables) -> DataFrame:
    """How often each shingle of ``tables`` (a broadcast) occurs in all documents: k, hash, n."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = {k: _Probe(t) for k, t in tables.value.items()}
        totals = {k: np.zeros(len(t), np.int64) for k, t in tables.value.items()}
        for batch in batches:
            for a, b in C.slices(batch.column(0)):
                data, starts, ends, row = _words(batch.column(0)[a:b])
                word = C.run_hashes(data, starts, ends)
                for k, probe in probes.items():
                    h = C.combine(word, k)[C.within(row, k)]
                    np.add.at(totals[k], np.searchsorted(probe.table, h[probe.found(h)]), 1)
        for k, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.full(len(at), k, np.int32)), pa.array(probes[k].table[at].view(np.int64)), pa.array(n[at])], ["k", "hash", "n"])

    return docs.select("text").mapInArrow(count, "k int, hash long, n long").groupBy("k", "hash").agg(F.sum("n").alias("n"))


def _search(block: Block, batches: Iterator[pa.RecordBatch], last: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Adds this block's hits to the columns ``ranges`` (start, end, start, end, ...) and ``items``."""
    by_k = {int(k): np.flatnonzero(block.k == k) for k in np.unique(block.k)}
    probes = {k: _Probe(np.unique(block.hash[at])) for k, at in by_k.items()}
    for batch in batches:
        t, q = batch.num_columns - 3, batch.num_columns - 2
        for a, b in C.slices(batch.column(t)):
            part = batch.slice(a, b - a)
            data, starts, ends, row = _words(part.column(t))
            first = np.searchsorted(row, np.arange(len(part) + 1))
            hits: list[tuple[int, int, int]] = []
            if probes:
                word = C.run_hashes(data, starts, ends)
                whole: dict[int, np.ndarray] = {}
                for k, probe in probes.items():
                    h = C.combine(word, k)
                    at = probe.found(h)
                    lo = np.searchsorted(block.hash[by_k[k]], h[at], "left")
                    times = np.searchsorted(block.hash[by_k[k]], h[at], "right") - lo
                    for x in range(int(times.max(initial=0))):  # windows that share a prefix token
                        some = times > x
                        w = block.window[by_k[k]][lo[some] + x]
                        s = at[some] - block.place[by_k[k]][lo[some] + x]
                        n = block.length[w]
                        r = row[at[some]]
                        fits = (s >= first[r]) & (s + n <= first[r + 1])
                        for s1, w1, n1, r1 in zip(s[fits], w[fits], n[fits], r[fits]):
                            n1 = int(n1)
                            if n1 not in whole:
                                whole[n1] = C.combine(word, n1)
                            if whole[n1][s1] == block.whole[w1] and b" ".join(bytes(data[i:j]) for i, j in zip(starts[s1:s1 + n1], ends[s1:s1 + n1])) == block.texts[w1]:
                                hits.append((int(r1), int(s1 - first[r1]), int(w1)))
            yield _result(block, part, hits, first, last, names, q)


def _result(block, part, hits, first, last, names, q) -> pa.RecordBatch:
    ranges = [list(x or ()) for x in part.column(q).to_pylist()]
    items = [set(x or ()) for x in part.column(q + 1).to_pylist()]
    for r, s, w in hits:
        ranges[r] += [s, s + int(block.length[w])]
        items[r].update(block.items[w])
    n_words = np.diff(first)
    joined = []
    for x in ranges:
        out: list[int] = []
        for s, e in sorted(zip(x[::2], x[1::2])):
            if out and s <= out[-1]:
                out[-1] = max(out[-1], e)
            else:
                out += [s, e]
        joined.append(out)
    if not last:
        return pa.record_batch([*part.columns[:q], pa.array(joined, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names)
    n_hit = np.array([sum(x[1::2]) - sum(x[::2]) for x in joined], np.int64)
    told = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
    return pa.record_batch([*part.columns[:q - 1], pa.array(n_words.astype(np.int64)), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(told, pa.string()), pa.array(n_hit > 0)], names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, passed: list[str] | None = None) -> DataFrame:
    """One row per document: the ``passed`` columns (default ``doc_id``) and ``RESULT``.

    ``window`` is the number of words of a window, ``block_windows`` the expected number of
    windows broadcast at a time. Other columns of either table are not read.
    """
    passed = ["doc_id"] if passed is None else passed
    kinds = {f.name: f for f in docs.schema.fields}
    names = [f"c{i}" for i in range(len(passed))]  # input columns may have any name
    head = T.StructType([T.StructField(x, kinds[c].dataType) for x, c in zip(names, passed)])
    final = T.StructType(head.fields + T.StructType.fromDDL(RESULT).fields)
    none = [F.lit(None).cast("array<long>").alias("ranges"), F.lit(None).cast("array<string>").alias("items")]
    rows = docs.select(*[F.col(f"`{c}`").alias(x) for x, c in zip(names, passed)], F.col("text").cast("string").alias("text"))
    wins = C.written(windows(benchmark, window))
    blocks = max(1, -(-wins.count() // block_windows))
    if blocks == 1:
        out = _searched(rows.select("*", *none), _counted(wins, docs), True, final)
    else:
        # several blocks: one job for each, so that no task holds two; hits are kept by row
        rows = C.written(rows.withColumn("row", F.monotonically_increasing_id()))
        numbered = wins.withColumn("block", F.pmod(F.xxhash64("window", "item"), F.lit(blocks)))
        carried = T.StructType.fromDDL("row long, text string, ranges array<long>, items array<string>")
        found = []
        for i in range(blocks):
            block = _counted(numbered.where(F.col("block") == i).drop("block"), rows)
            found.append(C.written(_searched(rows.select("row", "text", *none), block, False, carried).where("size(ranges) > 0").drop("text")))
        hits = reduce(DataFrame.unionByName, found).groupBy("row").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.flatten(F.collect_list("items")).alias("items"))
        whole = rows.join(hits, "row", "left").select(*names, "text", "ranges", "items")
        out = _searched(whole, Block([]), True, final)
    return out.select(*[F.col(x).alias(c) for x, c in zip(names, passed)], *final.names[len(names):])


def _counted(wins: DataFrame, docs: DataFrame) -> Block:
    """The windows of one block, which is what the driver holds, with their prefix tokens."""
    block = Block([(bytes(r[0]), r[1]) for r in wins.select("window", "item").collect()])
    if block.texts:
        tables = docs.sparkSession.sparkContext.broadcast(block.tables())
        counts = shingle_counts(docs, tables).collect()  # at most the block's shingles
        tables.destroy()
        block.prefixes({(r["k"], r["hash"]): r["n"] for r in counts})
    return block


def _searched(rows: DataFrame, block: Block, last: bool, schema: T.StructType) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _search(sent.value, batches, last, schema.names)

    return rows.mapInArrow(search, schema)

"""Suffix-array dedup: removes bytes covered by a long string that also starts earlier.

A position is removed if it lies in a string of ``MATCH`` bytes that also starts at an earlier
place (smaller document, or same document and earlier start). Equal strings are found by
external suffix sorting (:mod:`frauddeck.llm.induced_sort`); what comes before only gathers the
places that have to be sorted together, and collapses copies:

1. Every ``MATCH``-byte window has an anchor: its ``GRAM``-byte string with the least hash. Equal
   windows have equal anchors at equal places in them. Neighbouring windows with one anchor
   form a run (its windows, and the bytes they span).
2. Runs with the same anchor string and the same bytes are copies: all but the earliest are
   removed. A task first collapses its own copies, so that a passage which a third of all
   documents share meets as one row a task; the rest meet by their anchor string.
3. Where an anchor string has runs of different bytes, the earliest of each kind may still share
   windows. Their texts are cut in two by the anchor's place, so that all windows of a part
   share about 70 bytes, and dealt by those bytes to shards.
   A hot anchor (over ``HOT_KINDS`` kinds, as at the end of a passage that a large share of the
   documents has) would bring one shard all of them. Its windows are told one by one, by a
   128-bit hash of their bytes; like runs, they are first collapsed by the task.
4. A shard writes its texts to a memory-mapped scratch file, in order of document and start, and
   sorts its suffixes externally: of all suffixes with a common prefix of ``MATCH`` bytes, all
   but the first in that order are removed.
5. Removed windows are gathered by document (no more of them than it has bytes) and joined with
   the texts; the bytes they cover go.

Defined results: a null or empty text has no bytes; texts under ``MATCH`` bytes lose nothing by
themselves. Rows that repeat an id and its text are one document, each with the same result; other
rows that repeat an id, and null ids (which come last), are ordered by a hash of their text.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frauddeck.llm import common as C
from frauddeck.llm import induced_sort as I

MATCH, GRAM, COLLAPSE_RUNS, MEMORY = 100, 32, 1 << 20, 1 << 21
HOT_KINDS, HOT_ANCHORS = 1 << 14, 1_000_000  # an anchor of more kinds is hot; at most so many (by raising the bound)
RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
# a run in one long: first window's start, the anchor's place after it, windows less one
_START, _ANCHOR = 14, 7


def _runs(data: np.ndarray, off: np.ndarray, match: int, gram: int):
    """Runs of the windows of some texts: text, first window's start in the text, anchor's place
    after it, windows, anchor's hash, hash of the bytes they span."""
    n, span = len(data), match - gram + 1
    none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    if n < match:
        return none
    up, down = C._powers()
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = C.mix((total[gram:] - total[:-gram]) * down[:n - gram + 1])
    place = np.uint64((1 << 21) - 1)
    low = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= span:  # least of `width` neighbours, doubled
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[:n - match + 1], low[span - width:span - width + n - match + 1])
    anchor = (low & place).astype(np.int64)  # of the window at each start
    row = np.repeat(np.arange(len(off) - 1), np.maximum(np.diff(off) - match + 1, 0))
    start = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(np.diff(off) - match + 1, 0)) - np.maximum(np.diff(off) - match + 1, 0), np.maximum(np.diff(off) - match + 1, 0))
    at = start + off[row]
    anchor = anchor[at]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(row)))
    s, m = at[first], anchor[first]
    whole = C.mix((total[s + count + match - 1] - total[s]) * down[s] + count.astype(np.uint64))
    return row[first], start[first], m - s, count, h[m], whole


def _pieces(batches: Iterator[pa.RecordBatch], match: int, block: int = C.SLICE_BYTES):
    """Texts of some bytes at most: document numbers, bytes, offsets, each text's place in its document."""
    for batch in batches:
        for a, b in C.slices(batch.column(1), block):
            number = np.asarray(batch.column(0)[a:b])
            data, off = C.utf8(batch.column(1)[a:b])
            if len(data) <= block:
                yield number, data, off, np.zeros(b - a, np.int64)
                continue
            for s in range(0, max(len(data) - match + 1, 1), block - match + 1):  # one long text, by blocks of windows: none is in two
                part = data[s:s + block]
                yield number, part, np.array([0, len(part)]), np.array([s])


def _occurrences(batches: Iterator[pa.RecordBatch], match: int, gram: int, block: int) -> Iterator[pa.RecordBatch]:
    """Runs: the earliest of each kind in a task's stretch of documents (``lead``), and all others,
    keyed by their place. Both come of one pass, as another one might cut the rows into other stretches."""
    held, n = [], 0

    def flush():
        d, at, h, whole = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((at, d, C.mix(h) ^ whole))
        d, at, h, whole = d[order], at[order], h[order], whole[order]
        new = np.ones(len(d), bool)
        new[1:] = (h[1:] != h[:-1]) | (whole[1:] != whole[:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))
        keep = new | (d != d[lead]) | (at != at[lead])  # a repeated row is not earlier than itself
        d, at, new = d[keep], at[keep], new[keep]
        h = np.where(new, h[keep], C.mix(d.astype(np.uint64) ^ at.astype(np.uint64))).view(np.int64)
        return pa.record_batch([pa.array(h), pa.array(np.where(new, whole[keep].view(np.int64), 0)), pa.array(d), pa.array(at), pa.array(new)], ["h", "whole", "d", "at", "lead"])

    for number, data, off, base in _pieces(batches, match, block):
        row, start, anchor, count, h, whole = _runs(data, off, match, gram)
        if len(row):
            held.append((number[row], (start + base[row]) << _START | anchor << _ANCHOR | (count - 1), h, whole))
            n += len(row)
        if n >= COLLAPSE_RUNS:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def _kinds(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of runs sorted by lead, anchor, bytes, document: the copies (``sort`` false), and the earliest
    of each kind where an anchor has several kinds (``sort`` true). An anchor with over ``most`` kinds
    also gives rows with its hash in ``hot``, and in ``at`` that number and its doubles as far as it has more."""
    kinds = 0  # of the anchor that the last batch ended in
    head = None  # h, whole, d, at of the earliest run of the kind that the last batch ended in
    waits = False  # whether that run is its anchor's only kind so far
    for batch in batches:
        lead = batch.column(4).to_numpy(zero_copy_only=False)
        if not lead.all():
            rest = batch.filter(pa.array(~lead))
            yield pa.record_batch([rest.column(2), rest.column(3), pa.array(np.zeros(len(rest), bool)), pa.nulls(len(rest), pa.int64())], ["d", "at", "sort", "hot"])
        h, whole, d, at = (np.asarray(batch.column(k))[lead] for k in range(4))
        if not len(h):
            continue
        new_h, new = np.ones(len(h), bool), np.ones(len(h), bool)
        new_h[1:] = h[1:] != h[:-1]
        new[1:] = new_h[1:] | (whole[1:] != whole[:-1])
        if head is not None:
            new_h[0] = h[0] != head[0]
            new[0] = new_h[0] or whole[0] != head[1]
        lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        first_d = np.where(lead >= 0, d[lead], head[2] if head else 0)
        first_at = np.where(lead >= 0, at[lead], head[3] if head else 0)
        copies = ~new & ((d != first_d) | (at != first_at))
        k = np.flatnonzero(new)
        out_d, out_at = [d[copies]], [at[copies]]
        more_d, more_at, hot, level = [], [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(k):
            begins = np.maximum.accumulate(np.where(new_h[k], np.arange(len(k)), -1))
            nth = np.where(begins >= 0, np.arange(len(k)) - begins, kinds + np.arange(len(k))) + 1
            times = (nth - 1) // most
            reached = (times > 0) & ((nth - 1) % most == 0) & (times & (times - 1) == 0)
            hot, level, kinds = h[k[reached]], nth[reached] - 1, int(nth[-1])
            alone = new_h[k]  # begins its anchor's rows
            follows = np.append(~alone[1:], False)  # another kind of the same anchor comes in this batch
            chosen = ~alone | follows
            more_d, more_at = [d[k][chosen]], [at[k][chosen]]
            if waits and not alone[0]:
                more_d.append(np.array([head[2]]))
                more_at.append(np.array([head[3]]))
            head, waits = (h[k[-1]], whole[k[-1]], d[k[-1]], at[k[-1]]), bool(alone[-1])
        n, m = len(out_d[0]), sum(map(len, more_d))
        sort, marks = np.arange(n + m + len(hot)) >= n, np.arange(n + m + len(hot)) >= n + m
        yield pa.record_batch([pa.array(np.concatenate([*out_d, *more_d, hot]), mask=marks), pa.array(np.concatenate([*out_at, *more_at, level])),
                               pa.array(sort, mask=marks), pa.array(np.concatenate([np.zeros(n + m, np.int64), hot]), mask=~marks)], ["d", "at", "sort", "hot"])


def _anchors(grams: list[bytes], gram: int) -> np.ndarray:
    """The hashes that ``_runs`` gives these anchors."""
    data = np.frombuffer(b"".join(grams), np.uint8).reshape(-1, gram).astype(np.uint64) + np.uint64(1)
    return C.mix((data * C._powers()[0][:gram]).sum(axis=1, dtype=np.uint64)).view(np.int64)


def _one_by_one(digests: list[bytes], d: list[int], start: list[int]):
    """Rows for windows of hot anchors: the first of each kind here (``n`` 0, the hash in ``key`` and
    ``part``), and stretches of all others, which are removed (``n`` less than 0)."""
    h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    d, start = np.array(d, np.int64), np.array(start, np.int64)
    order = np.lexsort((start, d, h[:, 1], h[:, 0]))
    h, d, start = h[order], d[order], start[order]
    new = np.ones(len(d), bool)
    new[1:] = (h[1:] != h[:-1]).any(axis=1)
    lead = np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))
    gone = np.flatnonzero((d != d[lead]) | (start != start[lead]))  # a repeated row is not earlier than itself
    rows = [(int(x), int(y), int(z), 0, w.tobytes()) for x, w, y, z in zip(h[new, 0], h[new, 1], d[new], start[new])]
    if len(gone):
        gone = gone[np.lexsort((start[gone], d[gone]))]
        d, start = d[gone], start[gone]
        first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (start[1:] != start[:-1] + 1)]))
        count = np.diff(np.append(first, len(d)))
        spread = C.mix((d[first].astype(np.uint64) << np.uint64(20)) + start[first].astype(np.uint64)).view(np.int64)
        rows += [(x, y, z, -n, b"") for x, y, z, n in zip(spread.tolist(), d[first].tolist(), start[first].tolist(), count.tolist())]
    return rows


def _parts(batches: Iterator[pa.RecordBatch], match: int, gram: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The runs' texts, cut by the anchor's place and keyed by what all windows of a part share;
    rows of ``_one_by_one`` for runs with a ``hot`` anchor (hashes, ascending)."""
    half = (match - gram) // 2
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    table = lambda out: pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, kinds)], ["key", "d", "start", "n", "part"])
    windows = ([], [], [])  # of hot anchors: hash, document, start
    for batch in batches:
        out = []
        for d, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            raw = text.as_py().encode()
            runs = sorted(set(runs))
            places = [(run >> _START, run >> _ANCHOR & (1 << _START - _ANCHOR) - 1, (run & (1 << _ANCHOR) - 1) + 1) for run in runs]
            met = np.isin(_anchors([raw[s + m:s + m + gram] for s, m, _ in places], gram), hot) if len(hot) else np.zeros(len(places), bool)
            for (s, m, n), many in zip(places, met.tolist()):
                if many:
                    windows[0].extend(hashlib.blake2b(raw[x:x + match], digest_size=16).digest() for x in range(s, s + n))
                    windows[1].extend([d] * n)
                    windows[2].extend(range(s, s + n))
                    if len(windows[0]) >= COLLAPSE_RUNS // 4:
                        yield table(_one_by_one(*windows))
                        windows = ([], [], [])
                    continue
                near = max(min(m - half, n), 0)  # windows that begin over `half` bytes before the anchor
                for side, a, b, share in ((0, 0, near, raw[s + m - half - 1:s + m + gram]), (1, near, n, raw[s + m:s + m + match - half])):
                    if a < b:
                        key = int.from_bytes(hashlib.blake2b(share, digest_size=8, salt=bytes([side])).digest(), "little", signed=True)
                        out.append((key, d, s + a, b - a, raw[s + a:s + b + match - 1]))
        yield table(out)
    if windows[0]:
        yield table(_one_by_one(*windows))


def _shard(batches: Iterator[pa.RecordBatch], match: int, memory: int) -> Iterator[pa.RecordBatch]:
    """Windows of a shard's parts (sorted by key, document, start) that also begin earlier."""
    with tempfile.TemporaryFile() as file:
        size, last, rows = 0, None, tuple(array("q") for _ in range(4))
        one, firsts = None, {}  # the key of windows that are told one by one, and the first of each

        def add(r):
            nonlocal size
            text = np.frombuffer(r[4], np.uint8).astype("<u2") + np.uint16(2)
            file.write(text.tobytes() + b"\1\0")  # 1: a part's end
            for to, x in zip(rows, (size, r[1], r[2], r[3])):
                to.append(x)
            size += len(text) + 1

        for batch in batches:
            gone = []
            for r in zip(*(x.to_pylist() for x in batch.columns)):
                if r[3] < 0:
                    gone.append((r[1], r[2], -r[3]))
                    continue
                if r[3] == 0:
                    if one != r[0]:
                        one, firsts = r[0], {}
                    if firsts.setdefault(r[4], r[1:3]) != r[1:3]:
                        gone.append((r[1], r[2], 1))
                    continue
                if last is not None and r[:4] == last[0][:4]:
                    continue  # a repeated row
                with_before = last is not None and r[0] == last[0][0]
                if with_before and not last[1]:
                    add(last[0])
                if with_before:
                    add(r)
                last = (r, with_before)  # a part alone with its key needs no sorting
            if gone:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*gone)], ["d", "start", "n"])
        if not rows[0]:
            return
        file.write(b"\0\0")
        file.flush()
        text = np.memmap(file, "<u2", "r", shape=(size + 1,))
        at, d, start, n = (np.array(x, np.int64) for x in rows)
        for found in I.repeats(text, match, memory):
            k = np.searchsorted(at, found, side="right") - 1
            inside = found - at[k] < n[k]
            k, where = k[inside], found[inside] - at[k][inside]
            if len(k):
                order = np.lexsort((where, k))
                k, where = k[order], where[order]
                new = np.ones(len(k), bool)
                new[1:] = (k[1:] != k[:-1]) | (where[1:] != where[:-1] + 1)
                first = np.flatnonzero(new)
                count = np.diff(np.append(first, len(k)))
                yield pa.record_batch([pa.array(d[k[first]]), pa.array(start[k[first]] + where[first]), pa.array(count)], ["d", "start", "n"])
        del text


def _result(batches: Iterator[pa.RecordBatch], match: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, windows in zip(batch.column(1), batch.column(2)):
            raw = (text.as_py() or "").encode()
            n_removed = n_spans = 0
            kept = hashlib.sha256()
            at = 0
            if windows.is_valid:
                s, n = (np.asarray(windows.values.field(k)) for k in range(2))
                order = np.argsort(s, kind="stable")
                s, e = s[order], (s + n)[order] + match - 1
                reach = np.maximum.accumulate(e)
                new = np.concatenate([[True], s[1:] > reach[:-1]])
                first = np.flatnonzero(new)
                for a, b in zip(s[first].tolist(), reach[np.append(first[1:], len(s)) - 1].tolist()):
                    kept.update(raw[at:a])
                    n_removed, n_spans, at = n_removed + b - a, n_spans + 1, b
            kept.update(raw[at:])
            out.append((len(raw), n_removed, n_spans, kept.hexdigest()))
        cols = zip(*out) if out else [[]] * 4
        yield pa.record_batch([batch.column(0), *[pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]], names)


def numbered(docs: DataFrame) -> DataFrame:
    """``(d, doc_id, text)``: the id itself as ``d`` where ids are unique whole numbers, else the
    place of ``(doc_id, hash of the text)`` among all such pairs, nulls last."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if kind in ("bigint", "int", "smallint", "tinyint"):
        ids = rows.groupBy("doc_id").count().agg(F.max("count"), F.count_if(F.col("doc_id").isNull())).first()
        if not ids[1] and (ids[0] or 0) <= 1:
            return rows.withColumn("d", F.col("doc_id").cast("long"))
    rows = rows.withColumn("of", F.xxhash64("text"))
    pairs = rows.select("doc_id", "of").distinct().orderBy(F.asc_nulls_last("doc_id"), "of")
    spark = docs.sparkSession
    told = spark.createDataFrame(pairs.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), pairs.schema.add("d", "long")).toDF("id", "hash", "d")
    # sorted, so that a task that runs again cuts its rows as before
    return rows.join(told, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("of") == F.col("hash"))).select("doc_id", "text", "d").sortWithinPartitions("d")


def dedup(docs: DataFrame, match: int = MATCH, gram: int = GRAM, memory: int = MEMORY, block: int = C.SLICE_BYTES,
          hot_kinds: int = HOT_KINDS) -> DataFrame:
    """``doc_id`` and ``RESULT``, one row per document."""
    assert 0 < gram < match and match - gram < 127 and match < 255 and match <= block <= C.SLICE_BYTES
    rows = numbered(docs)
    texts = rows.select("d", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    met = (texts.mapInArrow(lambda b: _occurrences(b, match, gram, block), "h long, whole long, d long, at long, lead boolean")
           .repartition(parts, "h").sortWithinPartitions("lead", "h", "whole", "d", "at").mapInArrow(lambda b: _kinds(b, hot_kinds), "d long, at long, sort boolean, hot long"))
    met = C.written(met)
    copies = met.where("not sort").select("d", "at")
    levels = [r[0] for r in met.where("hot is not null").groupBy("at").count().where(F.col("count") <= HOT_ANCHORS).select("at").collect()]
    hot = [r[0] for r in met.where(F.col("hot").isNotNull() & (F.col("at") == min(levels))).select("hot").collect()] if levels else []
    hot = np.sort(np.array(hot, np.int64))

    runs = met.where("sort").groupBy("d").agg(F.collect_list("at").alias("runs"))  # fewer than the document has bytes
    cut = texts.join(runs, "d").select("d", "text", "runs").mapInArrow(lambda b: _parts(b, match, gram, hot), "key long, d long, start long, n long, part binary")
    sorted_parts = cut.repartition(parts, "key").sortWithinPartitions("key", "d", "start")
    found = sorted_parts.mapInArrow(lambda b: _shard(b, match, memory), "d long, start long, n long")

    window = F.struct(F.col("start"), F.col("n"))
    removed = (copies.select("d", F.shiftright("at", _START).alias("start"), (F.col("at").bitwiseAND(F.lit((1 << _ANCHOR) - 1)) + 1).alias("n"))
               .union(found).groupBy("d").agg(F.collect_list(window).alias("windows")))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.join(removed, "d", "left").select("doc_id", "text", "windows").mapInArrow(lambda b: _result(b, match, names), f"doc_id {kind}, {RESULT}")

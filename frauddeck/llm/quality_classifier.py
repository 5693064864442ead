"""Quality classifier: hashed word n-gram logistic regression trained by FTRL-proximal updates.

A text's tokens are its runs of letters and digits and its runs of ASCII punctuation. Features
are the hashes of its lower-cased tokens and of its pairs of neighbouring tokens, plus two
marks that stand for any word: a word in capitals, and a word that repeats the one before. The
value of a feature is the square root of its share of the text's features, so that a text's
length does not matter. A score is one sparse dot product.

Training reads a bounded sample of labelled texts (``SAMPLE_ROWS``), drawn by a hash of the
id, in one task that holds their hashed features (at most ``DIM`` numbers a text), and makes
``EPOCHS`` passes (more over a small sample: at least ``STEPS`` steps in all) of per-coordinate
follow-the-regularised-leader steps over it. The model is
one float for each of ``DIM`` buckets.

Defined results: null, empty and token-free texts get the score of the bias alone; without any
training row that is 0.5. Ids may be null or repeat; each row is scored by itself. Of labels,
null ids and null labels are ignored and the largest label of an id counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frauddeck.llm import common as C

DIM, SAMPLE_ROWS, EPOCHS, STEPS, THRESHOLD = 1 << 18, 16_000, 4, 16_000, 0.7
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1

LETTERS = C.byte_table([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
PUNCTUATION = C.byte_table([(0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)])
KIND = LETTERS + 2 * PUNCTUATION
CAPITAL, SMALL = C.byte_table([(0x41, 0x5A)]), C.byte_table([(0x61, 0x7A)])
CAPITALS_MARK, REPEAT_MARK = 0, 1


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number (ascending), bucket and value of each feature."""
    raw, off = C.utf8(texts)
    data = C.LOWER[raw]
    starts, ends, row = C.runs(KIND[raw], off)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, z.astype(float)
    h = C.run_hashes(data, starts, ends)
    pair, same = C.combine(h, 2), C.within(row, 2)
    word = np.flatnonzero(KIND[raw[starts]] == 1)
    again = word[1:][(h[word[1:]] == h[word[:-1]]) & (row[word[1:]] == row[word[:-1]])]
    count = lambda table: np.concatenate([[0], np.cumsum(table[raw], dtype=np.int64)])
    big, small = count(CAPITAL), count(SMALL)
    loud = np.flatnonzero((big[ends] - big[starts] > 1) & (small[ends] == small[starts]))
    bucket = lambda x: (x & np.uint64(DIM - 1)).astype(np.int64)
    key = np.concatenate([row * DIM + bucket(h), row[:-1][same] * DIM + bucket(pair[same]), row[again] * DIM + REPEAT_MARK, row[loud] * DIM + CAPITALS_MARK])
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.append(first, len(key)))
    r = key[first] // DIM
    total = np.bincount(r, weights=n, minlength=len(texts))
    return r, key[first] % DIM, np.sqrt(n / total[r])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int) -> np.ndarray:
    """Weights for DIM buckets and the bias from (buckets, values, label) rows, in their order."""
    z, n = np.zeros(DIM + 1), np.zeros(DIM + 1)

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) > L1, w, 0.0)

    for _ in range(max(epochs, -(-STEPS // max(len(rows), 1))) if rows else 0):
        for at, x, y in rows:
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
    return weights(np.arange(DIM + 1)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, keep: Column, sample_rows: int = SAMPLE_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """The model from at most ``sample_rows`` labelled texts whose ``doc_id`` satisfies ``keep``."""
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for a, b in C.slices(batch.column(0)):
                r, at, x = features(batch.column(0)[a:b])
                cut = np.searchsorted(r, np.arange(b - a + 1))
                for i, y in enumerate(batch.column(1)[a:b].to_pylist()):
                    s = slice(cut[i], cut[i + 1])
                    rows.append((np.append(at[s], DIM), np.append(x[s], 1.0), int(y > 0)))
        yield pa.record_batch([pa.array([ftrl(rows, epochs).tobytes()], pa.binary())], ["w"])

    sample = C.labelled_sample(docs, labels, "quality", keep, sample_rows)
    one = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit("order")), "doc_id").select("text", "label")
    got = one.mapInArrow(train, "w binary").collect()
    return np.frombuffer(got[0][0], np.float32) if got else np.zeros(DIM + 1, np.float32)


def score(docs: DataFrame, model: np.ndarray, threshold: float = THRESHOLD, passed: list[str] | None = None) -> DataFrame:
    """The ``passed`` columns (default ``doc_id``), ``score`` (0 to 1) and ``predicted`` (0 or 1)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIM floats

    def start():
        w = sent.value.astype(np.float64)

        def judge(texts):
            r, at, x = features(texts)
            s = 1 / (1 + np.exp(-(np.bincount(r, weights=w[at] * x, minlength=len(texts)) + w[DIM])))
            return pa.array(s), pa.array((s >= threshold).astype(np.int32))
        return judge

    return C.per_text(docs, start, "score double, predicted int", passed)

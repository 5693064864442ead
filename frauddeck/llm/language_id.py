"""Language identification by rank-order profiles of character n-grams.

A text's letters are lower-cased, everything else parts words, and n-grams of one to three
signs (word ends included) are counted inside words. The profile of a language ranks its
``PROFILE`` most frequent n-grams over a bounded sample of labelled texts (``SAMPLE_ROWS`` for
each language, drawn by a hash of the id). A document's own most frequent n-grams are ranked in
the same way over its whole text, and its distance from a language is the sum of how far each
n-gram is out of place (``PROFILE`` where the language's profile lacks it). The nearest
language wins; equal distances go to the first name. Equal counts rank by the n-gram itself.

The score is the relative lead over the runner-up, ``1 - best / second`` (one language:
``1 - distance / largest distance``), so it lies between 0 and 1.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every
text if nothing could be learned. Ids may be null or repeat. A run of over ``PIECE`` letters
is cut there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frauddeck.llm import common as C

PROFILE, SAMPLE_ROWS, PIECE, UNKNOWN = 400, 1500, 1 << 20, "und"
_EDGE = np.uint64(1)  # a word's end; no letter has this code


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: the lower-case letter, or 0."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 and low.isalpha() else i
    return out


def _count(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-gram codes and their counts of code points mapped by ``_letters``."""
    x = np.concatenate([[0], letters, [0]]).astype(np.uint64)
    x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]
    x[x == 0] = _EDGE
    if len(x) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s = np.uint64(21)
    pairs = (x[:-1] << s) | x[1:]
    codes = np.concatenate([x[x != _EDGE], pairs, ((pairs[:-1] << s) | x[2:])[x[1:-1] != _EDGE]])
    codes.sort()
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.diff(np.append(first, len(codes)))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    code, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(n, first) if len(first) else n


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a whole text, worked on in pieces that end between words."""
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    letters = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    parts, a = [], 0
    while a < len(letters):
        b = min(a + PIECE, len(letters))
        if b < len(letters):
            ends = np.flatnonzero(letters[a:b] == 0)
            b = a + int(ends[-1]) + 1 if len(ends) else b
        parts.append(_count(letters[a:b]))
        a = b
    return _merge(parts)


def top(code: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent codes, most frequent first."""
    if len(code) > 4 * k:  # ties of the k-th count stay in
        keep = n >= np.partition(n, -k)[-k]
        code, n = code[keep], n[keep]
    return code[np.lexsort((code, -n))][:k]


def fit(docs: DataFrame, keep: Column, profile: int = PROFILE, sample_rows: int = SAMPLE_ROWS) -> dict[str, np.ndarray]:
    """Profiles by language, from at most ``sample_rows`` texts for each value of ``lang``.

    Texts are drawn from rows that satisfy ``keep`` and have a text and a language.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = found.setdefault(lang, [])
                got.append(ngrams(text.as_py()))
                if len(got) >= 64:
                    found[lang] = [_merge(got)]
        for lang, got in found.items():
            code, n = _merge(got)
            yield pa.record_batch([pa.array([lang] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & keep)
    ids = usable.select(F.col("lang").alias("of"), F.col("doc_id").alias("id")).distinct()
    # the ranges of the hash, from the lowest, that hold the sample; only their ids are sorted, so no task
    # holds all ids of a language
    ids = C.written(ids.withColumn("place", F.xxhash64(F.col("id").cast("string"), F.lit("sample"))).withColumn("range", F.shiftright("place", 52)))
    before = F.sum("count").over(Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    low = ids.groupBy("of", "range").count().withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < sample_rows).select("of", "range")
    drawn = ids.join(F.broadcast(low), ["of", "range"])  # at most sample_rows ranges for each language
    drawn = drawn.withColumn("k", F.row_number().over(Window.partitionBy("of").orderBy("place", "id"))).where(F.col("k") <= sample_rows).select("of", "id")
    texts = (usable.join(F.broadcast(drawn), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("of")))  # sample_rows for each language
             .groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text"))
    counts = texts.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best = counts.withColumn("k", rank).where(F.col("k") <= profile).collect()  # profile rows for each language
    out: dict[str, list] = {}
    for r in sorted(best, key=lambda r: (r["lang"], r["k"])):
        out.setdefault(r["lang"], []).append(r["code"])
    return {k: np.array(v, np.int64).view(np.uint64) for k, v in out.items()}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], profile: int = PROFILE, passed: list[str] | None = None) -> DataFrame:
    """The ``passed`` columns (default ``doc_id``), ``lang_pred`` and ``score`` of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def start():
        names = sorted(sent.value)
        known = np.unique(np.concatenate([sent.value[x] for x in names])) if names else np.zeros(0, np.uint64)
        ranks = np.full((len(known) + 1, len(names)), -1, np.int64)  # -1: not in the profile
        for j, x in enumerate(names):
            ranks[np.searchsorted(known, sent.value[x]), j] = np.arange(len(sent.value[x]))

        def judge(text):
            code = top(*ngrams(text), profile)
            if not len(code) or not names:
                return UNKNOWN, 0.0
            at = np.searchsorted(known, code)
            at[(at >= len(known)) | (known[np.minimum(at, len(known) - 1)] != code)] = len(known)
            r = ranks[at]
            away = np.where(r < 0, profile, np.abs(r - np.arange(len(code))[:, None])).sum(axis=0)
            best = int(np.argmin(away))
            against = np.delete(away, best).min() if len(names) > 1 else profile * len(code)
            return names[best], float(1 - away[best] / against) if against else 0.0

        def run(texts):
            got = [judge(x.as_py()) for x in texts]
            return pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())
        return run

    return C.per_text(docs, start, "lang_pred string, score double", passed)

"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: words and word beginnings (four and five letters) whose odds of being
in a toxic text are high. A text counts for an entry once, and texts whose smallest word hash
agrees (near copies, mostly) count as one, so that a copied text can't fill the lexicon.

Features of a whole text: densities and counts of lexicon words, beginnings and distinct
entries, their mean weight, second-person words and their share among the neighbours of
lexicon hits, capitals, words in capitals, exclamation marks, other punctuation, obfuscated
words (letters mixed with digits or signs, or hits only after these are undone), stretched
letters and length.

Training reads a bounded sample of labelled texts (``SAMPLE_ROWS``, drawn by a hash of the id).
A quarter of it, told by the id's hash, is kept from the trees and fits the calibration.

Defined results: null, empty and word-free texts have the features of an empty text and are
scored like others. Without labels of both kinds the score is the share of toxic labels (0 if
there are none). Of several labels of an id the largest counts; null labels are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frauddeck.llm import common as C

SAMPLE_ROWS, MAX_ENTRIES, MIN_LOG_ODDS, MIN_TEXTS, MIN_SHARE = 12_000, 2000, 2.5, 3, 0.01
TREES, DEPTH, STEP, NEAR = 30, 3, 0.2, 5
BEGINNINGS = (4, 5)

#: Second-person words of the languages at hand.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch "
    "usted ustedes ti tus su vosotros".split())
#: Signs that stand for letters.
LOOKS_LIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

_WORD = re.compile(r"[^\W_]+(?:[@$!*'._-]+[^\W_]+)*")
_SPACE = re.compile(r"\s")
_MIXED = re.compile(r"[0-9@$!*._]")
_STRETCHED = re.compile(r"(.)\1\1")
N_FEATURES = 17


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def pieces(text: str, size: int = 1 << 20) -> Iterator[str]:
    """The text in stretches that end between words, so that a long one needs little memory."""
    a = 0
    while a < len(text):
        end = _SPACE.search(text, a + size)
        b = end.start() if end else len(text)
        yield text[a:b]
        a = b


def entries(word: str) -> list[str]:
    """The word and its beginnings as lexicon entries (beginnings end in a star)."""
    return [word] + [word[:k] + "*" for k in BEGINNINGS if len(word) >= k]


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Log odds of the entries that tell toxic texts, from ``sample (text, label)``."""
    def start():
        def run(texts):
            out, sign = [], []
            for t in texts:
                found = set(words(unicodedata.normalize("NFKC", t.as_py() or "")))
                out.append(sorted({e for w in found if len(w) <= 40 for e in entries(w)}))
                sign.append(min((_word_hash(w) for w in found), default=0))
            return pa.array(out, pa.list_(pa.string())), pa.array(sign, pa.int64())
        return run

    told = C.per_text(sample, start, "entry array<string>, sign long", ["label"]).checkpoint()
    # n: distinct signs, so that near copies count once
    total = {r["label"]: r["n"] for r in told.groupBy("label").agg(F.countDistinct("sign").alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    if not n1 or not n0:
        return {}
    once = told.select("label", "sign", F.explode("entry").alias("entry")).distinct()
    n = once.groupBy("entry").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    best = (n.where(F.col("toxic") >= max(MIN_TEXTS, math.ceil(MIN_SHARE * n1))).withColumn("odds", odds).where(F.col("odds") >= MIN_LOG_ODDS)
            .orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "entry").limit(MAX_ENTRIES))
    return {r["entry"]: r["odds"] for r in best.collect()}  # at most MAX_ENTRIES


def _word_hash(word: str) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1


def text_features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    text = text or ""
    n, weight, whole, begun, hidden, mixed, stretched = 0, 0.0, 0, 0, 0, 0, 0
    hit_at, second, seen = [], [], set()
    for piece in pieces(text):
        for i, w in enumerate(words(piece), n):
            n = i + 1
            if w in SECOND_PERSON:
                second.append(i)
            e = w if w in lexicon else w[:5] + "*" if w[:5] + "*" in lexicon else w[:4] + "*" if w[:4] + "*" in lexicon else None
            if not w.isalpha():
                if _MIXED.search(w) and not w.isdigit():
                    mixed += 1
                    if e is None:
                        bare = re.sub(r"[*._-]", "", w.translate(LOOKS_LIKE))
                        if bare in lexicon:
                            e, hidden = bare, hidden + 1
            if e is not None:
                hit_at.append(i)
                seen.add(e)
                weight += lexicon[e]
                whole += e[-1] != "*"
                begun += e[-1] == "*"
            elif len(w) > 2 and _STRETCHED.search(w):
                stretched += 1
    near = 0
    if hit_at and second:
        s, h = np.array(second), np.array(hit_at)
        near = int((np.searchsorted(s, h + NEAR, "right") > np.searchsorted(s, h - NEAR)).sum())
    hits, chars = len(hit_at), len(text)
    per = max(n, 1)
    big = _capitals(text)
    loud = text.count("!")
    return [hits / per, math.log1p(hits), whole / per, math.log1p(whole), begun / per, math.log1p(begun), math.log1p(len(seen)), weight / max(hits, 1),
            weight / per, len(second) / per, near / max(hits, 1), big / max(chars, 1), loud / per, _punctuation(text) / max(chars, 1), mixed / per + hidden,
            stretched / per, math.log1p(n)]


def _capitals(text: str) -> int:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return int(((raw >= 65) & (raw <= 90)).sum())


_SIGNS = C.byte_table([(0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)])


def _punctuation(text: str) -> int:
    return int(_SIGNS[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].sum())


def features(docs: DataFrame, lexicon: dict[str, float], passed: list[str] | None = None) -> DataFrame:
    """The ``passed`` columns and ``features array<double>``."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most MAX_ENTRIES

    def start():
        known = sent.value
        return lambda texts: [pa.array([text_features(t.as_py(), known) for t in texts], pa.list_(pa.float64()))]
    return C.per_text(docs, start, "features array<double>", passed)


class Model:
    def __init__(self, lexicon, trees=None, calibration=None, constant=None):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant


def _raw(rows: DataFrame, trees) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array
    out = trees.transform(rows.withColumn("features", array_to_vector("features")))
    return out.withColumn("raw_score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fit(docs: DataFrame, labels: DataFrame, keep: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model from at most ``sample_rows`` labelled texts whose ``doc_id`` satisfies ``keep``."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import IsotonicRegression

    from frauddeck.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(docs.sparkSession)
    sample = C.labelled_sample(docs, labels, "toxic", keep, sample_rows).withColumn("label", (F.col("label") > 0).cast("int"))
    sample = sample.checkpoint()  # bounded; read several times
    lexicon = learn_lexicon(sample)
    aside = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(4)) == 0
    rows = features(sample.withColumn("aside", aside), lexicon, ["label", "aside"]).checkpoint()
    n = {(r["aside"], r["label"]): r["count"] for r in rows.groupBy("aside", "label").count().collect()}
    if not n.get((False, 0)) or not n.get((False, 1)):
        total = sum(n.values())
        return Model(lexicon, constant=sum(v for (_, y), v in n.items() if y) / total if total else 0.0)
    train = rows.where(~F.col("aside")).select(F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features")).coalesce(2)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7, maxBins=32, cacheNodeIds=False).fit(train)
    apart = _raw(rows.where("aside"), trees).select(F.col("label").cast("double").alias("label"), F.col("raw_score"), F.lit(1.0).alias("weight"))
    if not n.get((True, 0)) or not n.get((True, 1)):
        return Model(lexicon, trees)
    return Model(lexicon, trees, IsotonicRegression(featuresCol="raw_score", labelCol="label", weightCol="weight").fit(apart))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``predicted`` (1 if the score is 0.5 or more) of each row."""
    if model.trees is None:
        out = docs.select("doc_id", F.lit(float(model.constant)).alias("score"))
    else:
        out = _raw(features(docs, model.lexicon), model.trees)
        if model.calibration is not None:
            out = model.calibration.setPredictionCol("calibrated").transform(out)
        out = out.select("doc_id", F.least(F.greatest(F.col("calibrated" if model.calibration is not None else "raw_score"), F.lit(0.0)), F.lit(1.0)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

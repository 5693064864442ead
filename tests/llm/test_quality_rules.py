"""Counts against plain Python; the estimation against its own definition and the labels."""

import math
import re
from collections import Counter

from frauddeck.llm import quality_rules as R

SPACE = r"[\x20\x09-\x0D]+"


def plain(text):
    text = text or ""
    w = [x for x in re.split(SPACE, text) if x]
    wins = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if wins[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))


TEXTS = [None, "", " \n\t", "a b c", "a b c a b c", "a a a a", "a a a", "é 😀 #x\n\né 😀 #x\n é 😀 #x", "x\r\ny\r\nx", "one two three one two three four one two", "a b\x0bc\x0cd \x1c e\xa0f", "ab " * 30000, "w$ |<>| %&\n" * 40,
         " ".join(f"w{i}" for i in range(5000))]


def test_counts(spark):
    df = spark.createDataFrame([(None if i % 3 else i, t, 1, "q") for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, n_words int, words string")
    got = R.counts(df, passed=["text"]).collect()
    assert len(got) == 2 * len(TEXTS)
    for r in got:
        assert tuple(r)[1:6] == plain(r["text"]), (r["text"] or "")[:50]


def test_tables(spark, sf_dir):
    from frauddeck.llm.queries import QUERIES
    big = sf_dir.replace("sf0.001", "sf0.01")
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text").collect()}
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    got = QUERIES["op8_quality_rules"](spark, big).collect()
    assert len(got) == len(texts)
    for r in got:
        n, chars, symbols, dup, again = plain(texts[r["doc_id"]])
        assert tuple(r)[1:6] == (n, chars, symbols, dup, again)
        assert r["base_failed"] == (n < 50 or 100 * again > 50 * n) and r["kept"] == (not r["base_failed"] and r["good_probability"] >= 0.5)
    fair = [r for r in got if not r["base_failed"] and r["doc_id"] in labels]
    good = [r for r in fair if labels[r["doc_id"]]]
    bad = [r for r in fair if not labels[r["doc_id"]]]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good) and sum(r["kept"] for r in bad) <= 0.2 * len(bad)


def test_estimation_recovers_rates(spark):
    """Votes drawn with known rates; the estimate's own fixed point, recomputed plainly."""
    import random
    rnd = random.Random(5)
    names = ["a", "b", "c", "d"]
    truth = {"a": (0.9, 0.05), "b": (0.7, 0.1), "c": (0.8, 0.02), "d": (0.6, 0.2)}
    rows = []
    for _ in range(6000):
        bad = rnd.random() < 0.3
        rows.append(tuple(0 if rnd.random() < 0.2 else -1 if rnd.random() < truth[x][0 if bad else 1] else 1 for x in names))
    rules = tuple(R.Rule(x, "false", "false") for x in names)
    model = R.estimate(spark.createDataFrame(rows, ", ".join(f"v_{x} int" for x in names)), rules, rounds=200)
    assert abs(model.bad - 0.3) < 0.05
    for x in names:
        assert all(abs(p - q) < 0.07 for p, q in zip(model.rates[x], truth[x])), x
    good = []
    for row in rows:
        odds = math.log((1 - model.bad) / model.bad)
        for x, v in zip(names, row):
            p, q = model.rates[x]
            odds += math.log(q / p) if v < 0 else math.log((1 - q) / (1 - p)) if v > 0 else 0
        good.append(1 / (1 + math.exp(-odds)))
    for j, x in enumerate(names):
        hit = sum(1 - g for g, row in zip(good, rows) if row[j] < 0)
        seen = sum(1 - g for g, row in zip(good, rows) if row[j])
        assert abs((hit + R.PRIOR * R.BAD_WHEN_BAD) / (seen + R.PRIOR) - model.rates[x][0]) < 0.005


def test_empty(spark):
    assert R.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0

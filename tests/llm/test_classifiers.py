"""Language, toxicity and quality: held-out accuracy, plain recomputation, edge cases."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from frauddeck.llm import common as C
from frauddeck.llm import language_id as L
from frauddeck.llm import quality_classifier as Q
from frauddeck.llm import toxicity as T
from frauddeck.llm.queries import QUERIES

ODD = [(900001, None), (900002, ""), (900003, " 12 --- "), (None, "the and of"), (900004, "the the " * 20000), (900004, "the the " * 20000)]


def big(sf_dir):
    return sf_dir.replace("sf0.001", "sf0.01")


def test_ngrams_against_plain_counts():
    text = "Ab, ab! Été 12x_ßa"
    want = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        p = f"\x01{w}\x01"
        want.update(w)
        want.update(p[i:i + 2] for i in range(len(p) - 1))
        want.update(p[i:i + 3] for i in range(len(p) - 2))
    # a word's end is shared by its neighbours, which changes no n-gram
    code, n = L.ngrams(text)
    got = {"".join(chr(c >> s & 0x1FFFFF) for s in (42, 21, 0) if c >> s & 0x1FFFFF): k for c, k in zip(code.tolist(), n.tolist())}
    assert got == dict(want)


def test_language(spark, sf_dir):
    docs = {r[0]: r for r in spark.read.parquet(f"{big(sf_dir)}/documents.parquet").select("doc_id", "lang", "text").collect()}
    got = QUERIES["op1_language_id"](spark, big(sf_dir)).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) > 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_distance_against_plain(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = L.fit(docs, C.fold("doc_id", 4) != 2, profile=50)
    for r in L.predict(docs, profiles, profile=50, passed=["doc_id", "text"]).limit(60).collect():
        code, n = L.ngrams(r["text"])
        mine = [c for _, c in sorted(zip((-n).tolist(), code.tolist()))][:50]
        away = {}
        for lang, p in profiles.items():
            place = {c: i for i, c in enumerate(p.tolist())}
            away[lang] = sum(abs(place[c] - i) if c in place else 50 for i, c in enumerate(mine))
        best = min(sorted(away), key=away.get)
        assert r["lang_pred"] == best
        second = min(v for k, v in away.items() if k != best)
        assert r["score"] == pytest.approx(1 - away[best] / second if second else 0.0)


def test_language_cases(spark):
    df = spark.createDataFrame([(i, "the and of this", "en", 1) for i in range(8)] + [(i + 8, "der die das und", "de", 1) for i in range(8)], "doc_id long, text string, lang string, score int")
    profiles = L.fit(df, C.fold("doc_id", 4) != 2)
    odd = spark.createDataFrame([(a, b, None, 1) for a, b in ODD], df.schema)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in L.predict(odd, profiles).collect()]
    assert [g[1] for g in got] == ["und", "und", "und", "en", "en", "en"] and got[0][2] == 0
    assert L.fit(odd, C.fold("doc_id", 4) != 2) == {}
    assert {r["lang_pred"] for r in L.predict(odd, {}).collect()} == {"und"}
    assert L.predict(odd.where("false"), profiles).count() == 0


def test_quality(spark, sf_dir):
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{big(sf_dir)}/labels.parquet").collect()}
    got = [r for r in QUERIES["op10_quality_classifier"](spark, big(sf_dir)).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in got) >= 0.95 * len(got)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_quality_score_is_the_dot_product(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    w = np.random.default_rng(1).normal(size=Q.DIM + 1).astype(np.float32)
    for r in Q.score(docs.limit(40), w, passed=["text"]).collect():
        row, at, x = Q.features(C.pa.array([r["text"]]))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(float(w[at].astype(float) @ x) + w[-1]))))
        assert not len(x) or float(x @ x) == pytest.approx(1)


def test_quality_features():
    row, at, x = Q.features(C.pa.array(["The the  THE!!", None, "", "a, b"]))
    assert set(row.tolist()) == {0, 3}
    # the, the, the, !! + 3 pairs (two alike) + 2 repeats + 1 word in capitals = 10 features in all
    first = sorted(np.round(x[row == 0] ** 2 * 10).astype(int).tolist())
    assert first == [1, 1, 1, 2, 2, 3]


def test_quality_cases(spark):
    docs = spark.createDataFrame([(a, b, 0.5, 1) for a, b in ODD], "doc_id long, text string, score double, label int")
    none = spark.createDataFrame([(None, 1), (5, None)], "doc_id long, quality int")
    model = Q.fit(docs, none, C.fold("doc_id", 4) != 2)
    got = Q.score(docs, model).collect()
    assert len(got) == len(ODD) and all(r["score"] == 0.5 for r in got)
    twice = spark.createDataFrame([(900001, 1), (900003, 0), (900003, 1), (900004, 0)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in Q.score(docs, Q.fit(docs, twice, C.F.lit(True))).collect())


def test_toxicity(spark, sf_dir):
    labels = {r[0]: r[2] for r in spark.read.parquet(f"{big(sf_dir)}/labels.parquet").collect()}
    got = [r for r in QUERIES["op2_toxicity"](spark, big(sf_dir)).collect() if r["doc_id"] in labels]
    held = [r for r in got if r["held_out"]]
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_toxicity_features():
    known = {"idiot": 3.0, "lowei*": 2.0}
    f = T.text_features("You IDIOT, you! id1ot loweichen yessss", known)
    assert f[1] == pytest.approx(np.log1p(3)) and f[3] == pytest.approx(np.log1p(2)) and f[5] == pytest.approx(np.log1p(1))
    assert f[9] == pytest.approx(2 / 6) and f[10] == pytest.approx(3 / 3) and f[12] == pytest.approx(1 / 6) and f[15] == pytest.approx(1 / 6)
    assert len(T.text_features(None, known)) == T.N_FEATURES and T.text_features("", {})[0] == 0


def test_toxicity_cases(spark):
    docs = spark.createDataFrame([(a, b, 0.5) for a, b in ODD], "doc_id long, text string, score double")
    for labels in ([], [(900003, 0), (900004, 0)], [(900003, 1), (900004, 0), (None, 1), (900004, None)]):
        model = T.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), C.F.lit(True))
        got = T.score(docs, model).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)

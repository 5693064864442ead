"""The pipeline stage by stage, each against plain Python on what the stage before kept."""

import corpus_pipeline as P
from test_decontaminate import plain as plain_hits
from test_packing import check as check_packing
from test_packing import plain as plain_ids
from test_secrets import PLAIN
from test_secrets import plain as plain_spans
from test_simhash import plain_components, plain_fingerprint

from frauddeck.llm import common as C
from frauddeck.llm.queries import QUERIES


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def redacted(text):
    for kind in PLAIN:
        for s, _, e in reversed(plain_spans(text, [kind])):
            text = text[:s] + "[SECRET]" + text[e:]
    return text


def test_stages(spark, sf_dir):
    docs = C.read(spark, sf_dir, "documents")
    columns, step = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        docs = C.written(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        step[name] = rows(docs)
    start = rows(C.read(spark, sf_dir, "documents"))
    good = {r["doc_id"] for r in QUERIES["op10_quality_classifier"](spark, sf_dir).collect() if r["predicted"]}
    assert set(step["quality"]) == good < set(start) and all(step["quality"][d] == start[d] for d in good)
    found = plain_components([(d, plain_fingerprint(r["text"])) for d, r in step["quality"].items()])
    assert set(step["near_duplicates"]) == {c for _, _, c in found} < good
    items = [tuple(r) for r in C.read(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    hits = plain_hits([(d, r["text"]) for d, r in step["near_duplicates"].items()], items)
    assert set(step["decontaminate"]) == {r[0] for r in hits if not r[-1]} < set(step["near_duplicates"])
    assert set(step["secrets"]) == set(step["decontaminate"])
    for d, r in step["secrets"].items():
        before = step["decontaminate"][d]
        text = redacted(before["text"])
        assert r["text"] == text and r["n_chars"] == (before["n_chars"] if text == before["text"] else len(text)) and r["lang"] == before["lang"]
    packed = [tuple(r) for r in P.STAGES[-1][1](spark, docs, sf_dir).collect()]
    check_packing(packed, {d: plain_ids(r["text"]) for d, r in step["secrets"].items()})
    again = [tuple(r) for r in P.run(spark, sf_dir).collect()]
    assert {r[0]: r[4] for r in again} == {r[0]: r[4] for r in packed}  # each document's tokens


def test_odd_tables(spark, sf_dir):
    """Nulls, repeated rows and ids, columns with the operators' own names, an empty table."""
    text = "password=abcdefghijklmnop and more words here that are quite plain and long enough"
    data = [(1, text, 5, "a"), (1, text, 5, "a"), (2, text + "!", None, "b"), (None, text, 1, "c"), (None, None, 1, "c"), (4, "", 0, None), (1, "other words under an id that is taken already and nothing more", 9, "d"), (None, "lone text without any id or copy in sight at all", 3, "e")]
    df = spark.createDataFrame(data, "doc_id long, text string, n_chars long, score string").withColumn("component_id", C.F.lit(7)).withColumn("fp", C.F.lit(8)).withColumn("kinds", C.F.lit("k")).withColumn("key", C.F.lit(1))
    stay = P.near_duplicates(spark, df, sf_dir)
    assert stay.columns == df.columns
    got = sorted((tuple(r)[:2] for r in stay.collect()), key=str)
    # rows under one id are one document: of those of id 1 the text of the least hash stays; the text of id 2
    # differs in more than two bits
    of_one = spark.createDataFrame([(text,), (data[6][1],)], "t string").orderBy(C.F.xxhash64("t")).first()[0]
    assert got == sorted([(1, of_one), (2, text + "!"), (4, ""), (None, data[7][1])], key=str)
    for f in (P.quality, P.near_duplicates, P.decontaminate, P.secrets):
        assert f(spark, df, sf_dir).columns == df.columns and f(spark, df.where("false"), sf_dir).count() == 0
    clean = P.secrets(spark, df, sf_dir)
    assert clean.count() == len(data) and not [r for r in clean.collect() if r["text"] and "abcdefgh" in r["text"]]
    assert P.decontaminate(spark, df, sf_dir).count() == len(data)
    assert P.pack(spark, df.where("false"), sf_dir).count() == 0

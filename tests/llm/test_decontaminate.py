"""Decontamination against a plain search for every window in every document."""

import hashlib
import re

import pytest

from frauddeck.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    wins = {}
    for item, text in items:
        w = words(text)
        if item is not None:
            for i in range(max(len(w) - 9, min(len(w), 1))):
                wins.setdefault(tuple(w[i:i + 10]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for win, ids in wins.items():
            for i in range(len(w) - len(win) + 1):
                if w[i] == win[0] and tuple(w[i:i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found |= ids
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


LONG = "one two three four five six seven eight nine ten eleven twelve"
DOCS = [(1, f"x {LONG} y"), (2, f"{LONG.upper()}! {LONG}"), (3, None), (4, ""), (5, "Alpha, beta 7 alpha beta alpha"), (6, "one two three four five six seven eight nine"),
        (6, "same id " + LONG), (None, "é1 ñandú É1"), (8, "a " * 30000 + LONG), (9, "§§ !!"), (9, "§§ !!")]
ITEMS = [(1, LONG), (2, "alpha BETA alpha"), (3, ""), (4, None), (None, "seven eight"), (5, LONG), (5, LONG), (7, "É1"), (10, "a a a a a a a a a a a a")]


@pytest.mark.parametrize("block", [200_000, 3])
def test_cases(spark, block):
    docs = spark.createDataFrame([(a, b, "z", 1) for a, b in DOCS], "doc_id long, text string, items string, n_hit int")
    items = spark.createDataFrame([(a, b, "q") for a, b in ITEMS], "item_id long, text string, window string")
    got = sorted((tuple(r) for r in decontaminate(docs, items, block_windows=block).collect()), key=str)
    assert got == plain(DOCS, ITEMS)


def test_many_blocks_meet_in_no_task(spark):
    """Twenty blocks and more: the last plan has one search, without windows; hits come from written tables."""
    items = [(i, " ".join(f"w{i * 7 + j}" for j in range(10))) for i in range(60)]
    docs = [(d, " ".join(f"w{j}" for j in range(d * 5, d * 5 + 40))) for d in range(40)] + [(7, "w1 w2"), (None, items[3][1])]
    out = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_windows=3)
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain(docs, items)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1 and plan.count("Scan parquet") >= 20


def test_empty(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, items).where("contaminated").count() == 0
    assert decontaminate(docs.where("false"), items).count() == 0


def test_tables(spark, sf_dir):
    from frauddeck.llm.queries import QUERIES
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = sorted((tuple(r) for r in QUERIES["op4_decontamination"](spark, sf_dir).collect()), key=str)
    assert got == plain(docs, items) and any(r[-1] for r in got)

"""Induced sorting against plain sorting; dedup against all windows in a dictionary."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from frauddeck.llm import induced_sort as I
from frauddeck.llm import suffix_dedup as S


def plain(docs, match=100):
    """docs: (doc_id, text) in order of document; repeated rows are one document."""
    first, out = {}, {}
    for key in sorted(set(docs), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        raw = (key[1] or "").encode()
        cover = np.zeros(len(raw) + 1, np.int64)
        for i in range(len(raw) - match + 1):
            if first.setdefault(raw[i:i + match], (key, i)) != (key, i):
                cover[i] += 1
                cover[i + match if i + match < len(cover) else -1] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[key] = (key[0], len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return sorted((out[k] for k in docs), key=str)


@pytest.fixture
def small_chunks():
    before = I.CHUNK
    I.CHUNK = 4
    yield
    I.CHUNK = before


def test_induced_sort(small_chunks):
    rnd = random.Random(1)
    for _ in range(400):
        k, limit, memory = rnd.choice([1, 2, 3, 8]), rnd.choice([2, 3, 5, 10]), rnd.choice([3, 10, 1 << 20])
        t = [rnd.randrange(1, k + 1) for _ in range(rnd.randrange(1, 60))] * rnd.choice([1, 1, 3]) + [0]
        text = np.array(t, np.uint16)
        got = I.suffixes(text, limit, memory).tolist()
        assert sorted(got) == list(range(len(t))) and [t[i:i + limit] for i in got] == sorted(t[i:i + limit] for i in range(len(t)))
        before = None
        for s, a in ((int(s), int(a)) for x, y in I.neighbours(text, limit, memory) for s, a in zip(x, y)):
            if before is not None:
                same = 0
                while same < limit and max(s, before) + same < len(t) and t[s + same] == t[before + same]:
                    same += 1
                assert a == same
            before = s


def rows():
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choices("abcdefgh é", k=n))
    a, b, line = text(900), text(5000), "Licensed under this or that and this line is long enough to be an anchor by itself. "
    out = [(1, a), (2, a), (3, a[:500] + text(300) + a[400:]), (4, a[:99]), (5, "x" + a[:100]), (6, b[1000:4000]), (7, b), (8, "a" * 700), (9, "ab" * 400), (10, "a" * 150 + "b" + "a" * 150), (11, None), (12, ""),
           (13, a[300:420] + text(50) + a[300:420]), (14, text(60000) + b[:300])]
    out += [(20 + i, text(40 + i) + line + text(60)) for i in range(30)]
    out += [(60 + i, a[:200] + chr(97 + i) + a[201:600] + text(i)) for i in range(15)]
    return out


def test_cases(spark):
    docs = rows()
    df = spark.createDataFrame([(a, b, "z") for a, b in docs], "doc_id long, text string, d string")
    assert sorted((tuple(r) for r in S.dedup(df).collect()), key=str) == plain(docs)
    assert S.dedup(df.where("false")).count() == 0


def test_repeated_and_null_ids(spark):
    docs = rows()[:3] + rows()[:1] + [(None, rows()[0][1]), (None, "short"), (2, "x" * 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((tuple(r) for r in S.dedup(df).collect()), key=str)
    assert len(got) == len(docs)
    want = plain(docs)
    loose = lambda x: sorted((r[:2] for r in x), key=str)  # noqa: E731  the order of one id's texts is by hash
    assert loose(got) == loose(want) and [r for r in got if r[0] in (1, 3)] == [r for r in want if r[0] in (1, 3)]
    assert sum(r[2] for r in got) == sum(r[2] for r in want)


def test_small_blocks_and_memory(spark, monkeypatch):
    docs = rows()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in S.dedup(df, memory=50).collect()), key=str) == plain(docs)
    assert sorted((tuple(r) for r in S.dedup(df, match=30, gram=12).collect()), key=str) == plain(docs, 30)


def test_texts_longer_than_a_block(spark):
    """No window is in two blocks, and repeats across block borders are found."""
    docs = rows()[:8] + [(90, rows()[6][1][:2500])]
    raw = docs[6][1].encode()
    batch = pa.record_batch([pa.array([1]), pa.array([raw.decode()])], ["d", "text"])
    starts = [int(b[0]) + k for _, part, _, b in S._pieces([batch], 100, 300) for k in range(len(part) - 99)]
    assert starts == list(range(len(raw) - 99))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((tuple(r) for r in S.dedup(df, block=300).collect()), key=str) == plain(docs)
    unique = spark.createDataFrame([(1, docs[6][1])], "doc_id long, text string")
    assert S.dedup(unique, block=300).first()["n_removed"] == 0


def test_copies_where_jobs_cut_the_table_differently(spark, tmp_path, monkeypatch):
    """Scan partitions that change from job to job lose no copies."""
    docs = [(i, rows()[0][1]) for i in range(8)]
    for i, row in enumerate(docs):
        spark.createDataFrame([row], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/t/part={i}")
    written, conf = S.C.written, {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k, None) for k in conf}

    def between(df):
        out = written(df)
        spark.conf.set("spark.sql.files.minPartitionNum", "8")
        spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))
        return out

    monkeypatch.setattr(S.C, "written", between)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.read.parquet(f"{tmp_path}/t").select("doc_id", "text")
        assert sorted((tuple(r) for r in S.dedup(df).collect()), key=str) == plain(docs)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_anchors_are_dealt_by_window(spark):
    """A passage that many documents share: no shard gets all their parts, results stay."""
    docs = rows()
    df = spark.createDataFrame(docs + docs[:2], "doc_id long, text string").repartition(5)
    for hot_kinds in (1, 5):
        assert sorted((tuple(r) for r in S.dedup(df, hot_kinds=hot_kinds).collect()), key=str) == plain(docs + docs[:2])
    raw = docs[20][1].encode()  # one of thirty texts around one line
    row, start, anchor, count, h, _ = S._runs(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 100, 32)
    assert S._anchors([raw[s + m:s + m + 32] for s, m in zip(start, anchor)], 32).tolist() == h.view(np.int64).tolist()
    runs = (start << S._START | anchor << S._ANCHOR | (count - 1)).tolist()
    batch = pa.record_batch([pa.array([1]), pa.array([docs[20][1]]), pa.array([runs])], ["d", "text", "runs"])
    dealt = [r for b in S._parts([batch], 100, 32, np.sort(h.view(np.int64))) for r in b.to_pylist()]
    assert len({r["key"] for r in dealt}) == len(dealt) == len(raw) - 99 and {r["n"] for r in dealt} == {0}


def test_kinds_tell_hot_anchors_across_batches():
    h = [1] * 3 + [2] * 7 + [3] * 4
    cols = [h, list(range(14)), list(range(14)), [0] * 14, [True] * 14]
    for size in (1, 2, 5, 14):
        batches = [pa.record_batch([pa.array(x[a:a + size]) for x in cols], ["h", "whole", "d", "at", "lead"]) for a in range(0, 14, size)]
        got = [r for b in S._kinds(batches, 3) for r in b.to_pylist()]
        assert [(r["hot"], r["at"]) for r in got if r["hot"] is not None] == [(2, 3), (2, 6), (3, 3)]
        assert sorted(r["d"] for r in got if r["sort"]) == list(range(14))


def test_tables(spark, sf_dir):
    from frauddeck.llm.queries import QUERIES
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op6_suffix_dedup"](spark, sf_dir).collect()), key=str)
    assert got == plain(docs) and any(r[2] for r in got)

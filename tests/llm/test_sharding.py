"""Jump hashing against the published loop, moves on growth, slots, edge cases, written folders."""

import hashlib
import tempfile
import zlib

from pyspark.sql import functions as F

from frauddeck.llm import sharding as S


def jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_of_known_keys(spark):
    keys = [0, 1, 2, 10, 0xDEADBEEF, (1 << 63), (1 << 64) - 1, 1 << 40]
    d = spark.createDataFrame([(str(k),) for k in keys], "k string")
    counts = [1, 2, 8, 9, 100, 1000]
    got = {int(r.k): r.at for r in d.withColumn("at", S.jump_shards(F.col("k").cast("decimal(20,0)"), counts)).collect()}
    assert all(got[k] == [jump(k, n) for n in counts] for k in keys)


def test_rows_against_the_loop(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = S.shard_documents(docs, 8).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw, key = texts[r.doc_id].encode(), int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:16], 16)
        assert (r.size, r.text_crc32, r.shard, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), jump(key, 8), jump(key, 9))
        assert r.grown_shard in (r.shard, 8)
    for q in range(8):
        slots = sorted((r.doc_id, r.slot) for r in rows if r.shard == q)
        assert [s for _, s in slots] == list(range(len(slots)))


def test_shares_are_near_equal_and_few_rows_move(spark):
    d = spark.range(20000).select(S.jump_shards(S.stable_key(F.col("id")), [8, 9]).alias("at"))
    n = [r["count"] for r in d.groupBy(d.at[0]).count().collect()]
    moved = d.where("at[0] <> at[1]").count()
    assert len(n) == 8 and max(n) < 1.1 * 2500 and abs(moved - 20000 / 9) < 150


def test_nulls_repeats_hot_key_and_clashing_names(spark):
    rows = [(None, None, 1)] * 300 + [(7, "a", 2)] * 400 + [(i, "été " * i, 3) for i in range(100)] + [(8, "", 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, slot int").withColumn("shard", F.lit("x")).repartition(7)
    out = S.shard_documents(d, 3).collect()
    assert len(out) == len(rows)
    for q in range(3):
        assert sorted(r.slot for r in out if r.shard == q) == list(range(sum(r.shard == q for r in out)))
    assert {r.shard for r in out if r.doc_id is None} == {jump(int(hashlib.md5(b"").hexdigest()[:16], 16), 3)}
    assert {(r.size, r.text_crc32) for r in out if r.doc_id is None} == {(1, 0)}
    assert S.shard_documents(d.limit(0), 3).count() == 0


def test_written_shards_hold_whole_rows(spark):
    d = spark.createDataFrame([(i, "t" * i, i % 3) for i in range(50)], "doc_id long, text string, Shard int")
    path = tempfile.mkdtemp(prefix="fd-shards-") + "/out"
    S.write_shards(d, path, 4)
    back = spark.read.parquet(path)
    want = {r.doc_id: r.shard for r in S.shard_documents(d, 4).collect()}
    assert {r.doc_id: (r.text, r.shard) for r in back.collect()} == {i: ("t" * i, want[i]) for i in range(50)}

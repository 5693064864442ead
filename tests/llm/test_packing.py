"""Packing: every id in one piece, no sequence too long, little padding, ids as the tokenizer gives them."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from frauddeck.llm import common as C
from frauddeck.llm import packing
from frauddeck.llm.packing import Encoder, pack, pack_documents

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def plain(text):
    t = tokenizers.Tokenizer.from_file(PATH)
    return t.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, docs, most=2048):
    """rows: (doc_id, start, length, crc, doc_tokens, sequence, offset); docs: ids by doc_id."""
    seen, fill = {}, {}
    for d, start, n, crc, total, seq, offset in rows:
        assert total == len(docs[d]) and n > 0
        assert crc == zlib.crc32(np.array(docs[d][start:start + n], "<u4").tobytes())
        seen.setdefault(d, []).append((start, n))
        fill.setdefault(seq, []).append((offset, n))
    assert set(seen) == set(docs)
    for d, parts in seen.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == len(docs[d])
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= most
    return len(fill)


def test_encoder_cuts_where_words_begin():
    texts = ["", " x", "x ", "a  b\n c \t d", "\n\n a", "don't stop 12 34 é  ñ b c　 d", "\x1c a \x1db c", "<|endoftext|> a <|endoftext|>", "hi\r\n there", "١٢ क्ष a",
             "foo.\nBar \nx y\n", "a\nb\n\nc d \n\n e f\n g", "a\n'll\n b 's", "w" * 5000 + " " + "w" * 60 + " w"]
    texts += ["x " + s + "y" for s in ("\u00a0", "\u2003", "\u3000", "\u0085", "\u1680", "\u200b")] + ["a\u00a0 b", "é\u2009 c 漢 字\n漢", "😀 😀 a", "<|endof text|> b", "x<|endoftext|>", "\x1c\x1f \x7f a", "it's 's' '.a ''s 1st 2.5x x2 a1b2 a.b,c;d'll we've ''ve x'1 9's", "\n\na\n\n b\n c", "é's é.b é1 ñ,", "a\n", "\na", "don\u2019t \u201ca\u201d b", "Ġ a", "a\tb \tc\n\td"]
    encode = Encoder(PATH)
    for _ in range(2):  # the second time most pieces are known
        ids, at = encode(*C.utf8(pa.array(texts)))
        for i, t in enumerate(texts):
            assert ids[at[i]:at[i + 1]].tolist() == (plain(t)[:-1] if t else []), t


def test_encoder_keeps_little_and_tells_equal_hashes(monkeypatch):
    """A few places: pieces come and go. One hash for all: bytes decide."""
    texts = pa.array([" ".join(f"w{i * k % 97}" for i in range(200)) for k in range(1, 20)])
    want = [plain(t)[:-1] for t in texts.to_pylist()]

    def check():
        encode = Encoder(PATH)
        for _ in range(2):
            ids, at = encode(*C.utf8(texts))
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want
    monkeypatch.setattr(packing, "PLACES", 4)
    check()
    monkeypatch.undo()
    monkeypatch.setattr(C, "run_hashes", lambda data, s, e: np.zeros(len(s), np.uint64) + np.uint64(5))
    check()


def test_tables(spark, sf_dir):
    from frauddeck.llm.queries import QUERIES
    docs = {r[0]: plain(r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    sequences = check([tuple(r) for r in QUERIES["op3_packing"](spark, sf_dir).collect()], docs)
    assert sequences <= -(-sum(map(len, docs.values())) // 2048) + 1


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (4, "x"), (5, "x")]
    df = spark.createDataFrame([(a, b, 7) for a, b in rows], "doc_id long, text string, start int").coalesce(1)
    got = [tuple(r) for r in pack_documents(df, PATH, group_tokens=3000).collect()]
    check(got, {d: plain(t) for d, t in rows})
    assert pack_documents(df.where("false"), PATH).count() == 0
    again = pack_documents(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string"), PATH).collect()
    assert len(again) == 3 and len({(r["sequence_id"], r["offset"]) for r in again}) == 3


def test_pack_balances_cost():
    rnd = np.random.default_rng(3)
    lengths = rnd.integers(1, 5000, 3000)
    rows = pack(lengths)
    got = {}
    for d, start, n, q, offset in rows:
        got.setdefault(q, []).append((offset, n))
    assert sum(n for x in got.values() for _, n in x) == lengths.sum()
    assert max(sum(n for _, n in x) for x in got.values()) <= 2048
    assert len(got) <= -(-lengths.sum() // 2048) + 1
    mixed = [sum(n + n * n / 2048 for _, n in x) for x in got.values() if len(x) > 1]
    assert np.std(mixed) < 0.25 * np.mean(mixed)

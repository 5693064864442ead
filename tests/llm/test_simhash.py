"""Fingerprints and components against plain Python over all pairs."""

import random
import re

import xxhash

from frauddeck.llm import simhash as S


def plain_fingerprint(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(max(len(w) - k + 1, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, radius=2):
    """rows: (id, fingerprint); smallest id reachable, None last."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    low = {}
    for d, f in rows:
        r = find(f)
        low[r] = d if low.get(r) is None else low[r] if d is None else min(low[r], d)
    return [(d, f"{f:016x}", low[find(f)]) for d, f in rows]


def test_tables(spark, sf_dir):
    from frauddeck.llm.queries import QUERIES
    docs = [(r[0], plain_fingerprint(r[1])) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in QUERIES["op5_simhash"](spark, sf_dir).collect())
    assert got == sorted(plain_components(docs)) and any(d != c for d, _, c in got)


def test_cases(spark):
    long = " ".join(random.Random(1).choices("a b c dd ee ff ggg".split(), k=20000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "A\nb"), (7, "a b"), (None, "a  b"), (8, long), (9, long + " zz"), (9, long + " zz"), (None, "é x ü"), (10, "only")]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, fp string")
    want = plain_components([(d, plain_fingerprint(t)) for d, t in rows])
    assert sorted(map(str, (tuple(r) for r in S.near_duplicates(df).collect()))) == sorted(map(str, want))
    assert S.near_duplicates(df.where("false")).count() == 0


def test_links_of_crowded_cells(spark):
    """Thousands of fingerprints in a few cells, in many tiles; chains and near copies."""
    rnd = random.Random(2)
    fps = {0, 3, 15, 63}
    for _ in range(3):
        centre = rnd.getrandbits(64)
        for _ in range(250):
            f = centre
            for b in rnd.sample(range(64), rnd.randrange(4)):
                f ^= 1 << b
            fps.add(f)
    fps |= {rnd.getrandbits(64) for _ in range(200)}
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r["node"] & (1 << 64) - 1: r["root"] & (1 << 64) - 1 for r in S.components(S.links(df, tile=50)).collect()}
    want = {f: c for _, f, c in plain_components(list(zip(sorted(fps), sorted(fps))))}
    groups = {}
    for f in fps:
        groups.setdefault(got.get(f, f), set()).add(f)
    theirs = {}
    for f in fps:
        theirs.setdefault(want[f"{f:016x}"], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, theirs.values()))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 100), (200, 200)]
    got = dict(tuple(r) for r in S.components(spark.createDataFrame(chain, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert S.components(spark.createDataFrame([], "u long, v long")).count() == 0

"""One query per operator (`opN_...`), each over its whole table, and the whole pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from frauddeck.llm import common as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str):
    def register(f):
        QUERIES[name] = f
        return f
    return register


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE["op4_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, win)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)"""


@query("op4_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frauddeck.llm.decontaminate import decontaminate
    return decontaminate(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from frauddeck.llm.packing import pack_documents
    return pack_documents(C.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frauddeck.llm.simhash import near_duplicates
    return near_duplicates(C.read(spark, sf_dir, "documents"), shingle=3, radius=2)


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frauddeck.llm import quality_classifier as Q
    docs = C.read(spark, sf_dir, "documents")
    model = Q.fit(docs, C.read(spark, sf_dir, "labels"), C.fold("doc_id", 4) != 2)
    return Q.score(docs, model).selectExpr("doc_id", "coalesce(crc32(cast(doc_id as string)) % 4 = 2, false) as held_out", "score", "predicted")


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frauddeck.llm import language_id as L
    docs = C.read(spark, sf_dir, "documents")
    profiles = L.fit(docs, C.fold("doc_id", 4) != 2)
    return L.predict(docs, profiles).selectExpr("doc_id", "coalesce(crc32(cast(doc_id as string)) % 4 = 2, false) as held_out", "lang_pred", "score")


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frauddeck.llm import toxicity as T
    docs = C.read(spark, sf_dir, "documents")
    model = T.fit(docs, C.read(spark, sf_dir, "labels"), C.fold("doc_id", 5) != 0)
    return T.score(docs, model).selectExpr("doc_id", "coalesce(crc32(cast(doc_id as string)) % 5 = 0, false) as held_out", "score", "predicted")


def _op7_sql() -> str:
    """Matches lie between the parts that they split a text into, rule by rule."""
    from frauddeck.llm import secrets as S
    found = []
    for i, r in enumerate(S.RULES):
        regex = "'" + r.regex.replace("'", "''") + "'"
        found.append(f"""SELECT doc_id, {i} AS kind, e - len(m) AS s, e, len(g) >= {r.least} AS ok FROM (
  SELECT doc_id, ms[j] AS m, gs[j] AS g, sum(len(parts[j]) + len(ms[j])) OVER (PARTITION BY doc_id ORDER BY j) AS e
  FROM (SELECT doc_id, parts, ms, gs, unnest(range(1, len(ms) + 1)) AS j
        FROM (SELECT doc_id, string_split_regex(t, {regex}) AS parts, regexp_extract_all(t, {regex}) AS ms, regexp_extract_all(t, {regex}, {r.group}) AS gs FROM d)))""")
    kinds = "['" + "', '".join(r.kind for r in S.RULES) + "']"
    told = "string_agg({}, ',' ORDER BY s, kind)"
    span = f"{kinds}[kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    counts = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{r.kind}" for i, r in enumerate(S.BASE))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT * FROM ({' UNION ALL '.join(found)}) WHERE ok),
a AS (SELECT doc_id, {counts}, {told.format(span)} FILTER (kind < {len(S.BASE)}) AS base, {told.format(span)} AS spans FROM f GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in S.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""


ORACLE["op7_secret_scans"] = _op7_sql()


@query("op7_secret_scans")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from frauddeck.llm import secrets as S
    found = S.scan(C.read(spark, sf_dir, "documents"))

    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    n = [of(i).alias(f"n_{r.kind}") for i, r in enumerate(S.BASE)]
    base = F.filter("spans", lambda s: s["kind"] < len(S.BASE))
    return found.select("doc_id", *n, F.sha2(S.written(base), 256).alias("base_sha256"), S.written(F.col("spans")).alias("spans"))


@query("op9_url_filters")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frauddeck.llm import url_filter as U
    return U.judge(C.read(spark, sf_dir, "pages"), U.fit(U.labelled_urls(spark)))


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frauddeck.llm.quality_rules import judge
    return judge(C.read(spark, sf_dir, "documents"))


# bytes are pairs of hexadecimal digits here
ORACLE["op6_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 99, 0))) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(k) ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r),
s AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
sp AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS b FROM s GROUP BY 1, 2),
cut AS (SELECT doc_id, span, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY span), 0) AS before FROM sp),
kept AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY span) || substr(max(h), 2 * max(b) + 1) AS k
  FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


@query("op6_suffix_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frauddeck.llm.suffix_dedup import dedup
    return dedup(C.read(spark, sf_dir, "documents"))


def _op11_sql() -> str:
    """The walk over the jumps, unrolled; checksums by the table of the polynomial 0xEDB88320."""
    table = list(range(256))
    for _ in range(8):
        table = [c >> 1 ^ 0xEDB88320 if c & 1 else c >> 1 for c in table]
    walk = ", ".join(f"""
w{i + 1} AS (SELECT doc_id, size, text_crc32, CASE WHEN j < 8 THEN j ELSE a END AS a, CASE WHEN j < 9 THEN j ELSE b END AS b, s AS state,
  CASE WHEN j >= 9 THEN j ELSE CAST(floor((j + 1) * (2147483648.0::DOUBLE / ((s // 8589934592) + 1)::DOUBLE)) AS BIGINT) END AS j
  FROM (SELECT *, (state * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS s FROM w{i}))""" for i in range(9))
    return f"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS u FROM documents),
w0 AS (SELECT doc_id, CAST(len(u) + 1 AS BIGINT) AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, u),
    lambda c, x: xor(c >> 8, list_extract({table}::BIGINT[], (xor(c, x) & 255) + 1))), 4294967295::BIGINT) AS text_crc32,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS HUGEINT) AS state, 0::BIGINT AS j, 0::BIGINT AS a, 0::BIGINT AS b FROM d),{walk}
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(a AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY a ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(b AS INTEGER) AS grown_shard FROM w9"""


ORACLE["op11_sharding"] = _op11_sql()


@query("op11_sharding")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frauddeck.llm.sharding import LAW, shard_documents
    return shard_documents(C.read(spark, sf_dir, "documents"), 8).selectExpr("doc_id", "size", "text_crc32", f"'{LAW}' as law", "shard", "slot", "grown_shard")


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frauddeck.llm import whitening as W
    rows = C.read(spark, sf_dir, "embeddings")
    return W.transform(rows, W.fit(rows, "embedding"), "vec_id", "embedding")


ORACLE["op13_hard_negatives"] = """
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS arid, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY arid ORDER BY score DESC, id) AS pr FROM s WHERE same QUALIFY pr <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.arid, p.pr ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.arid = p.arid AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""


@query("op13_hard_negatives")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from frauddeck.llm import hard_negatives as H
    rows = C.read(spark, sf_dir, "embeddings").selectExpr("vec_id", "embedding", "case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label")
    return H.mine(H.build(rows), spark, F.col("id") % 100 == 0)

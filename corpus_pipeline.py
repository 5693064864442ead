"""Training-data pipeline over ``documents``: quality, near copies, benchmark passages, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as
the next one's ``docs``. All but the last return the columns of ``docs``, whatever these are
besides ``doc_id`` and ``text``. ``run`` writes the steps to the shared checkpoint folder.

* ``quality``: documents that the quality classifier rejects go. It learns from ``labels`` and
  the texts of ``documents`` in ``sf_dir`` that are still there, but for a held-out quarter.
* ``near_duplicates``: of documents whose fingerprints are linked, the one with the smallest id
  stays (of rows that share that id, the one whose text has the smallest hash).
* ``decontaminate``: documents that hold a benchmark window go.
* ``secrets``: secrets in texts are replaced by a mark; ``n_chars`` follows.
* ``pack``: the tokens of all remaining documents, packed into sequences.

Empty tables give empty results; null texts are empty texts that no stage but the first and the
second may drop; null ids come last among near copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frauddeck.llm import common as C
from frauddeck.llm import decontaminate as D
from frauddeck.llm import packing as P
from frauddeck.llm import quality_classifier as Q
from frauddeck.llm import secrets as S
from frauddeck.llm import simhash as H

TOKENIZER = "byte_bpe_50k.json"


def _with(docs: DataFrame, judged: DataFrame, n: int, keep: str) -> DataFrame:
    """The columns of ``docs`` of the rows that satisfy ``keep``; ``judged`` has n columns more."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    kept = judged.toDF(*names, *judged.columns[-n:]).where(keep)
    return kept.select(*[F.col(x).alias(c) for x, c in zip(names, docs.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = Q.fit(docs, C.read(spark, sf_dir, "labels"), C.fold("doc_id", 4) != 2)
    return _with(docs, Q.score(docs, model, passed=docs.columns), 2, "predicted = 1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a row is told by its id and a hash of its text; only these meet in the components
    marked = docs.select("doc_id", "text").withColumn("of", F.xxhash64("text"))
    found = C.written(H.near_duplicates(marked, shingle=3, radius=2, passed=["doc_id", "of"]))
    group = F.coalesce(F.col("component_id").cast("string"), F.col("fingerprint"))
    row = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("of"))
    stay = found.groupBy(group.alias("g"), F.col("component_id").isNull().alias("n")).agg(F.min(row).alias("r")).select("r.id", "r.of")
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    doc_id, of = rows[names[docs.columns.index("doc_id")]], F.xxhash64(rows[names[docs.columns.index("text")]])
    kept = rows.join(stay, doc_id.eqNullSafe(F.col("id")) & (of == F.col("of")), "left_semi")
    if found.groupBy("doc_id", "of").count().where("count > 1").head(1):  # rows that repeat an id and its text
        kept = kept.withColumn("h", F.xxhash64(names[docs.columns.index("text")])).dropDuplicates([names[docs.columns.index("doc_id")], "h"])
    return kept.select(*[F.col(x).alias(c) for x, c in zip(names, docs.columns)])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with(docs, D.decontaminate(docs, C.read(spark, sf_dir, "benchmark"), passed=docs.columns), 5, "not contaminated")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return S.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return P.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("pack", pack)]

#: No SQL: trained scores, fingerprints and subword tokens; tests hold it against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = C.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = C.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

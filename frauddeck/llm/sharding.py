"""Shards by jump consistent hashing: a stable key and the number of shards decide, without a ring table.

A key seeds a generator of 64-bit numbers; each number tells at which larger number of shards
the key jumps next. The last jump below ``n`` is its shard among ``n``. With one shard more, a
key either stays or goes to the new shard, so about one row in ``n + 1`` moves.

All of it is column expressions. The generator multiplies modulo 2^64 in decimals (integers
would overflow); both shard numbers come of one walk over the jumps. Slots number a shard's
rows in the order of key, checksum and size: narrow rows are range-partitioned in that order
(ties by place, so a key that repeats is split as well), cut from their lineage in the shared
checkpoint folder, and a table of one row for each shard in each range gives the rows before.

Defined results: a null key is an empty one, so all rows without a key share a shard (the law
asks for it; their slots still come from many ranges). A null or empty text has size 1 and
checksum 0. Repeated rows get the same shard and slots of their own. An empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frauddeck.session import ensure_checkpoint_dir

LAW = "key"
#: Multiplier of the generator of the published algorithm (fixed value), and its range.
MULTIPLIER, RANGE = 2862933555777941757, 1 << 64


def stable_key(of: Column) -> Column:
    """A 64-bit number that only the text of a value decides: the first half of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(of.cast("string"), F.lit("")).cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")


def _decimal(x: int) -> Column:
    return F.lit(str(x)).cast("decimal(20,0)")


def jump_shards(key: Column, counts: list[int]) -> Column:
    """The shards of a 64-bit key (as a decimal) among each of ``counts`` shards: an array of ints.

    A step costs a multiplication as long as the next jump is below the largest count; there
    are about ln(count) such steps, and never more than that count.
    """
    most = max(counts)
    start = F.struct(key.alias("state"), F.lit(0).cast("long").alias("jump"), F.array(*[F.lit(0)] * len(counts)).alias("at"))

    def step(acc: Column, _: Column) -> Column:
        state = (acc["state"] * _decimal(MULTIPLIER) + _decimal(1)) % _decimal(RANGE)
        top = F.call_function("div", state, _decimal(1 << 33))  # the highest 31 bits
        jump = F.floor((acc["jump"] + 1) * (F.lit(float(1 << 31)) / (top + 1).cast("double")))
        at = F.array(*[F.when(acc["jump"] < n, acc["jump"].cast("int")).otherwise(acc["at"][i]) for i, n in enumerate(counts)])
        return F.when(acc["jump"] >= most, acc).otherwise(F.struct(state.cast("decimal(20,0)").alias("state"), jump.alias("jump"), at.alias("at")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(most)), start, step, lambda acc: acc["at"])


def shard_documents(docs: DataFrame, shards: int = 8, *, key: str = "doc_id") -> DataFrame:
    """``(key, size, text_crc32, shard, slot, grown_shard)`` of every row of ``docs``.

    ``grown_shard`` is the shard among ``shards + 1``; ``slot`` runs from 0 in each shard.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("k"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       jump_shards(stable_key(F.col(key)), [shards, shards + 1]).alias("at"))
    rows = rows.select("k", "size", "text_crc32", F.col("at")[0].alias("shard"), F.col("at")[1].alias("grown_shard"))
    order = ["shard", F.col("k").asc_nulls_first(), "text_crc32", "size"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(n, *order, "place").sortWithinPartitions(*order)
              .drop("place").withColumn("place", F.monotonically_increasing_id()).checkpoint())
    part = F.shiftright("place", 33)
    ranges = placed.groupBy(part.alias("part"), "shard").agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most a row for each range and one more for each shard
    ranges = ranges.select("part", "shard", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    out = placed.withColumn("part", part).join(F.broadcast(ranges), ["part", "shard"])
    return out.select(F.col("k").alias(key), "size", "text_crc32", "shard", (F.col("place") + F.col("shift")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 8, *, key: str = "doc_id") -> None:
    """The rows of ``docs`` with all their columns, as Parquet folders ``path/shard=N``.

    Each task writes its own rows to the folders, so no shard is gathered in one task. A column
    of that name gives way to the folder's.
    """
    kept = [c for c in docs.columns if c.lower() != "shard"]
    docs.select(*[F.col(f"`{c}`") for c in kept], jump_shards(stable_key(F.col(f"`{key}`")), [shards])[0].alias("shard")).write.partitionBy("shard").parquet(path)

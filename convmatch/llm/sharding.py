"""Sharding by jump consistent hashing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns

def _big(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


#: Multiplier of the linear congruential step of jump consistent hashing (fixed value).
_STEP = 2862933555777941757


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0..shards-1 of a long ``key`` by jump consistent hashing (int).

    The generator's state is an unsigned 64-bit number, kept as decimal(38,0) because its
    product (below 2**126) fits there without overflow.  The jumps past the last shard are
    not evaluated, so a key takes about ln(shards) steps.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    unsigned = F.pmod(key.cast("decimal(38,0)"), _big(2**64)).cast("decimal(38,0)")
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), unsigned.alias("k"))

    def jump(s: Column, _: Column) -> Column:
        k = F.pmod((s["k"] * _big(_STEP) + 1).cast("decimal(38,0)"), _big(2**64)).cast("decimal(38,0)")
        high = ((k - F.pmod(k, _big(2**33))) / _big(2**33)).cast("double")  # k >> 33, exact
        nxt = F.floor((s["j"] + 1).cast("double") * (F.lit(float(2**31)) / (high + 1))).cast("long")
        return F.when(s["j"] < shards, F.struct(s["j"].alias("b"), nxt.alias("j"), k.alias("k"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump)["b"].cast("int")


def shard_documents(docs: DataFrame, shards: int = 16, rows_per_block: int = 100_000) -> DataFrame:
    """Every row's shard under the law ``key``, and a gapless slot in that shard.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot and
    grown_shard, the shard after one more has been appended (it is either ``shard`` or the
    new one).  doc_id and the shard count alone decide.  Slots follow (block, doc_id, crc32,
    size), where a block is a hash class of doc_id: the rows of a shard are numbered block by
    block, and only the blocks' counts meet, so no task holds a whole shard.

    Null doc_id counts as the key 0; null text has size 1 and crc32 null; repeated rows get
    slots of their own; very long texts are measured whole; other columns are not read; an empty
    table gives no rows.
    """
    rows = columns(docs, "doc_id", "text").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
    )
    blocks = max(1, -(-docs.count() // (shards * rows_per_block)))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    rows = rows.select(
        "*",
        jump_shard(key, shards).alias("shard"),
        jump_shard(key, shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"),
    )
    counts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("place", F.row_number().over(place))
        .join(offsets, ["shard", "block"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("before") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard",
        )
    )

"""Sharding, native: jump consistent hashing (Lamping and Veach, 2014) of a stable key.

The shard follows from the key and the number of shards alone, without a ring table; one more shard takes rows only into
itself. The key is the first 64 bits of the MD5 of the id's text, so ids that follow one another spread evenly.

Defined results: a null id has the key of the empty text; null text has no bytes; rows that repeat an id share its shard
and are told apart by checksum and size; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.frames import docs
from cohortlens.session import stored

col, lit = F.col, F.lit

#: Fixed values of the published algorithm: the generator's factor and the sizes of its state and output.
FACTOR, STATE, HALF = 2862933555777941757, 1 << 64, 1 << 33


def stable_key(id_: str | Column) -> Column:
    text = F.coalesce((col(id_) if isinstance(id_, str) else id_).cast("string"), lit(""))
    return F.conv(F.substring(F.md5(text), 1, 16), 16, 10).cast("decimal(20,0)")


def jump_hash(key: str, shards: int) -> Column:
    """Shard of an unsigned 64-bit ``key`` (SQL expression, decimal). Every jump goes forward, so ``shards`` steps always
    suffice; steps after the last jump only pass the state on."""
    state = lambda k, b, j: f"named_struct('key', {k}, 'b', {b}, 'j', {j})"
    number = f"cast(pmod(s.key * {FACTOR} + 1, {STATE}) AS decimal(20,0))"
    jump = f"cast(floor((s.j + 1) * (cast({1 << 31} AS double) / cast(k div {HALF} + 1 AS double))) AS bigint)"
    step = f"if(s.j >= {shards}, s, transform(array({number}), k -> {state('k', 's.j', jump)})[0])"
    return F.expr(f"aggregate(sequence(1, {shards}), {state(key, '-1L', '0L')}, (s, i) -> {step}, s -> cast(s.b AS int))")


def with_slots(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Add ``slot``: the place of a row among its shard's rows in the given order, without gaps from 0.

    Rows are dealt by ranges of the order, numbered within (shard, range), and moved up by the counts of earlier ranges,
    so no task holds a whole shard. The ranges are written once, as both readers must see the same ones.
    """
    ranged = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "slots")
    counts = ranged.groupBy(shard, "_range").agg(F.count(lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "_range", F.coalesce(F.sum("_n").over(before), lit(0)).alias("_start"))
    within = Window.partitionBy(shard, "_range").orderBy(*order)
    return ranged.withColumn("_rank", F.row_number().over(within)).join(starts, [shard, "_range"]).withColumn(
        "slot", col("_start") + col("_rank") - 1).drop("_range", "_rank", "_start")


def shard_documents(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, one row per row of ``df``.

    ``size`` is the text's UTF-8 bytes plus one, ``grown_shard`` the shard with one more shard.
    """
    rows = docs(df, id_col, text_col).withColumn("_key", stable_key("doc_id")).select(
        "doc_id", (F.octet_length("text") + lit(1)).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), lit("key").alias("law"),
        jump_hash("_key", shards).alias("shard"), jump_hash("_key", shards + 1).alias("grown_shard"))
    return with_slots(rows, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

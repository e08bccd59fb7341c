"""Exact duplicates, native: heavy-hitter split.

Misra-Gries counters (``DataFrame.freqItems``) name every digest that may hold more than ``support`` of the rows; at most
1/support of them. Those are counted exactly, and the ones that do repeat, with their winners, are broadcast, so rows of
large groups are decided where they are read. All other digests are counted with their winners by an ordinary aggregate,
combined before its shuffle, and joined back: no task has to hold a group, and a join partition that comes out large can be split.

Defined results: null text counts as empty; texts without any character but whitespace are equal to each other; a null id
comes after all others when ties are broken; rows that repeat the winner's id and length are the same document and are
all kept; a very long text is hashed and counted where it is read, and only its hash and length go on; an empty table
gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.frames import WS, docs
from cohortlens.session import stored

col, lit = F.col, F.lit


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 1 / 1024) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row per row of ``df``.

    Texts are equal when identical without whitespace. The one with most code points, then the smallest id, stays.
    """
    narrow = stored(docs(df, id_col, text_col).select(
        "doc_id", F.sha2(F.translate("text", WS, ""), 256).alias("digest"), F.char_length("text").alias("n")), "exact")
    best = F.min(F.struct((-col("n")).alias("n"), col("doc_id").isNull().alias("no_id"), "doc_id"))
    frequent = narrow.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    # At most 1/support rows of 64 characters each, whatever the input.
    heavy = stored(
        narrow.join(F.broadcast(frequent), "digest").groupBy("digest").agg(best.alias("best"), F.count(lit(1)).alias("group_size"))
        .where(col("group_size") > 1), "exact-heavy")
    split = narrow.join(F.broadcast(heavy), "digest", "left")
    large = split.where(col("group_size").isNotNull()).select(
        "doc_id", "digest", "n", col("best.doc_id").alias("keep_id"), (-col("best.n")).alias("keep_n"), "group_size")
    few = split.where(col("group_size").isNull()).select("doc_id", "digest", "n")
    winners = few.groupBy("digest").agg(best.alias("best"), F.count(lit(1)).alias("group_size"))
    rest = few.join(winners, "digest").select(
        "doc_id", "digest", "n", col("best.doc_id").alias("keep_id"), (-col("best.n")).alias("keep_n"), "group_size")
    return large.unionByName(rest).select(
        "doc_id", "keep_id", "group_size",
        (col("doc_id").eqNullSafe(col("keep_id")) & (col("n") == col("keep_n"))).alias("kept"), col("digest").alias("text_sha256"))

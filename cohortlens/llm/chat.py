"""Chat formatting, native: collapse of cumulative snapshots, then rendering.

A log that stores a conversation after each turn holds every prefix of it. Each turn, with its place, has a 128-bit hash
(four sums of 32 bits); their running sums along a conversation are the hashes of its prefixes. A conversation whose whole
hash is some longer conversation's prefix hash is dropped by an anti-join, copies of one conversation are one group, and
only what is left is rendered.

No step holds a whole conversation in one task: turns are dealt by ranges of (conversation, turn), numbered and summed
within (conversation, range) and moved up by the totals of earlier ranges, and text is rendered in parts of
``PART`` turns, one row each.

Defined results: turns are ordered by turn number (null last), role, text; the number itself plays no part in what is
equal; null role or text count as empty; rows repeated in full are one turn; a null conversation id is one conversation;
of equal conversations the smallest id stays (null last); an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import stored

col, lit = F.col, F.lit

PART = 64
SUMS = ["s0", "s1", "s2", "s3"]
CONV, BLOCK = ["no_conv", "conv_id"], ["no_conv", "conv_id", "block"]


def ordered_turns(df: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """``no_conv, conv_id, block, pos, role, text``: distinct turns with their place from 1. Written once."""
    turns = df.select(
        col(conv_col).isNull().alias("no_conv"), col(conv_col).alias("conv_id"), col(turn_col).isNull().alias("no_turn"), col(turn_col).alias("turn"),
        F.coalesce(role_col, lit("")).alias("role"), F.coalesce(text_col, lit("")).alias("text")).distinct()
    order = ["no_turn", "turn", "role", "text"]
    ranged = stored(turns.repartitionByRange(*CONV, *order).withColumn("block", F.spark_partition_id()), "chat-turns")
    return _moved(ranged, {"pos": F.row_number().over(Window.partitionBy(*BLOCK).orderBy(*order))}, {"pos": F.count(lit(1))}).select(
        *BLOCK, "pos", "role", "text")


def _moved(rows: DataFrame, within: dict, total: dict) -> DataFrame:
    """Columns of ``within`` (values along a block) plus the totals of the conversation's earlier blocks."""
    before = Window.partitionBy(*CONV).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*BLOCK).agg(*[v.alias(f"_{k}") for k, v in total.items()])
    starts = blocks.select(*[col(c).alias(f"_{c}") for c in BLOCK], *[F.coalesce(F.sum(f"_{k}").over(before), lit(0)).alias(f"_{k}") for k in total])
    out = rows.withColumns(within)
    on = out["conv_id"].eqNullSafe(starts["_conv_id"]) & (out["block"] == starts["_block"])
    return out.join(starts, on).withColumns({k: col(k) + col(f"_{k}") for k in within})


def maximal(turns: DataFrame) -> DataFrame:
    """``no_conv, conv_id, n_turns, n_copies``: one conversation per group of equal ones, none a prefix of a longer one."""
    a, b = F.xxhash64("pos", "role", "text"), F.xxhash64("text", "role", "pos", lit("turn"))
    half = lambda h: (h.bitwiseAND(lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))
    hashed = stored(turns.select(*BLOCK, "pos", *[h.alias(s) for h, s in zip([*half(a), *half(b)], SUMS, strict=True)]), "chat-hashes")
    along = Window.partitionBy(*BLOCK).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolling = _moved(hashed, {s: F.sum(s).over(along) for s in SUMS}, {s: F.sum(s) for s in SUMS})
    whole = hashed.groupBy(*CONV).agg(F.max("pos").alias("n_turns"), *[F.sum(s).alias(s) for s in SUMS])
    # A prefix with its own length as place may be a whole conversation; it absorbs only if its conversation goes on.
    ends = whole.select(col("conv_id").alias("_c"), col("n_turns"))
    proper = rolling.join(ends, rolling["conv_id"].eqNullSafe(ends["_c"])).where(col("pos") < col("n_turns")).select(
        col("pos").alias("n_turns"), *SUMS).distinct()
    groups = whole.groupBy("n_turns", *SUMS).agg(F.min(F.struct("no_conv", "conv_id")).alias("c"), F.count(lit(1)).alias("n_copies"))
    return groups.join(proper, ["n_turns", *SUMS], "left_anti").select("c.no_conv", "c.conv_id", "n_turns", "n_copies")


def render(turns: DataFrame, keep: DataFrame) -> DataFrame:
    """``conv_id, part, n_turns, n_copies, text``: the conversations of ``keep`` with role marks, ``PART`` turns a row.

    Marks inside a turn are broken up (``<|`` becomes ``< |``), so no text can pose as another turn.
    """
    clean = lambda c: F.replace(c, lit("<|"), lit("< |"))
    piece = F.concat(lit("<|im_start|>"), clean(col("role")), lit("\n"), clean(col("text")), lit("<|im_end|>\n"))
    k = keep.select(col("conv_id").alias("_c"), "n_turns", "n_copies")
    rows = turns.join(k, turns["conv_id"].eqNullSafe(k["_c"]))
    part = F.floor((col("pos") - 1) / PART).cast("long").alias("part")
    return rows.groupBy("conv_id", part, "n_turns", "n_copies").agg(
        F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))).alias("x")).select(
        "conv_id", "part", col("n_turns").cast("long").alias("n_turns"), "n_copies", F.array_join("x.piece", "").alias("text"))


def format_chats(df: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    turns = ordered_turns(df, conv_col, turn_col, role_col, text_col)
    return render(turns, maximal(turns))

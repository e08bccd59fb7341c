"""Exact ranks, quantiles and rolling windows that never put one key's rows into a single task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import stored

#: Rows of a block that one task puts in order, up to about twice as many by the chance of the samples.
BLOCK_ROWS = 100_000
#: Sampled rows for each block, and splitters that are broadcast at most; beyond, blocks get larger.
SAMPLES, SPLITTERS = 32, 1 << 20
#: Rows of a table of groups that is broadcast.
FEW_GROUPS = 10_000


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    """Join condition between ``keys`` and their renamed copies; null is equal to null."""
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & left[k].eqNullSafe(right[f"{prefix}{i}"])
    return on


def _renamed(keys: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(k).alias(f"{prefix}{i}") for i, k in enumerate(keys)]


def splitters(df: DataFrame, keys: Sequence[str], order: Sequence[Column], block: int = BLOCK_ROWS) -> DataFrame | None:
    """Equi-depth cuts: for each key with more rows than ``block`` allows, the ordered values that begin its blocks.

    A hash of a row's key and order chooses the sample, so the cuts are the same whenever they are made. Columns are the
    keys as ``_s0 …`` and the array ``_cuts``; None if no key is that large. Rows alike in key and order stay together.
    """
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    drawn = F.pmod(F.xxhash64(*keys, *order), F.lit(1 << 40)) < F.lit(min(1 << 40, (SAMPLES << 40) // block))
    sample = df.where(drawn).select(*_renamed(keys, "_s"), at.alias("_at"))
    names = [f"_s{i}" for i in range(len(keys))]
    per_key = sample.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (per_key[0] or 0) <= SAMPLES:
        return None
    every = SAMPLES * -(-per_key[1] // (SAMPLES * SPLITTERS))
    cuts = sample.groupBy(*names).agg(F.array_sort(F.collect_list("_at")).alias("_all")).select(
        *names, F.filter("_all", lambda x, i: (i + 1) % every == 0).alias("_cuts"))
    return stored(cuts.where(F.size("_cuts") > 0), "splitters")


def _bisect(cuts: Column, at: Column) -> Column:
    """How many of the ordered ``cuts`` are at most ``at``, by halving."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(cuts) + F.lit(1))).cast("int"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = (s["lo"] < s["hi"]) & (F.get(cuts, mid) <= at)
        return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"),
                        F.when(right | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi")), halve, lambda s: s["lo"])


def in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cuts: DataFrame) -> DataFrame:
    """``df`` with ``_bucket``: the number of the row's block along ``order``, -1 for keys that are not cut."""
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    d = df.withColumn("_at", at)
    # At most SPLITTERS values in all.
    d = d.join(F.broadcast(cuts), _same(d, cuts, keys, "_s"), "left")
    bucket = F.when(F.col("_cuts").isNull(), -1).otherwise(_bisect(F.col("_cuts"), F.col("_at")))
    return d.withColumn("_bucket", bucket.cast("long")).drop("_at", "_cuts", *[f"_s{i}" for i in range(len(keys))])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column | None = None, out: str = "pos",
             block: int = BLOCK_ROWS) -> DataFrame:
    """0-based position per key in ``order``.

    Rows are sorted per (key, bucket) only, and the bucket start positions come from one small aggregate. Buckets are
    equi-depth blocks of keys with many rows; other keys are one bucket, and cost one exchange. A ``bucket`` that the
    caller gives must not decrease along ``order``.
    """
    if bucket is None:
        cuts = splitters(df, keys, order, block)
        if cuts is None:
            return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
        d = in_blocks(df, keys, order, cuts)
        sizes = d.where(F.col("_bucket") >= 0)
    else:
        d = sizes = df.withColumn("_bucket", bucket)
    sizes = sizes.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *_renamed(keys, "_k"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    on = F.col("_bucket").eqNullSafe(F.col("_b")) & _same(d, starts, keys, "_k")
    w = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        d.join(starts, on, "left")
        .withColumn(out, F.row_number().over(w) - 1 + F.coalesce("_start", F.lit(0)))
        .drop("_bucket", "_b", "_start", *[f"_k{i}" for i in range(len(keys))])
    )


def rolling(df: DataFrame, keys: Sequence[str], pos: str, rows: int, aggs: Mapping[str, Column],
            block: int = BLOCK_ROWS) -> DataFrame:
    """Aggregates over the ``rows`` latest rows up to each row.

    Positions are cut into blocks; a block also receives the ``rows - 1`` rows before it, so every frame is
    complete inside its block and a hot key is spread over many tasks.
    """
    block = max(block, rows)
    own = F.floor(F.col(pos) / block)
    tail = F.col(pos) % block >= block - (rows - 1)
    spread = df.withColumn("_own", own).withColumn(
        "_block", F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(-(rows - 1), 0)
    out = spread.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
    return out.where(F.col("_block") == F.col("_own")).drop("_block", "_own")


def trailing(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows: int, aggs: Mapping[str, Column],
             block: int = BLOCK_ROWS) -> DataFrame:
    """Position ``pos`` of each row, and aggregates over the ``rows`` latest rows up to it, per key in ``order``.

    Without a key of many rows, one exchange serves both; else the rows of such keys are numbered and cut into blocks.
    """
    cuts = splitters(df, keys, order, block)
    if cuts is not None:
        return rolling(numbered(df, keys, order, block=block), keys, "pos", rows, aggs, block=block)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.select("*", (F.row_number().over(w).cast("long") - 1).alias("pos"), *[a.over(w.rowsBetween(-(rows - 1), 0)).alias(n) for n, a in aggs.items()])


def exact_quantiles(df: DataFrame, value: str, probs: Mapping[str, float], groups: Sequence[str] = (), buckets: int = 256,
                    fit: int = BLOCK_ROWS, weight: str | None = None) -> DataFrame:
    """Exact interpolated quantiles per group, one row per group with a column per name in ``probs``.

    Equal values are counted first. Then, by rounds: a sketch of bounded size cuts each value range into ``buckets``, their
    counts tell which hold a wanted rank, and only those are kept and cut again, until no range has more than ``fit``
    distinct values; these are put in order. Cut points steer the work, never the result. Nulls are left out; a group
    of nulls only has no row, and no group at all gives one row of nulls. With ``weight`` a row stands for that many rows.
    """
    g = list(groups)
    key = F.struct(*[F.col(k) for k in g]) if g else F.struct(F.lit(0).alias("_"))
    counts = df.where(F.col(value).isNotNull()).groupBy(key.alias("_g"), F.col(value).cast("double").alias("_v")).agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight).cast("long")).alias("_c")).where(F.col("_c") > 0)
    counts = stored(counts, "quantile-counts")

    def small(table: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(table) if rows <= FEW_GROUPS else table

    totals = counts.groupBy("_g").agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    largest, ranges = totals.agg(F.max("_rows"), F.count(F.lit(1))).first()
    # A grouping of one row each side of the join: the totals are repeated beside their values.
    part = counts.join(small(totals.select("_g", "_n"), ranges), "_g").select("_g", "_n", F.lit(0).cast("long").alias("_b"), F.lit(0).cast("long").alias("_start"), "_v", "_c")
    at = {n: (F.col("_n") - 1) * F.lit(p) for n, p in probs.items()}
    ranks = F.array(*[f(h).cast("long") for h in at.values() for f in (F.floor, F.ceil)])
    cut_at = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    while (largest or 0) > fit:
        cuts = part.groupBy("_g", "_b").agg(F.percentile_approx("_v", cut_at, 10000).alias("_cuts"))
        tagged = part.join(small(cuts, ranges), ["_g", "_b"]).withColumn("_s", F.size(F.filter("_cuts", lambda x: x < F.col("_v")))).drop("_cuts")
        upto = Window.partitionBy("_g", "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        sums = tagged.groupBy("_g", "_n", "_b", "_start", "_s").agg(F.sum("_c").alias("_sum"), F.count(F.lit(1)).alias("_rows")).withColumn(
            "_from", F.col("_start") + F.coalesce(F.sum("_sum").over(upto), F.lit(0)))
        holds = F.exists(ranks, lambda r: (r >= F.col("_from")) & (r < F.col("_from") + F.col("_sum")))
        kept = stored(sums.where(holds).select("_g", "_b", "_s", "_from", "_rows"), "quantile-ranges")
        largest, ranges = kept.agg(F.max("_rows"), F.count(F.lit(1))).first()
        part = stored(tagged.join(small(kept.drop("_rows"), ranges), ["_g", "_b", "_s"]).select(
            "_g", "_n", (F.col("_b") * buckets + F.col("_s")).alias("_b"), F.col("_from").alias("_start"), "_v", "_c"), "quantile-values")
    inside = Window.partitionBy("_g", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = part.withColumn("_end", F.col("_start") + F.sum("_c").over(inside))
    first, end = F.col("_end") - F.col("_c"), F.col("_end")
    picks, out = [F.max("_n").alias("_n")], []
    for n, h in at.items():
        for tag, r in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            picks.append(F.max(F.when((first <= r) & (r < end), F.col("_v"))).alias(f"_{n}_{tag}"))
        lo, hi = F.col(f"_{n}_lo"), F.col(f"_{n}_hi")
        out.append((lo + (hi - lo) * (h - F.floor(h))).alias(n))
    picked = ranked.groupBy(*(["_g"] if g else [])).agg(*picks)
    return picked.select(*[F.col(f"_g.{k}").alias(k) for k in g], *out)


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column | None,
                sums: Mapping[str, Column], block: int = BLOCK_ROWS) -> DataFrame:
    """Running sums per key in ``order``, split by ``bucket`` or equi-depth blocks like :func:`numbered`.

    Each (key, bucket) is summed on its own and lifted by the totals of the buckets before it.
    """
    if bucket is None:
        cuts = splitters(df, keys, order, block)
        if cuts is None:
            w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
            return df.select("*", *[F.sum(c).over(w).alias(n) for n, c in sums.items()])
        d = in_blocks(df, keys, order, cuts)
    else:
        d = df.withColumn("_bucket", bucket)
    totals = d.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums.values())])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"),
        *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_s{i}") for i in range(len(sums))])
    on = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = d.join(starts, on, "inner")
    for i, (n, c) in enumerate(sums.items()):
        out = out.withColumn(n, F.col(f"_s{i}") + F.sum(c).over(inside))
    return out.drop("_bucket", "_b", *[f"_k{i}" for i in range(len(keys))], *[f"_s{i}" for i in range(len(sums))])

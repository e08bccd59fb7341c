"""Window shapes. Row windows over raw tables run in blocks, see ``functions.ranking``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.ranking import trailing

col, lit = F.col, F.lit


def with_key_count(df: DataFrame, key: str, out: str = "key_count") -> DataFrame:
    """``COUNT(*) OVER (PARTITION BY key)``: counts are aggregated first and joined back, so no key is sorted whole."""
    sizes = df.where(col(key).isNotNull()).groupBy(key).agg(F.count(lit(1)).alias(out))
    nulls = df.where(col(key).isNull())
    known = df.where(col(key).isNotNull()).join(sizes, key)
    null_count = nulls.agg(F.count(lit(1)).alias(out))
    return known.unionByName(nulls.join(F.broadcast(null_count)))


def moving_averages(df: DataFrame, date: str, value: str, spans: Sequence[int] = (7, 30)) -> DataFrame:
    """Means over the last n rows of a daily series, NULL until n rows exist. One row per day, so one task suffices."""
    w = Window.orderBy(date)
    rn = F.row_number().over(w)
    return df.select("*", *[
        F.when(rn >= n, F.avg(value).over(w.rowsBetween(-(n - 1), 0))).alias(f"ma_{n}") for n in spans])


def monthly_counts(df: DataFrame, key: str, date: str) -> DataFrame:
    return df.groupBy(key, F.trunc(date, "month").alias("month")).agg(F.count(lit(1)).alias("monthly_count"))


def monthly_with_stats(df: DataFrame, key: str, date: str) -> DataFrame:
    """Month counts with the mean and sample deviation over the months of the key."""
    w = Window.partitionBy(key)
    return monthly_counts(df, key, date).select(
        "*", F.avg("monthly_count").over(w).alias("avg_monthly"), F.stddev("monthly_count").over(w).alias("std_monthly"))


def monthly_with_rolling(df: DataFrame, key: str, date: str) -> DataFrame:
    """Month counts with the previous month and the mean over up to twelve months."""
    w = Window.partitionBy(key).orderBy("month")
    return monthly_counts(df, key, date).select(
        "*", F.lag("monthly_count").over(w).alias("prev_count"),
        F.avg("monthly_count").over(w.rowsBetween(-11, 0)).alias("rolling_avg"))


def last_calls(df: DataFrame, key: str, ts: str, tie: str, duration: str, error: str, n: int = 100,
               slow_seconds: float = 5.0, block: int = 100_000) -> DataFrame:
    """Failure %, slow % and mean duration over the last ``n`` calls of a key, at every call."""
    out = trailing(df, [key], [col(ts), col(tie)], n, {
        "failure_rate": F.avg(col(error).cast("int")),
        "slow_rate": F.avg((col(duration) >= slow_seconds).cast("int")),
        "mean_duration": F.avg(duration),
    }, block=block)
    return out.withColumns({c: col(c) * 100 for c in ("failure_rate", "slow_rate")})


def centred_average_4(df: DataFrame, order: str, value: str) -> DataFrame:
    """2x4 centred moving average of a weekly series; NULL at both ends."""
    w = Window.orderBy(order)
    a, b = F.avg(value).over(w.rowsBetween(-2, 1)), F.avg(value).over(w.rowsBetween(-1, 2))
    full = (F.count(value).over(w.rowsBetween(-2, 1)) == 4) & (F.count(value).over(w.rowsBetween(-1, 2)) == 4)
    return df.select("*", F.when(full, (a + b) / 2).alias("trend"))


def latest_k(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """Newest ``k`` rows per key; Spark keeps k per task before the shuffle (window group limit)."""
    w = Window.partitionBy(key).orderBy(col(order).desc())
    return df.withColumn("rank", F.row_number().over(w)).where(col("rank") <= k)


def first_valid(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """First non-NULL value per key in ``order``."""
    return df.where(col(value).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias(value))

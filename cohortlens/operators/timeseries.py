"""Daily and weekly series of study counts: trend, decomposition, forecast.

Series have one row per day or week, so the windows below sort a few thousand rows at most, whatever the input size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.joins import date_spine

col, lit = F.col, F.lit


def daily_series(df: DataFrame, date: str, keys: Sequence[str] = ()) -> DataFrame:
    """``date, value`` for every day of the span, counts of 0 filled in."""
    return date_spine(df.where(col(date).isNotNull()).select(*keys, col(date).alias("date")), "date", F.count(lit(1)), tuple(keys))


def trend(series: DataFrame, min_points: int = 30) -> DataFrame:
    """Slope over the day number, direction, volatility, totals and the peak day; no row under ``min_points`` days."""
    start = series.agg(F.min("date").alias("_d0"))
    x = F.datediff("date", "_d0")
    row = series.join(F.broadcast(start)).agg(
        F.count(lit(1)).alias("days"), F.regr_slope("value", x).alias("slope"), (F.stddev_samp("value") / F.avg("value")).alias("volatility"),
        F.sum("value").alias("total"), F.avg("value").alias("daily_mean"),
        F.max_by("date", F.struct(col("value"), -x)).alias("peak_day"), F.max("value").alias("peak"))
    return row.where(col("days") >= min_points).withColumn("direction", F.when(col("slope") > 0, "increasing").otherwise("decreasing"))


def weekly(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Weekly sums; weeks end on Sunday. The daily series is complete, so empty weeks are 0."""
    return series.groupBy(*keys, F.next_day(F.date_sub("date", 1), "SUN").alias("week")).agg(F.sum("value").alias("value"))


def decompose(weeks: DataFrame, keys: Sequence[str] = (), period: int = 4, min_weeks: int = 24) -> DataFrame:
    """Additive decomposition: centred moving average, seasonal means by phase centred to 0, residual."""
    w = Window.partitionBy(*keys).orderBy("week")
    half = period // 2
    a, b = w.rowsBetween(-half, half - 1), w.rowsBetween(-half + 1, half)
    n = F.count(lit(1))
    full = (n.over(a) == period) & (n.over(b) == period)
    d = weeks.select(
        *keys, "week", "value", (F.row_number().over(w) - 1).alias("i"), n.over(Window.partitionBy(*keys)).alias("_n"),
        F.when(full, (F.avg("value").over(a) + F.avg("value").over(b)) / 2).alias("trend")).where(col("_n") >= min_weeks)
    phase = F.pmod(col("i"), lit(period)).alias("phase")
    means = d.groupBy(*keys, phase).agg(F.avg(col("value") - col("trend")).alias("m"))
    seasonal = means.withColumn("seasonal", col("m") - F.avg("m").over(Window.partitionBy(*keys))).drop("m")
    return d.select("*", phase).join(seasonal, [*keys, "phase"]).select(
        *keys, "week", "value", "trend", "seasonal", (col("value") - col("trend") - col("seasonal")).alias("residual"))


def forecast(weeks: DataFrame, keys: Sequence[str] = (), min_weeks: int = 20) -> DataFrame:
    """Holdout forecast of the last fifth by an AR(1) on differences, fitted by least squares on the first four fifths."""
    w = Window.partitionBy(*keys).orderBy("week")
    d = weeks.select(
        *keys, "week", "value", F.row_number().over(w).alias("i"), F.count(lit(1)).over(Window.partitionBy(*keys)).alias("n")).where(
        col("n") >= min_weeks)
    d = d.withColumn("train", F.floor(col("n") * 0.8)).withColumn("dx", col("value") - F.lag("value").over(w))
    d = d.withColumn("dprev", F.lag("dx").over(w))
    train = col("i") <= col("train")
    last = col("i") == col("train")
    fit = d.groupBy(*keys).agg(
        F.regr_slope(F.when(train, col("dx")), F.when(train, col("dprev"))).alias("phi"),
        F.regr_intercept(F.when(train, col("dx")), F.when(train, col("dprev"))).alias("c"),
        F.max(F.when(last, col("value"))).alias("x_last"), F.max(F.when(last, col("dx"))).alias("d_last"))
    joined = d.where(~train).join(fit, list(keys)) if keys else d.where(~train).join(F.broadcast(fit))
    h, phi = col("i") - col("train"), col("phi")
    mu = col("c") / (1 - phi)
    guess = col("x_last") + h * mu + (col("d_last") - mu) * phi * (1 - F.pow(phi, h)) / (1 - phi)
    return joined.select(*keys, "week", "value", guess.alias("forecast"))


def forecast_errors(fc: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    e = col("value") - col("forecast")
    return fc.groupBy(*keys).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.count(lit(1)).alias("steps"))

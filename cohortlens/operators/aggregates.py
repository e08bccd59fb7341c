"""Aggregations and top-k shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.ranking import exact_quantiles

col, lit = F.col, F.lit


def value_counts(df: DataFrame, c: str, top_n: int | None = None) -> DataFrame:
    """Counts of the non-NULL values, largest first, ties by value."""
    out = df.where(col(c).isNotNull()).groupBy(c).agg(F.count(lit(1)).alias("n")).orderBy(col("n").desc(), col(c))
    return out if top_n is None else out.limit(top_n)


def merged_top_counts(df: DataFrame, table: str, value: str, per_table: int = 10) -> DataFrame:
    """Sum over tables of each table's ``per_table`` most frequent values (counts outside a table's top are lost).

    The window ranks aggregated counts, so one partition holds a table's distinct values, not its rows; Spark
    limits the rank before the shuffle.
    """
    counts = df.where(col(value).isNotNull()).groupBy(table, value).agg(F.count(lit(1)).alias("n"))
    w = Window.partitionBy(table).orderBy(col("n").desc(), col(value))
    kept = counts.withColumn("_r", F.row_number().over(w)).where(col("_r") <= per_table)
    return kept.groupBy(value).agg(F.sum("n").alias("n"))


def describe(df: DataFrame, value: str) -> DataFrame:
    """mean, median, both standard deviations, min, max, range of one numeric column."""
    base = df.agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std_sample"),
        F.stddev_pop(value).alias("std_population"), F.min(value).alias("min"), F.max(value).alias("max"),
        (F.max(value) - F.min(value)).alias("range"))
    med = exact_quantiles(df, value, {"median": 0.5})
    return base.join(F.broadcast(med))


def trimmed_mean(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean without the smallest and the largest value; needs three values."""
    n = F.count(value)
    return df.groupBy(*keys).agg(
        F.when(n > 2, (F.sum(value) - F.min(value) - F.max(value)) / (n - 2)).alias("trimmed_mean"), n.alias("n"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts in ``bins`` equal bins between the smallest and largest value; the last bin holds the maximum."""
    span = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    d = df.where(col(value).isNotNull()).select(col(value).cast("double").alias("_v")).join(F.broadcast(span))
    width = (col("_hi") - col("_lo")).cast("double") / bins
    bin_no = F.when(width == 0, 0).otherwise(F.least(F.floor((col("_v") - col("_lo")) / width), lit(bins - 1)))
    return d.groupBy(bin_no.cast("int").alias("bin"), col("_lo").cast("double").alias("lo"), width.alias("w")).agg(
        F.count(lit(1)).alias("n")).select(
        "bin", (col("lo") + col("bin") * col("w")).alias("bin_start"), (col("lo") + (col("bin") + 1) * col("w")).alias("bin_end"), "n")


def pivot_mean(df: DataFrame, row: str, column: str, value: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean of ``value`` by row and column value, 0 where there is none. Without ``columns`` every value of the data gets a
    column; Spark raises an error above ``spark.sql.pivotMaxValues`` of them."""
    g = df.groupBy(row)
    return (g.pivot(column) if columns is None else g.pivot(column, list(columns))).agg(F.avg(value)).fillna(0)


def percent_where(conditions: dict[str, Column]) -> list[Column]:
    return [(F.avg(c.cast("int")) * 100).alias(n) for n, c in conditions.items()]


def joined_values(df: DataFrame, key: str, value: str, label: str | None = None, sep: str = "; ", chunk: int = 10_000) -> DataFrame:
    """Texts of the distinct values of a key, each sorted, with the number of values of the key.

    A key with more than ``chunk`` values gives several parts, so no task and no text grows with a hot key and no
    value is lost; other keys have part 0 only. ``label`` is the text shown for a value (the value itself by default).
    """
    shown = label or value
    d = df.select(key, value, *([label] if label else [])).where(col(value).isNotNull()).distinct()
    sizes = d.groupBy(key).agg(F.count(lit(1)).alias("n_values"))
    part = F.pmod(F.xxhash64(value), F.ceil(col("n_values") / chunk)).cast("int")
    return d.join(sizes, key).groupBy(key, part.alias("part"), "n_values").agg(
        F.concat_ws(sep, F.sort_array(F.collect_list(shown))).alias("values_text"))


def top_k(df: DataFrame, value: str, k: int, key: str, largest: bool = True) -> DataFrame:
    order = col(value).desc() if largest else col(value).asc()
    return df.orderBy(order, col(key)).limit(k)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct().agg(F.count(lit(1)).alias("distinct_rows"))

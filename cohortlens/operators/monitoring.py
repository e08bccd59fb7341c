"""Analytics over metric, call and alert logs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.ranking import BLOCK_ROWS, in_blocks, numbered, prefix_sums, splitters, trailing
from cohortlens.session import stored

col, lit = F.col, F.lit

# Targets of the monitored system.
TARGETS = {"query_seconds": 5.0, "cache_hit_rate": 0.8, "cpu_percent": 70.0, "memory_mb": 512.0, "error_rate": 0.05, "health_score": 85.0}
# Alert rules (name, component, metric, operator, threshold, severity, cooldown minutes).
ALERT_RULES = (
    ("CPU_HIGH", "system", "cpu_percent", ">", 80.0, "HIGH", 15),
    ("MEMORY_HIGH", "system", "memory_percent", ">", 85.0, "HIGH", 15),
    ("DISK_LOW", "system", "disk_free_gb", "<", 5.0, "CRITICAL", 30),
    ("QUERY_SLOW", "database", "avg_query_time_ms", ">", 100.0, "MEDIUM", 10),
    ("CONTAINER_DOWN", "container", "container_count", "<", 3.0, "CRITICAL", 5),
    ("ERROR_RATE_HIGH", "application", "error_rate_percent", ">", 5.0, "HIGH", 10),
)
RULE_SCHEMA = "rule string, component string, metric string, operator string, threshold double, severity string, cooldown_minutes int"
# Minutes until each escalation level, and the width of equality.
ESCALATION_DELAYS = (5, 15, 30, 60)
TOLERANCE = 0.001


def since(c: Column, asof: dt.datetime, hours: float) -> Column:
    return c > lit(asof - dt.timedelta(hours=hours))


def metric_summary(log: DataFrame, asof: dt.datetime, hours: float = 24) -> DataFrame:
    return log.where(since(col("ts"), asof, hours)).agg(
        F.avg("query_time_ms").alias("avg_query_time_ms"), F.avg("cache_hit_rate").alias("avg_cache_hit_rate"),
        F.avg("cpu_percent").alias("avg_cpu_percent"), F.avg("memory_mb").alias("avg_memory_mb"),
        F.avg("health_score").alias("avg_health_score"), F.max("query_time_ms").alias("max_query_time_ms"),
        F.min("health_score").alias("min_health_score"), F.count(lit(1)).alias("measurements"))


def open_alerts(alerts: DataFrame, asof: dt.datetime, hours: float = 24) -> DataFrame:
    return alerts.where(since(col("ts"), asof, hours) & ~col("resolved")).groupBy("alert_type", "severity").agg(
        F.count(lit(1)).alias("n"))


def health_score(query_seconds: Column, hit_rate: Column, cpu: Column, memory_mb: Column, error_rate: Column,
                 t: Mapping[str, float] = TARGETS) -> Column:
    """100 minus capped penalties for slow queries, misses, processor, memory and errors; never below 0."""
    over = lambda c, limit, penalty, cap: F.when(c > limit, F.least(lit(float(cap)), penalty)).otherwise(0.0)
    q, h = t["query_seconds"], t["cache_hit_rate"]
    # Factor and cap of each penalty.
    score = (
        lit(100.0) - over(query_seconds, q, (query_seconds / q - 1) * 20, 30)
        - F.when(hit_rate < h, F.least(lit(20.0), (lit(h) - hit_rate) * 50)).otherwise(0.0)
        - over(cpu, t["cpu_percent"], (cpu - t["cpu_percent"]) / 30 * 15, 15)
        - over(memory_mb, t["memory_mb"], (memory_mb - t["memory_mb"]) / t["memory_mb"] * 10, 10)
        - over(error_rate, t["error_rate"], (error_rate - t["error_rate"]) * 100, 25))
    return F.greatest(lit(0.0), score)


def baseline_comparison(log: DataFrame, asof: dt.datetime, baseline: Mapping[str, float], hours: float = 24,
                        long_hours: float = 168) -> DataFrame:
    """Recent means against a baseline (in %, or points for rates) and the one-day against seven-day query trend."""
    recent = since(col("ts"), asof, hours)
    row = log.where(since(col("ts"), asof, long_hours)).agg(
        F.avg(F.when(recent, col("query_time_ms"))).alias("q1"), F.avg("query_time_ms").alias("q7"),
        F.avg(F.when(recent, col("cache_hit_rate"))).alias("c1"), F.avg(F.when(recent, col("health_score"))).alias("h1"))
    bq = baseline["query_time_ms"]
    change = (col("q1") - bq) / bq * 100 if bq > 0 else lit(0.0)
    trend = F.when(col("q7") > 0, (col("q1") - col("q7")) / col("q7") * 100).otherwise(0.0)
    return row.select(
        col("q1").alias("query_time_ms"), change.alias("query_change_pct"), (col("c1") - baseline["cache_hit_rate"]).alias("cache_change"),
        (col("h1") - baseline["health_score"]).alias("health_change"), trend.alias("query_trend_pct"), (trend > 20).alias("degrading"))


def bottlenecks(summary: DataFrame, t: Mapping[str, float] = TARGETS) -> DataFrame:
    """Metrics of a summary row that miss their target, with severity and impact, largest impact first."""
    q, c = col("avg_query_time_ms"), col("avg_cache_hit_rate")
    cpu, mem = col("avg_cpu_percent"), col("avg_memory_mb")
    tq, tc = t["query_seconds"] * 1000, t["cache_hit_rate"] * 100
    item = lambda cond, kind, sev, value, target, impact: F.when(cond, F.struct(
        lit(kind).alias("type"), sev.alias("severity"), value.alias("current_value"), lit(float(target)).alias("target_value"),
        impact.alias("impact_score")))
    found = F.array(
        item(q > tq, "query_performance", F.when(q > tq * 2, "HIGH").otherwise("MEDIUM"), q, tq, q / tq * 10),
        item(c < tc, "cache_performance", lit("MEDIUM"), c, tc, (lit(tc) - c) / 10),
        item(cpu > t["cpu_percent"], "cpu_usage", F.when(cpu > 90, "HIGH").otherwise("MEDIUM"), cpu, t["cpu_percent"], cpu / t["cpu_percent"] * 8),
        item(mem > t["memory_mb"], "memory_usage", lit("MEDIUM"), mem, t["memory_mb"], mem / t["memory_mb"] * 6))
    return summary.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("b")).select("b.*").orderBy(col("impact_score").desc())


def effectiveness(history: DataFrame, kind: str, success: str, improvement: str, seconds: str) -> DataFrame:
    """Attempts, successes, success rate, improvement of successful attempts and their mean duration, per type."""
    ok = col(success)
    return history.groupBy(kind).agg(
        F.count(lit(1)).alias("attempts"), F.count_if(ok).alias("successes"), (F.avg(ok.cast("int")) * 100).alias("success_rate"),
        F.sum(F.when(ok, F.coalesce(improvement, lit(0.0))).otherwise(0.0)).alias("improvement"),
        (F.sum(F.when(ok, F.coalesce(seconds, lit(0.0))).otherwise(0.0)) / F.greatest(F.count_if(ok), lit(1))).alias("mean_seconds"))


def benchmark_statistics(runs: DataFrame, name: str, value: str, target: float, variance_pct: float = 20.0) -> DataFrame:
    """Per benchmark: mean, median, min, max, deviation, ratio to the target, pass and unstable flags."""
    from cohortlens.functions.ranking import exact_quantiles

    g = runs.groupBy(name).agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.coalesce(F.stddev_samp(value), lit(0.0)).alias("std"))
    med = exact_quantiles(runs, value, {"median": 0.5}, [name])
    ratio = col("mean") / target
    return g.join(med, name).withColumn("ratio", ratio).withColumn("passed", ratio <= 1 + variance_pct / 100).withColumn(
        "unstable", col("std") > col("mean") * 0.3)


def regressions(current: DataFrame, baseline: DataFrame, name: str, value: str, limit_pct: float = 10.0) -> DataFrame:
    """Benchmarks that moved by more than the limit against their baseline."""
    b = baseline.select(name, col(value).alias("baseline"))
    change = (col(value) - col("baseline")) / col("baseline") * 100
    return current.join(b, name).withColumn("change_percent", change).where(F.abs("change_percent") > limit_pct).withColumn(
        "direction", F.when(col("change_percent") > 0, "regression").otherwise("improvement"))


def timing_grade(seconds: Column) -> Column:
    return F.when(seconds < 0.1, "EXCELLENT").when(seconds < 0.5, "GOOD").when(seconds < 2.0, "ACCEPTABLE").when(
        seconds < 5.0, "NEEDS_IMPROVEMENT").otherwise("POOR")


def growth_forecast(samples: DataFrame, key: str, ts: str, value: str, limit: float, keep: int = 30, used: int = 7) -> DataFrame:
    """Growth per day over the newest samples of a key and the days left until the limit."""
    from cohortlens.operators.windows import latest_k

    rows = latest_k(samples.select(key, ts, value), key, ts, keep)
    recent = col("rank") <= used
    g = rows.groupBy(key).agg(
        F.count(lit(1)).alias("samples"), F.max_by(value, ts).alias("current"),
        ((F.max(F.when(recent, col(value))) - F.min(F.when(recent, col(value)))) / used).alias("growth_per_day"))
    left = F.when((col("growth_per_day") > 0) & (col("current") < limit), (lit(limit) - col("current")) / col("growth_per_day"))
    return g.where(col("samples") >= used).withColumn("days_to_limit", left)


def error_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    t = F.upper(text)
    return lines.agg(F.count(lit(1)).alias("lines"), F.count_if(F.contains(t, lit("ERROR"))).alias("errors"),
                     F.count_if(F.contains(t, lit("WARN"))).alias("warnings"))


def retained(log: DataFrame, asof: dt.datetime, days: int, resolved: str | None = None) -> DataFrame:
    """Rows to keep: newer than the limit, or (for alerts) not resolved."""
    keep = col("ts") >= lit(asof - dt.timedelta(days=days))
    return log.where(keep if resolved is None else keep | ~col(resolved))


def compare(value: Column, operator: Column, threshold: Column) -> Column:
    return (
        F.when(operator == ">", value > threshold).when(operator == "<", value < threshold)
        .when(operator == ">=", value >= threshold).when(operator == "<=", value <= threshold)
        .when(operator == "==", F.abs(value - threshold) < TOLERANCE).when(operator == "!=", F.abs(value - threshold) >= TOLERANCE)
        .otherwise(False))


def long_metrics(log: DataFrame, id_cols: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return log.unpivot(list(id_cols), list(metrics), "metric", "value")


def evaluate_rules(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Metric rows that meet a rule. Spark broadcasts the rules when their size is under its threshold."""
    return metrics.join(rules, "metric").where(compare(col("value"), col("operator"), col("threshold")))


def tiered(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """Critical before warning; ``limits``: metric, operator, warning, critical."""
    hit = lambda c: compare(col("value"), col("operator"), col(c))
    level = F.when(hit("critical"), "critical").when(hit("warning"), "warning")
    return metrics.join(limits, "metric").withColumn("level", level).where(col("level").isNotNull())


def flatten_json_metrics(df: DataFrame, text: str, ids: Sequence[str]) -> DataFrame:
    """Dotted name and number rows of a JSON object column; numeric lists give ``.avg``, ``.max`` and ``.min``.

    Nested objects are opened inside the row, one level more as long as some row still holds an object.
    """
    obj = "map<string,string>"
    pair = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    usable = lambda e: e["key"] != "timestamp"
    entries = F.transform(F.filter(F.map_entries(F.from_json(text, obj)), usable), lambda e: pair(e["key"], e["value"]))

    def opened(e: Column) -> Column:
        inner = F.transform(F.filter(F.map_entries(F.from_json(e["v"], obj)), usable), lambda f: pair(F.concat(e["k"], lit("."), f["key"]), f["value"]))
        return F.when(is_object(e), F.coalesce(inner, F.array().cast("array<struct<k:string,v:string>>"))).otherwise(F.array(e))

    is_object = lambda e: F.startswith(e["v"], lit("{"))
    while not df.where(F.exists(entries, is_object)).isEmpty():
        entries = F.flatten(F.transform(entries, opened))

    def numbers(e: Column) -> Column:
        a = F.from_json(e["v"], "array<double>")
        num = lambda k, v: F.struct(k.alias("name"), v.alias("value"))
        mean = F.aggregate(a, lit(0.0), lambda x, y: x + y) / F.size(a)
        stats = F.array(num(F.concat(e["k"], lit(".avg")), mean), num(F.concat(e["k"], lit(".max")), F.array_max(a)),
                        num(F.concat(e["k"], lit(".min")), F.array_min(a)))
        is_list = F.startswith(e["v"], lit("["))
        return F.when(is_list & (F.size(a) > 0), stats).when(~is_list, F.array(num(e["k"], e["v"].try_cast("double"))))

    rows = df.select(*ids, F.explode(F.flatten(F.filter(F.transform(entries, numbers), lambda x: x.isNotNull()))).alias("m"))
    return rows.select(*ids, "m.name", "m.value").where(col("value").isNotNull())


# --- event-time questions in batch form

def recent_call_stats(calls: DataFrame, window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Sliding call statistics; the same expression serves batch and stream input (``ts`` as timestamp)."""
    w = F.window("ts", window, slide)
    return calls.groupBy(w.alias("w")).agg(
        F.count(lit(1)).alias("total_queries"), F.avg("execution_time").alias("avg_execution_time"),
        F.count_if(col("execution_time") > 5.0).alias("slow_queries"), F.avg(col("error").cast("int")).alias("error_rate"),
        F.avg(col("cache_hit").cast("int")).alias("hit_rate")).select(
        col("w.start").alias("window_start"), col("w.end").alias("window_end"), "total_queries", "avg_execution_time", "slow_queries",
        "error_rate", "hit_rate")


def cooldown_emissions(hits: DataFrame, rule: str = "rule", ts: str = "ts", minutes: str = "cooldown_minutes",
                       block: int = BLOCK_ROWS) -> DataFrame:
    """Alerts that pass the cooldown: none of a rule within its minutes after the last emitted one.

    The choice is a chain through time: each hit leads to the first hit after its cooldown. Rules with many hits are cut
    into blocks of about ``block`` hits. In a block, hits whose chains leave it at the same time are one step; a step leads
    to the one that holds the first hit from that time on (an as-of join over the steps), and doubling the leads marks
    the steps that the rule's first hit reaches, in as many rounds as the number of blocks has bits. Blocks then emit their
    rows from the known entry. No task holds more than a block.
    """
    rows = hits.select(col(rule).alias("rule"), F.unix_micros(col(ts).cast("timestamp")).alias("us"),
                       (col(minutes).cast("bigint") * 60_000_000).alias("cool")).distinct()
    cuts = splitters(rows, ["rule"], [col("us")], block)
    if cuts is None:
        rows = rows.withColumn("seg", lit(0).cast("long"))
        entries = rows.select("rule", "seg").distinct().withColumn("entry", lit(-(1 << 63)).cast("long"))
    else:
        rows = stored(in_blocks(rows, ["rule"], [col("us")], cuts).withColumnRenamed("_bucket", "seg"), "cooldown-hits")
        entries = _entries(rows, block)

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["us"].to_numpy())
        cool, allowed, keep = int(pdf["cool"].iloc[0]), int(pdf["entry"].iloc[0]), []
        i = int(np.searchsorted(t, allowed, side="left"))
        while i < len(t):
            keep.append(t[i])
            i = int(np.searchsorted(t, t[i] + cool, side="left"))
        return pd.DataFrame({"rule": _named(pdf, len(keep)), "us": pd.Series(keep, dtype="int64")})

    known = entries.select(col("rule").alias("_r"), col("seg").alias("_q"), "entry")
    chosen = rows.join(known, rows["rule"].eqNullSafe(known["_r"]) & (col("seg") == col("_q"))).drop("_r", "_q").groupBy("rule", "seg").applyInPandas(
        emit, "rule string, us bigint")
    return chosen.select("rule", F.timestamp_micros("us").alias("ts"))


def _named(pdf: pd.DataFrame, n: int) -> pd.Series:
    return pd.Series([pdf["rule"].iloc[0]] * n, dtype=object)


def _entries(rows: DataFrame, block: int) -> DataFrame:
    """``rule, seg, entry``: blocks that a rule's chain enters, and the time from which each may emit."""
    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["us"].to_numpy())
        cool = int(pdf["cool"].iloc[0])
        nxt = np.searchsorted(t, t + cool, side="left")
        out = np.empty(len(t), dtype=np.int64)
        for i in range(len(t) - 1, -1, -1):
            out[i] = t[i] + cool if nxt[i] >= len(t) else out[nxt[i]]
        last = np.append(out[1:] != out[:-1], True)  # the last start time of each equal exit
        n = int(last.sum())
        return pd.DataFrame({"rule": _named(pdf, n), "seg": pdf["seg"].iloc[0], "upto": t[last], "leave": out[last]})

    made = rows.groupBy("rule", "seg").applyInPandas(steps, "rule string, seg bigint, upto bigint, leave bigint")
    made = stored(numbered(made, ["rule"], [col("upto")], out="at", block=block), "cooldown-steps")
    # As of the time that a step leaves its block: how many steps end before it. That many steps on is the next one.
    marks = made.select("rule", "at", col("leave").alias("us"), lit(0).alias("kind"), lit(0).alias("n")).unionByName(
        made.select("rule", "at", col("upto").alias("us"), lit(1).alias("kind"), lit(1).alias("n")))
    led = prefix_sums(marks, ["rule"], [col("us"), col("kind"), col("at")], None, {"to": col("n")}, block=block).where(col("kind") == 0)
    # Rules may be null, so pairs are compared as structs.
    node = lambda at: F.struct("rule", col(at).alias("at"))
    jump = stored(led.select(node("at").alias("x"), node("to").alias("y")), "cooldown-leads")
    reached = made.where(col("at") == 0).select(node("at").alias("x"))
    size = reached.count()
    while True:
        more = reached.join(jump, "x").select(col("y").alias("x"))
        reached = stored(reached.unionByName(more).distinct().join(made.select(node("at").alias("x")), "x", "left_semi"), "cooldown-reached")
        now = reached.count()
        if now == size:
            break
        size = now
        on = jump.select(col("x").alias("y"), col("y").alias("z"))
        jump = stored(jump.join(on, "y").select("x", col("z").alias("y")), "cooldown-leads")
    ends = made.select(node("at").alias("x"), "seg", "leave").join(reached, "x")
    first = led.select(node("at").alias("x"), node("to").alias("y"))
    entered = ends.join(first, "x").select(col("y").alias("x"), col("leave").alias("entry"))
    begins = made.where(col("at") == 0).select(node("at").alias("x"), lit(-(1 << 63)).cast("long").alias("entry"))
    return entered.unionByName(begins).join(made.select(node("at").alias("x"), "seg"), "x").select("x.rule", "seg", "entry")


def sustained(log: DataFrame, key: str, ts: str, tie: str, condition: Column, minutes: float = 2.0, block: int = BLOCK_ROWS) -> DataFrame:
    """Runs of consecutive samples where the condition holds for at least ``minutes``.

    The run number is the count of failing samples so far, a running sum, so a hot key is dealt out in blocks.
    """
    d = log.select(key, col(ts).cast("timestamp").alias("ts"), tie, F.coalesce(condition, lit(False)).alias("_c"))
    runs = prefix_sums(d, [key], [col("ts"), col(tie)], None, {"_run": (~col("_c")).cast("bigint")}, block=block)
    g = runs.where(col("_c")).groupBy(key, "_run").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(lit(1)).alias("samples"))
    return g.where(F.unix_micros("end") - F.unix_micros("start") >= int(minutes * 60_000_000)).drop("_run")


def counter_increase(log: DataFrame, key: str, ts: str, tie: str, value: str, window: str = "10 minutes", slide: str = "1 minute",
                     over: float = 3.0, block: int = 100_000) -> DataFrame:
    """Sliding windows where a counter grew by more than ``over``. A drop means a restart: the new value is the growth."""
    d = log.select(key, col(ts).cast("timestamp").alias("ts"), tie, col(value).cast("double").alias("_v"))
    prev = trailing(d, [key], [col("ts"), col(tie)], 2, {"_first": F.first("_v")}, block=block)
    grown = F.when(col("pos") == 0, 0.0).when(col("_v") >= col("_first"), col("_v") - col("_first")).otherwise(col("_v"))
    w = prev.groupBy(key, F.window("ts", window, slide).alias("w")).agg(F.sum(grown).alias("increase"))
    return w.where(col("increase") > over).select(key, col("w.start").alias("window_start"), "increase")


def escalation_level(elapsed_minutes: Column, delays: Sequence[int] = ESCALATION_DELAYS, wait_first: bool = True) -> Column:
    """Level reached by an alert open for the given minutes; delays run one after another.

    With ``wait_first=False`` level 1 is sent at once and only the later delays are waited for.
    """
    at, level = 0, lit(0)
    for i, d in enumerate(delays, start=1):
        at += d if i > 1 or wait_first else 0
        level = F.when(elapsed_minutes >= at, i).otherwise(level)
    return level

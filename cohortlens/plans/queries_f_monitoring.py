"""Metric, alert and call-log analytics, batch and streaming. Oracle texts are the batch form of both."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from cohortlens.operators import monitoring as O
from cohortlens.operators.master import padded
from cohortlens.plans.registry import register
from cohortlens.session import scratch_path
from cohortlens.streaming import jobs as J

col, lit = F.col, F.lit
NOW = dt.datetime(2024, 1, 31)
ML = ("metric_log",)
_N = "TIMESTAMP '2024-01-31 00:00:00'"


def rnd(df, n=6):
    return df.withColumns({f.name: F.round(f.name, n) for f in df.schema.fields if f.dataType.typeName() == "double"})


def _ts(t, name):
    return t[name].withColumn("ts", col("ts").cast("timestamp"))


register("mon01_metric_summary", ML, f"""
SELECT round(avg(query_time_ms), 6) AS avg_query_time_ms, round(avg(cache_hit_rate), 6) AS avg_cache_hit_rate, round(avg(cpu_percent), 6) AS avg_cpu_percent,
       round(avg(memory_mb), 6) AS avg_memory_mb, round(avg(health_score), 6) AS avg_health_score, round(max(query_time_ms), 6) AS max_query_time_ms,
       min(health_score) AS min_health_score, count(*) AS measurements FROM metric_log WHERE ts > {_N} - INTERVAL 240 HOUR""")(
    lambda t: rnd(O.metric_summary(_ts(t, "metric_log"), NOW, 240)))
register("mon02_open_alerts", ("alert_log",), f"""
SELECT alert_type, severity, count(*) AS n FROM alert_log WHERE ts > {_N} - INTERVAL 240 HOUR AND NOT resolved GROUP BY ALL""")(
    lambda t: O.open_alerts(_ts(t, "alert_log"), NOW, 240))
register("mon03_health_score", ML, """
SELECT metric_id, round(greatest(0, 100 - if(s > 5, least(30, (s / 5 - 1) * 20), 0) - if(c < 0.8, least(20, (0.8::DOUBLE - c) * 50), 0) - if(cpu_percent > 70, least(15, (cpu_percent - 70) / 30 * 15), 0)
       - if(memory_mb > 512, least(10, (memory_mb - 512) / 512 * 10), 0) - if(e > 0.05, least(25, (e - 0.05::DOUBLE) * 100), 0)), 6) AS score
FROM (SELECT *, query_time_ms / 1000 AS s, cache_hit_rate / 100 AS c, (metric_id % 20) / 100 AS e FROM metric_log)""")(
    lambda t: t["metric_log"].select("metric_id", F.round(O.health_score(
        col("query_time_ms") / 1000, col("cache_hit_rate") / 100, col("cpu_percent"), col("memory_mb"), (col("metric_id") % 20) / 100), 6).alias("score")))
register("mon04_baseline", ML, f"""
WITH a AS (SELECT avg(query_time_ms) FILTER (WHERE ts > {_N} - INTERVAL 48 HOUR) AS q1, avg(query_time_ms) AS q7, avg(cache_hit_rate) FILTER (WHERE ts > {_N} - INTERVAL 48 HOUR) AS c1,
           avg(health_score) FILTER (WHERE ts > {_N} - INTERVAL 48 HOUR) AS h1 FROM metric_log WHERE ts > {_N} - INTERVAL 168 HOUR)
SELECT round(q1, 6) AS query_time_ms, round((q1 - 900) / 900 * 100, 6) AS query_change_pct, round(c1 - 55, 6) AS cache_change, round(h1 - 80, 6) AS health_change,
       round((q1 - q7) / q7 * 100, 6) AS query_trend_pct, (q1 - q7) / q7 * 100 > 20 AS degrading FROM a""")(
    lambda t: rnd(O.baseline_comparison(_ts(t, "metric_log"), NOW, {"query_time_ms": 900.0, "cache_hit_rate": 55.0, "health_score": 80.0}, hours=48)))
register("mon05_bottlenecks", ML, f"""
WITH s AS (SELECT avg(query_time_ms) AS q, avg(cache_hit_rate) AS c, avg(cpu_percent) AS u, avg(memory_mb) AS m FROM metric_log WHERE ts > {_N} - INTERVAL 240 HOUR),
b AS (SELECT 'query_performance' AS type, if(q > 1000, 'HIGH', 'MEDIUM') AS severity, q AS current_value, 500.0::DOUBLE AS target_value, q / 500 * 10 AS impact_score FROM s WHERE q > 500
  UNION ALL SELECT 'cache_performance', 'MEDIUM', c, 80, (80 - c) / 10 FROM s WHERE c < 80
  UNION ALL SELECT 'cpu_usage', if(u > 90, 'HIGH', 'MEDIUM'), u, 30, u / 30 * 8 FROM s WHERE u > 30
  UNION ALL SELECT 'memory_usage', 'MEDIUM', m, 400, m / 400 * 6 FROM s WHERE m > 400)
SELECT type, severity, round(current_value, 6) AS current_value, target_value, round(impact_score, 6) AS impact_score FROM b""")(
    lambda t: rnd(O.bottlenecks(O.metric_summary(_ts(t, "metric_log"), NOW, 240), {**O.TARGETS, "query_seconds": 0.5, "cpu_percent": 30.0, "memory_mb": 400.0})))
register("mon06_effectiveness", ("call_log",), """
SELECT query_name, count(*) AS attempts, count(*) FILTER (WHERE cache_hit) AS successes, round(avg(cache_hit::INT) * 100, 6) AS success_rate,
       round(sum(if(cache_hit, execution_time, 0)), 4) AS improvement, round(sum(if(cache_hit, execution_time, 0)) / greatest(count(*) FILTER (WHERE cache_hit), 1), 6) AS mean_seconds
FROM call_log GROUP BY 1""")(lambda t: rnd(O.effectiveness(t["call_log"], "query_name", "cache_hit", "execution_time", "execution_time")).withColumn(
    "improvement", F.round("improvement", 4)))
register("mon07_benchmarks", ("call_log",), """
WITH g AS (SELECT query_name, avg(execution_time) AS m, min(execution_time) AS lo, max(execution_time) AS hi, stddev_samp(execution_time) AS s, median(execution_time) AS md FROM call_log GROUP BY 1)
SELECT query_name, round(m, 6) AS mean, round(lo, 6) AS min, round(hi, 6) AS max, round(s, 6) AS std, round(md, 6) AS median, round(m / 2.0, 6) AS ratio, m / 2.0 <= 1.2 AS passed, s > m * 0.3 AS unstable FROM g""")(
    lambda t: rnd(O.benchmark_statistics(t["call_log"], "query_name", "execution_time", 2.0)))
_REG = lambda lo, hi: (f"SELECT query_name, avg(execution_time) AS m FROM call_log WHERE ts >= TIMESTAMP '2024-01-{lo} 00:00:00' AND ts < TIMESTAMP '2024-01-{hi} 00:00:00' GROUP BY 1")
_day = lambda t, lo, hi: _ts(t, "call_log").where((col("ts") >= lit(dt.datetime(2024, 1, lo))) & (col("ts") < lit(dt.datetime(2024, 1, hi)))).groupBy(
    "query_name").agg(F.avg("execution_time").alias("m"))
register("mon08_regressions", ("call_log",), f"""
WITH b AS ({_REG('01', '16')}), c AS ({_REG('29', '31')}), d AS (SELECT c.query_name, c.m, b.m AS baseline, (c.m - b.m) / b.m * 100 AS p FROM c JOIN b USING (query_name))
SELECT query_name, round(m, 6) AS m, round(baseline, 6) AS baseline, round(p, 6) AS change_percent, if(p > 0, 'regression', 'improvement') AS direction FROM d WHERE abs(p) > 1""")(
    lambda t: rnd(O.regressions(_day(t, 29, 31), _day(t, 1, 16), "query_name", "m", limit_pct=1.0)))
register("mon09_timing_grades", ("call_log",), """
SELECT event_id, CASE WHEN execution_time < 0.1 THEN 'EXCELLENT' WHEN execution_time < 0.5 THEN 'GOOD' WHEN execution_time < 2 THEN 'ACCEPTABLE' WHEN execution_time < 5 THEN 'NEEDS_IMPROVEMENT' ELSE 'POOR' END AS grade FROM call_log""")(
    lambda t: t["call_log"].select("event_id", O.timing_grade(col("execution_time")).alias("grade")))
register("mon10_growth", ML, """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY ts DESC) AS k FROM metric_log),
g AS (SELECT component, count(*) AS samples, max_by(memory_mb, ts) AS current, (max(memory_mb) FILTER (WHERE k <= 7) - min(memory_mb) FILTER (WHERE k <= 7)) / 7 AS gr FROM r WHERE k <= 30 GROUP BY 1)
SELECT component, samples, current, round(gr, 6) AS growth_per_day, round(CASE WHEN gr > 0 AND current < 1000 THEN (1000 - current) / gr END, 6) AS days_to_limit FROM g WHERE samples >= 7""")(
    lambda t: rnd(O.growth_forecast(t["metric_log"], "component", "ts", "memory_mb", 1000.0)))
register("mon11_error_lines", (), """
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS v FROM documents)
SELECT count(*) AS lines, count(*) FILTER (WHERE upper(v) LIKE '%ERROR%') AS errors, count(*) FILTER (WHERE upper(v) LIKE '%WARN%') AS warnings FROM l""")(
    lambda t: O.error_lines(t["documents"].select(F.explode(F.split("text", "\n")).alias("value"))))
register("mon12a_retained", ML, f"SELECT metric_id FROM metric_log WHERE ts >= {_N} - INTERVAL 10 DAY")(
    lambda t: O.retained(_ts(t, "metric_log"), NOW, 10).select("metric_id"))
register("mon12b_retained_alerts", ("alert_log",), f"SELECT alert_id FROM alert_log WHERE ts >= {_N} - INTERVAL 7 DAY OR NOT resolved")(
    lambda t: O.retained(_ts(t, "alert_log"), NOW, 7, "resolved").select("alert_id"))
_METRICS = ("query_time_ms", "cache_hit_rate", "cpu_percent", "memory_mb", "health_score")
# rule, component, metric, operator, threshold, severity, cooldown
_RULES = (("CPU_HIGH", "system", "cpu_percent", ">", 80.0, "HIGH", 15), ("QUERY_SLOW", "database", "query_time_ms", ">=", 9000.0, "MEDIUM", 10),
          ("HEALTH_LOW", "system", "health_score", "<", 55.0, "CRITICAL", 30), ("CACHE_EXACT", "system", "cache_hit_rate", "==", 50.0, "LOW", 5),
          ("MEMORY_OK", "system", "memory_mb", "<=", 301.0, "LOW", 5))
_long = lambda t: O.long_metrics(_ts(t, "metric_log"), ["metric_id", "ts"], _METRICS)
_rules = lambda t: t.spark.createDataFrame(list(_RULES), O.RULE_SCHEMA)
_LONG = "l AS (" + " UNION ALL ".join(f"SELECT metric_id, ts, '{m}' AS metric, {m} AS value FROM metric_log" for m in _METRICS) + ")"
_VALS = "k(rule, component, metric, operator, threshold, severity, cooldown_minutes) AS (VALUES " + ", ".join(str(r) for r in _RULES) + ")"
_HIT = """h AS (SELECT * FROM l JOIN k USING (metric) WHERE CASE operator WHEN '>' THEN value > threshold WHEN '<' THEN value < threshold WHEN '>=' THEN value >= threshold
  WHEN '<=' THEN value <= threshold ELSE abs(value - threshold) < 0.001 END)"""
register("mon13a_rules", ML, f"WITH {_LONG}, {_VALS}, {_HIT} SELECT rule, metric_id, value FROM h")(
    lambda t: O.evaluate_rules(_long(t), _rules(t)).select("rule", "metric_id", "value"))
_LIM = (("cpu_percent", ">", 70.0, 90.0), ("health_score", "<", 60.0, 52.0))
register("mon13b_tiered", ML, f"""WITH {_LONG}, k(metric, operator, warning, critical) AS (VALUES {", ".join(str(r) for r in _LIM)}),
x AS (SELECT metric_id, metric, value, CASE WHEN operator = '>' AND value > critical OR operator = '<' AND value < critical THEN 'critical'
      WHEN operator = '>' AND value > warning OR operator = '<' AND value < warning THEN 'warning' END AS level FROM l JOIN k USING (metric))
SELECT * FROM x WHERE level IS NOT NULL""")(
    lambda t: O.tiered(_long(t), t.spark.createDataFrame(list(_LIM), "metric string, operator string, warning double, critical double")).select(
        "metric_id", "metric", "value", "level"))
register("sf19_flatten_metrics", (), """
SELECT event_id, unnest(['outer.k', 'outer.deep.v', 'list.avg', 'list.max', 'list.min', 'plain']) AS name,
       unnest([CAST(json_extract_string(props, '$.k') AS DOUBLE), value, round((value + user_id) / 2, 9), greatest(value, user_id), least(value, user_id), user_id::DOUBLE]) AS value FROM events""")(
    lambda t: rnd(O.flatten_json_metrics(t["events"].select("event_id", F.to_json(F.struct(
        F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.struct(col("value").alias("v")).alias("deep")).alias("outer"),
        F.array(col("value"), col("user_id").cast("double")).alias("list"), col("user_id").alias("plain"), lit("x").alias("timestamp"))).alias("j")), "j", ["event_id"]), 9))

# --- streaming questions
_W = """w AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(i::BIGINT) AS window_start, * FROM call_log, (SELECT unnest([0, 1, 2, 3, 4]) AS i))"""
_STATS = f"""WITH {_W} SELECT window_start, count(*) AS total_queries, round(avg(execution_time), 8) AS avg_execution_time, count(*) FILTER (WHERE execution_time > 5) AS slow_queries,
       round(avg(error::INT), 6) AS error_rate, round(avg(cache_hit::INT), 6) AS hit_rate FROM w GROUP BY 1"""
_CALL = ("call_log",)


def _stats(df):
    return df.select(col("window_start").cast("timestamp_ntz").alias("window_start"), "total_queries", F.round("avg_execution_time", 8).alias("avg_execution_time"), "slow_queries",
                     F.round("error_rate", 6).alias("error_rate"), F.round("hit_rate", 6).alias("hit_rate"))


register("sm01a_recent_stats", _CALL, _STATS)(lambda t: _stats(O.recent_call_stats(_ts(t, "call_log"))))


def _stream_stats(t):
    calls = J.call_log_stream(J.events_stream(t.spark, t.folder))
    rows = J.run_available(J.call_stats(calls), scratch_path(t.spark, "stats"), "update")
    return _stats(J.latest_update(rows, "window_start", "window_end"))


register("sm01b_recent_stats_stream", _CALL, _STATS)(_stream_stats)


def _stream_metrics(t):
    e = J.events_stream(t.spark, t.folder)
    m = e.select(col("event_id").alias("metric_id"), "ts", (col("value") * 20).alias("query_time_ms"), (col("user_id") % 100).cast("double").alias("cache_hit_rate"),
                 (col("event_id") % 100).cast("double").alias("cpu_percent"), (300 + col("event_id") % 400).cast("double").alias("memory_mb"),
                 (50 + col("event_id") * 7 % 51).cast("double").alias("health_score"))
    return O.long_metrics(m, ["metric_id", "ts"], _METRICS)


register("sm02_alert_stream", ML, f"WITH {_LONG}, {_VALS}, {_HIT} SELECT rule, metric_id, severity, value FROM h")(
    lambda t: J.run_available(J.threshold_alerts(_stream_metrics(t), _rules(t)), scratch_path(t.spark, "alerts")).select("rule", "metric_id", "severity", "value"))
_COOL = f"""WITH RECURSIVE {_LONG}, {_VALS}, {_HIT}, hh AS MATERIALIZED (SELECT DISTINCT rule, ts, to_minutes(cooldown_minutes::BIGINT) AS c FROM h),
r(rule, ts) AS (SELECT rule, min(ts) FROM hh GROUP BY 1 UNION ALL SELECT r.rule, min(hh.ts) FROM r JOIN hh ON hh.rule = r.rule AND hh.ts >= r.ts + hh.c GROUP BY r.rule)
SELECT rule, ts FROM r"""
_ntz = lambda df, *cs: df.withColumns({c: col(c).cast("timestamp_ntz") for c in cs})
register("sm03a_cooldown", ML, _COOL)(lambda t: _ntz(O.cooldown_emissions(O.evaluate_rules(_long(t), _rules(t))), "ts"))
register("sm03b_cooldown_stream", ML, _COOL)(
    lambda t: _ntz(J.run_closed(J.threshold_alerts(_stream_metrics(t), _rules(t)), scratch_path(t.spark, "cooldown")).where(~col("late")).select("rule", "ts"), "ts"))
register("sm04_sustained", ML, """
WITH c AS (SELECT *, sum((NOT query_time_ms > 500)::INT) OVER (PARTITION BY component ORDER BY ts, metric_id) AS run FROM metric_log),
g AS (SELECT component, run, min(ts) AS start, max(ts) AS end, count(*) AS samples FROM c WHERE query_time_ms > 500 GROUP BY ALL)
SELECT component, start, "end", samples FROM g WHERE "end" - start >= INTERVAL 2 MINUTE""")(
    lambda t: _ntz(O.sustained(t["metric_log"], "component", "ts", "metric_id", col("query_time_ms") > 500), "start", "end"))
register("sm05_counter_increase", ML, """
WITH d AS (SELECT component, ts, memory_mb AS v, lag(memory_mb) OVER (PARTITION BY component ORDER BY ts, metric_id) AS p FROM metric_log),
g AS (SELECT component, ts, CASE WHEN p IS NULL THEN 0 WHEN v >= p THEN v - p ELSE v END AS x FROM d),
w AS (SELECT component, time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(i::BIGINT) AS window_start, x FROM g, (SELECT unnest(range(0, 10)) AS i))
SELECT component, window_start, sum(x) AS increase FROM w GROUP BY ALL HAVING sum(x) > 3""")(
    lambda t: _ntz(O.counter_increase(t["metric_log"], "component", "ts", "metric_id", "memory_mb"), "window_start"))
_EL = "date_diff('minute', ts, TIMESTAMP '2024-01-30 23:59:00')"
register("sm06_escalation", ("alert_log",), f"""
SELECT alert_id, CASE WHEN {_EL} >= 110 THEN 4 WHEN {_EL} >= 50 THEN 3 WHEN {_EL} >= 20 THEN 2 WHEN {_EL} >= 5 THEN 1 ELSE 0 END AS level,
       CASE WHEN {_EL} >= 105 THEN 4 WHEN {_EL} >= 45 THEN 3 WHEN {_EL} >= 15 THEN 2 WHEN {_EL} >= 0 THEN 1 ELSE 0 END AS level_at_once FROM alert_log WHERE NOT resolved""")(
    lambda t: t["alert_log"].where(~col("resolved")).withColumn("m", F.timestamp_diff("MINUTE", F.date_trunc("minute", "ts"), lit(dt.datetime(2024, 1, 30, 23, 59)).cast("timestamp_ntz"))).select(
        "alert_id", O.escalation_level(col("m")).alias("level"), O.escalation_level(col("m"), wait_first=False).alias("level_at_once")))


def _stream_changes(t):
    base = scratch_path(t.spark, "changes")
    e = J.events_stream(t.spark, t.folder)
    log = e.select(F.concat(lit("PROV_"), padded(col("user_id"))).alias("record_id"), "event_id", "ts",
                   F.when(col("event_type") == "signup", "INSERT").when(col("event_type") == "error", "DELETE").otherwise("UPDATE").alias("operation_type"),
                   F.concat(lit("mail"), col("event_id").cast("string"), lit("@clinic.org")).alias("email"))
    return J.apply_change_stream(log, f"{base}/table", t["providers"].select("provider_id", "full_name", "email"), "provider_id", ["ts", "event_id"], ["email"], f"{base}/checkpoint")


from cohortlens.plans.queries_e_master import APPLIED_SQL  # noqa: E402

register("sm07_change_stream", ("providers", "change_log"), APPLIED_SQL)(_stream_changes)

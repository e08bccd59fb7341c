"""Predicates, joins, aggregates, windows, sorts, set operations and scalar functions on the domain tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from cohortlens.fixtures import ASOF
from cohortlens.functions import extract as X
from cohortlens.functions import predicates as PR
from cohortlens.operators import aggregates as A
from cohortlens.operators import joins as J
from cohortlens.operators import rules as R
from cohortlens.operators import windows as W
from cohortlens.plans.registry import register

col, lit = F.col, F.lit
P = ("providers",)

# --- predicates and filters
register("pr01_blank", P, "SELECT provider_id FROM providers WHERE coalesce(trim(full_name), '') = ''")(
    lambda t: t["providers"].where(PR.is_blank(col("full_name"))).select("provider_id"))
register("pr02_containment", P, """
SELECT provider_id, full_name ILIKE ('%' || first_name || '%') AS has_first, full_name ILIKE ('%' || last_name || '%') AS has_last
FROM providers""")(lambda t: t["providers"].select(
    "provider_id", PR.contains_ci(col("full_name"), col("first_name")).alias("has_first"),
    PR.contains_ci(col("full_name"), col("last_name")).alias("has_last")))
register("pr03_test_words", P, """
SELECT provider_id FROM providers WHERE regexp_matches(lower(full_name), 'test|dummy|sample')
   OR regexp_matches(lower(email), 'test|example|dummy')""")(lambda t: t["providers"].where(
    PR.has_any_word(col("full_name"), PR.TEST_NAME_WORDS) | PR.has_any_word(col("email"), PR.TEST_EMAIL_WORDS)).select("provider_id"))
register("pr04_digit_patterns", P, """
SELECT provider_id, regexp_full_match(npi_number, '[0-9]{10}') AS ten_digits, npi_number[1] BETWEEN '0' AND '9' AS digit_first
FROM providers""")(lambda t: t["providers"].select(
    "provider_id", PR.is_ten_digits(col("npi_number")).alias("ten_digits"), PR.starts_with_digit(col("npi_number")).alias("digit_first")))
register("pr05_value_lists", P, """
SELECT provider_id, license_state FROM providers WHERE license_state NOT IN ('CA', 'NY') AND specialty_primary IN ('Surgery', 'Cardiology')
""")(lambda t: t["providers"].where(
    ~col("license_state").isin("CA", "NY") & col("specialty_primary").isin("Surgery", "Cardiology")).select("provider_id", "license_state"))
register("pr06_ranges", P, """
SELECT provider_id FROM providers WHERE birth_year < 1920 OR birth_year > 2007 OR graduation_year < birth_year + 18 OR years_in_practice < 0
""")(lambda t: t["providers"].where(
    (col("birth_year") < 1920) | (col("birth_year") > ASOF.year - 18) | (col("graduation_year") < col("birth_year") + 18)
    | (col("years_in_practice") < 0)).select("provider_id"))
register("pr07_flags", P, """
SELECT provider_id, coalesce(trim(email), '') = '' AS no_email, coalesce(trim(phone_number), '') = '' AS no_phone,
       email NOT LIKE '%@%.%' AS bad_email, length(translate(phone_number, '()-', '')) <> 10 AS bad_phone FROM providers
""")(lambda t: t["providers"].select(
    "provider_id", PR.is_blank(col("email")).alias("no_email"), PR.is_blank(col("phone_number")).alias("no_phone"),
    (~PR.email_shaped(col("email"))).alias("bad_email"), PR.bad_phone_length(col("phone_number")).alias("bad_phone")))
register("pr08_case_chain", P, """
SELECT provider_id, CASE WHEN npi_number IS NULL THEN 'CRITICAL' WHEN length(npi_number) <> 10 THEN 'HIGH' ELSE 'LOW' END AS severity FROM providers
""")(lambda t: t["providers"].select("provider_id", PR.first_match(
    (col("npi_number").isNull(), "CRITICAL"), (F.length("npi_number") != 10, "HIGH"), default="LOW").alias("severity")))
register("pr09_active", P, "SELECT provider_id FROM providers WHERE record_status = 'ACTIVE'")(
    lambda t: t["providers"].where(col("record_status") == "ACTIVE").select("provider_id"))
register("pr10a_low_quality", P, "SELECT provider_id FROM providers WHERE source_confidence < 0.8 OR record_status <> 'ACTIVE'")(
    lambda t: t["providers"].where((col("source_confidence") < 0.8) | (col("record_status") != "ACTIVE")).select("provider_id"))
register("pr10b_facilities_due", ("facilities",), "SELECT facility_id FROM facilities WHERE validation_status <> 'VERIFIED'")(
    lambda t: t["facilities"].where(col("validation_status") != "VERIFIED").select("facility_id"))
_OPEN = "severity_level IN ('CRITICAL', 'HIGH') AND status IN ('OPEN', 'IN_PROGRESS')"
register("pr10c_critical_open", ("violation_log",), f"SELECT violation_id FROM violation_log WHERE {_OPEN}")(
    lambda t: t["violation_log"].where(
        col("severity_level").isin("CRITICAL", "HIGH") & col("status").isin("OPEN", "IN_PROGRESS")).select("violation_id"))
register("pr10d_recent", ("violation_log",), """
SELECT d AS days, violation_id FROM violation_log, (SELECT unnest([1, 7, 30]) AS d) WHERE violation_date >= DATE '2024-01-30' - d::INT
""")(lambda t: t["violation_log"].select(
    "violation_id", F.explode(F.filter(F.array(lit(1), lit(7), lit(30)),
                                       lambda d: col("violation_date") >= F.date_sub(lit(dt.date(2024, 1, 30)), d))).alias("days")))
register("pr11_lookups", P, "SELECT provider_id, full_name FROM providers WHERE full_name ILIKE 'Ann%' OR provider_id = 'PROV_000007'")(
    lambda t: t["providers"].where(PR.like_ci(col("full_name"), "Ann%") | (col("provider_id") == "PROV_000007")).select("provider_id", "full_name"))
register("pr12_time_range", (), "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 24 HOUR")(
    lambda t: t["events"].where(col("ts") > lit(dt.datetime(2024, 1, 29)).cast("timestamp_ntz")).select("event_id"))

# --- joins
register("jn01_inner", ("providers", "affiliations"), """
SELECT provider_id, facility_id, full_name FROM affiliations JOIN providers USING (provider_id)""")(
    lambda t: t["affiliations"].select("provider_id", "facility_id").join(t["providers"].select("provider_id", "full_name"), "provider_id"))
register("jn02_active_primary", ("providers", "facilities", "affiliations"), """
SELECT provider_id, full_name, specialty_primary, license_state, facility_name, facility_type, city, state_province, start_date
FROM providers JOIN affiliations USING (provider_id) JOIN facilities USING (facility_id)
WHERE record_status = 'ACTIVE' AND is_primary_affiliation AND end_date IS NULL""")(
    lambda t: J.active_providers_with_primary_affiliation(t.pick("providers", "facilities", "affiliations")))
register("jn03_activity_summary", ("providers", "activities"), """
SELECT p.provider_id, full_name, specialty_primary, count(activity_id) AS total_activities, count(DISTINCT facility_id) AS facilities_count,
       min(activity_date) AS first_activity, max(activity_date) AS latest_activity,
       count(*) FILTER (WHERE activity_type = 'PUBLICATION') AS publication_count, round(avg(citation_count), 6) AS avg_citations
FROM providers p LEFT JOIN activities a ON a.provider_id = p.provider_id WHERE record_status = 'ACTIVE' GROUP BY ALL""")(
    lambda t: J.provider_activity_summary(t.pick("providers", "activities")).withColumn("avg_citations", F.round("avg_citations", 6)))
register("jn04_anti_left_join", ("providers", "affiliations"), """
SELECT a.provider_id, a.facility_id FROM affiliations a LEFT JOIN providers p ON p.provider_id = a.provider_id WHERE p.provider_id IS NULL""")(
    lambda t: t["affiliations"].select("provider_id", "facility_id").join(t["providers"].select("provider_id"), "provider_id", "left_anti"))
register("jn05_anti_not_exists", ("providers", "affiliations"), """
SELECT provider_id FROM providers p WHERE NOT EXISTS (SELECT 1 FROM affiliations a WHERE a.provider_id = p.provider_id)""")(
    lambda t: t["providers"].select("provider_id").join(t["affiliations"].select("provider_id").distinct(), "provider_id", "left_anti"))
register("jn06_semi_having", ("affiliations",), """
SELECT provider_id, facility_id FROM affiliations WHERE provider_id IN (
  SELECT provider_id FROM affiliations GROUP BY 1 HAVING count(*) > 1 OR count(*) FILTER (WHERE is_primary_affiliation) <> 1)""")(
    lambda t: t["affiliations"].select("provider_id", "facility_id").join(
        R.affiliation_stats(t["affiliations"]).where((col("affiliation_rows") > 1) | (col("primary_affiliations") != 1)).select("provider_id"),
        "provider_id", "left_semi"))
register("jn07_left_to_duplicates", P, """
SELECT provider_id, c AS duplicate_count FROM providers LEFT JOIN
  (SELECT npi_number AS k, count(*) AS c FROM providers WHERE length(npi_number) = 10 GROUP BY 1 HAVING count(*) > 1) ON k = npi_number""")(
    lambda t: t["providers"].select("provider_id", "npi_number").join(
        R.duplicate_counts(t["providers"].where(F.length("npi_number") == 10), "npi_number"), "npi_number", "left").drop("npi_number"))
register("jn08_date_spine", ("activities",), """
WITH b AS (SELECT min(activity_date) AS lo, max(activity_date) AS hi FROM activities),
d AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS activity_date FROM b)
SELECT d.activity_date, count(activity_id) AS value FROM d LEFT JOIN activities a ON a.activity_date = d.activity_date GROUP BY 1""")(
    lambda t: J.date_spine(t["activities"], "activity_date", F.count("activity_id")))
register("jn09_or_partners", ("research_rows",), """
WITH p AS (SELECT a.row_ordinal AS i, a.source_category = b.source_category AS c, a.journal = b.journal AS s
           FROM research_rows a JOIN research_rows b
             ON a.row_ordinal <> b.row_ordinal AND (a.source_category = b.source_category OR a.journal = b.journal))
SELECT i AS row_ordinal, count(*) FILTER (WHERE c) AS same_source_category, count(*) FILTER (WHERE s) AS same_journal, count(*) AS partners
FROM p GROUP BY 1""")(
    lambda t: J.shared_partner_counts(t["research_rows"], "row_ordinal", "source_category", "journal"))
_TRI = ("list_distinct(list_transform(range(1, length({0}) + 2), lambda i: substr('  ' || lower({0}) || ' ', i, 3)))")


def similarity_sql(a: str, b: str) -> str:
    x, y = _TRI.format(a), _TRI.format(b)
    return f"(len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))))"


register("jn11_similar_names", P, f"""
WITH n AS (SELECT DISTINCT full_name AS n FROM providers WHERE full_name IS NOT NULL),
s AS (SELECT a.n AS n1, b.n AS n2, {similarity_sql('a.n', 'b.n')} AS sim FROM n a, n b)
SELECT n1, n2, round(sim, 6) AS similarity FROM s WHERE sim > 0.8 AND n1 <> n2""")(
    lambda t: J.similar_names(t["providers"], t["providers"], "full_name").where(col("n1") != col("n2"))
    .select("n1", "n2", F.round("similarity", 6).alias("similarity")))
register("jn12_interval_overlap", ("affiliations",), """
SELECT a.provider_id, a.facility_id, a.start_date,
       (SELECT count(*) FROM affiliations b WHERE b.provider_id = a.provider_id
          AND (b.start_date, b.facility_id) < (a.start_date, a.facility_id) AND coalesce(b.end_date, DATE '9999-12-31') >= a.start_date) AS overlaps
FROM affiliations a""")(
    lambda t: J.overlapping_intervals(t["affiliations"], "provider_id", "facility_id", "start_date", "end_date"))
register("jn13_positional", ("research_rows",), """
WITH l AS (SELECT source_table, severe, row_number() OVER (PARTITION BY source_table ORDER BY row_ordinal) - 1 AS pos FROM research_rows WHERE severe IS NOT NULL),
r AS (SELECT source_table, sample_size, row_number() OVER (PARTITION BY source_table ORDER BY row_ordinal) - 1 AS pos FROM research_rows WHERE sample_size IS NOT NULL)
SELECT source_table, pos, severe, sample_size FROM l JOIN r USING (source_table, pos)""")(
    lambda t: J.positional_pairs(t["research_rows"], "source_table", "row_ordinal", "severe", "sample_size"))

# --- aggregates
register("ag01_basic", ("activities",), """
SELECT activity_type, count(*) AS n, count(facility_id) AS n_fac, count(DISTINCT facility_id) AS d_fac, sum(citation_count)::BIGINT AS s,
       round(avg(citation_count), 6) AS m, min(activity_date) AS lo, max(activity_date) AS hi FROM activities GROUP BY 1""")(
    lambda t: t["activities"].groupBy("activity_type").agg(
        F.count(lit(1)).alias("n"), F.count("facility_id").alias("n_fac"), F.count_distinct("facility_id").alias("d_fac"),
        F.sum("citation_count").alias("s"), F.round(F.avg("citation_count"), 6).alias("m"), F.min("activity_date").alias("lo"),
        F.max("activity_date").alias("hi")))
register("ag02_conditional", ("affiliations",), """
SELECT provider_id, count(*) FILTER (WHERE is_primary_affiliation) AS prim, sum(CASE WHEN end_date IS NULL THEN 1 ELSE 0 END)::BIGINT AS act
FROM affiliations GROUP BY 1""")(lambda t: t["affiliations"].groupBy("provider_id").agg(
    F.count_if("is_primary_affiliation").alias("prim"), F.sum(F.when(col("end_date").isNull(), 1).otherwise(0)).alias("act")))
register("ag03_having", ("affiliations",), "SELECT provider_id, count(*) AS n FROM affiliations GROUP BY 1 HAVING count(*) > 5")(
    lambda t: t["affiliations"].groupBy("provider_id").agg(F.count(lit(1)).alias("n")).where(col("n") > 5))
register("ag04_scalar_counts", ("providers", "facilities", "affiliations"), """
SELECT (SELECT count(*) FROM providers) AS p, (SELECT count(*) FROM facilities) AS f, (SELECT count(*) FROM affiliations) AS a""")(
    lambda t: R.one_row_counts({"p": (t["providers"], None), "f": (t["facilities"], None), "a": (t["affiliations"], None)}))
register("ag05_value_counts", ("research_rows",), """
SELECT journal, count(*) AS n FROM research_rows WHERE journal IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10""")(
    lambda t: A.value_counts(t["research_rows"], "journal", 10))
register("ag06_merged_counts", ("research_rows",), """
WITH c AS (SELECT source_table, journal, count(*) AS n FROM research_rows GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY source_table ORDER BY n DESC, journal) AS r FROM c)
SELECT journal, sum(n)::BIGINT AS n FROM k WHERE r <= 3 GROUP BY 1""")(
    lambda t: A.merged_top_counts(t["research_rows"], "source_table", "journal", 3))
_R6 = lambda df, *cs: df.withColumns({c: F.round(c, 6) for c in cs})
register("ag07_describe", (), """
SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median,
       round(stddev_samp(o_totalprice), 4) AS std_sample, round(stddev_pop(o_totalprice), 4) AS std_population,
       min(o_totalprice) AS min, max(o_totalprice) AS max, round(max(o_totalprice) - min(o_totalprice), 4) AS range FROM orders""")(
    lambda t: A.describe(t["orders"].select("o_totalprice"), "o_totalprice").withColumns(
        {c: F.round(c, 4) for c in ("mean", "median", "std_sample", "std_population", "range")}))
register("ag08_trimmed_mean", ("call_log",), """
SELECT query_name, round((sum(execution_time) - min(execution_time) - max(execution_time)) / (count(*) - 2), 6) AS trimmed_mean, count(*) AS n
FROM call_log GROUP BY 1""")(lambda t: _R6(A.trimmed_mean(t["call_log"], ["query_name"], "execution_time"), "trimmed_mean"))
register("ag09_group_multi", ("interactions",), """
SELECT treatment, sum(outcome)::BIGINT AS s, count(outcome) AS n, round_even(avg(outcome), 3) AS m FROM interactions GROUP BY 1""")(
    lambda t: t["interactions"].groupBy("treatment").agg(
        F.sum("outcome").alias("s"), F.count("outcome").alias("n"), F.bround(F.avg("outcome"), 3).alias("m")))
register("ag10_arg_max", ("activities",), """
SELECT activity_type, max_by(activity_id, (citation_count, activity_id)) AS top_activity FROM activities GROUP BY 1""")(
    lambda t: t["activities"].groupBy("activity_type").agg(
        F.max_by("activity_id", F.struct("citation_count", "activity_id")).alias("top_activity")))
register("ag11_pivot_mean", ("interactions",), """
WITH g AS (SELECT patient_id, treatment, avg(outcome) AS m FROM interactions GROUP BY ALL), c AS (SELECT DISTINCT treatment FROM g), p AS (SELECT DISTINCT patient_id FROM g)
SELECT patient_id, treatment, round(coalesce(m, 0), 6) AS mean_outcome FROM p CROSS JOIN c LEFT JOIN g USING (patient_id, treatment)""")(
    lambda t: _R6(A.pivot_mean(t["interactions"], "patient_id", "treatment", "outcome").unpivot("patient_id", None, "treatment", "mean_outcome"), "mean_outcome"))
register("ag12_joined_values", ("affiliations",), """
SELECT provider_id, 0 AS part, string_agg(DISTINCT facility_id, '; ' ORDER BY facility_id) AS values_text, count(DISTINCT facility_id) AS n_values
FROM affiliations GROUP BY 1""")(lambda t: A.joined_values(t["affiliations"], "provider_id", "facility_id"))
register("ag13_histogram", (), """
WITH s AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 20 AS w FROM lineitem),
b AS (SELECT least(floor((l_quantity - lo) / w), 19)::INT AS bin, lo, w FROM lineitem, s)
SELECT bin, round(lo + bin * w, 6) AS bin_start, round(lo + (bin + 1) * w, 6) AS bin_end, count(*) AS n FROM b GROUP BY ALL""")(
    lambda t: _R6(A.histogram(t["lineitem"], "l_quantity", 20), "bin_start", "bin_end"))
register("ag14_box_summary", ("survival",), """
SELECT treatment_group, quantile_cont(duration, 0.25) AS q1, quantile_cont(duration, 0.5) AS median, quantile_cont(duration, 0.75) AS q3
FROM survival GROUP BY 1""")(lambda t: A.exact_quantiles(
    t["survival"], "duration", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["treatment_group"]))
register("ag15_percent_where", (), """
SELECT round(avg((l_quantity < 10)::INT) * 100, 6) AS small_pct, round(avg((l_quantity > 40)::INT) * 100, 6) AS large_pct FROM lineitem""")(
    lambda t: _R6(t["lineitem"].agg(*A.percent_where({"small_pct": col("l_quantity") < 10, "large_pct": col("l_quantity") > 40})),
                  "small_pct", "large_pct"))
register("ag16_distinct_rows", ("affiliations",), "SELECT count(*) AS distinct_rows FROM (SELECT DISTINCT * FROM affiliations)")(
    lambda t: A.distinct_rows(t["affiliations"]))
register("ag17_severity_totals", ("violation_log",), "SELECT severity_level, count(*) AS n FROM violation_log GROUP BY 1")(
    lambda t: t["violation_log"].groupBy("severity_level").agg(F.count(lit(1)).alias("n")))

# --- windows
register("wn01_key_count", P, "SELECT provider_id, npi_number, count(*) OVER (PARTITION BY npi_number) AS key_count FROM providers")(
    lambda t: W.with_key_count(t["providers"].select("provider_id", "npi_number"), "npi_number"))
_DAILY = """
WITH b AS (SELECT min(activity_date) AS lo, max(activity_date) AS hi FROM activities),
d AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS activity_date FROM b),
s AS (SELECT d.activity_date, count(activity_id) AS value FROM d LEFT JOIN activities a ON a.activity_date = d.activity_date GROUP BY 1)
"""
register("wn02_moving_average", ("activities",), _DAILY + """
SELECT activity_date, value,
       CASE WHEN count(*) OVER a = 7 THEN round(avg(value) OVER a, 6) END AS ma_7, CASE WHEN count(*) OVER b = 30 THEN round(avg(value) OVER b, 6) END AS ma_30
FROM s WINDOW a AS (ORDER BY activity_date ROWS 6 PRECEDING), b AS (ORDER BY activity_date ROWS 29 PRECEDING)""")(
    lambda t: _R6(W.moving_averages(J.date_spine(t["activities"], "activity_date", F.count("activity_id")), "activity_date", "value"), "ma_7", "ma_30"))
_MONTHLY = "WITH m AS (SELECT provider_id, CAST(date_trunc('month', activity_date) AS DATE) AS month, count(*) AS monthly_count FROM activities GROUP BY ALL) "
register("wn03_monthly_stats", ("activities",), _MONTHLY + """
SELECT *, round(avg(monthly_count) OVER w, 6) AS avg_monthly, round(stddev(monthly_count) OVER w, 6) AS std_monthly
FROM m WINDOW w AS (PARTITION BY provider_id)""")(
    lambda t: _R6(W.monthly_with_stats(t["activities"], "provider_id", "activity_date"), "avg_monthly", "std_monthly"))
register("wn04_lag", ("activities",), _MONTHLY + """
SELECT *, lag(monthly_count) OVER (PARTITION BY provider_id ORDER BY month) AS prev_count FROM m""")(
    lambda t: W.monthly_with_rolling(t["activities"], "provider_id", "activity_date").drop("rolling_avg"))
register("wn05_rolling_12", ("activities",), _MONTHLY + """
SELECT *, round(avg(monthly_count) OVER (PARTITION BY provider_id ORDER BY month ROWS 11 PRECEDING), 6) AS rolling_avg FROM m""")(
    lambda t: _R6(W.monthly_with_rolling(t["activities"], "provider_id", "activity_date").drop("prev_count"), "rolling_avg"))
register("wn06_last_100_calls", ("call_log",), """
SELECT event_id, round(avg(error::INT) OVER w * 100, 6) AS failure_rate, round(avg((execution_time >= 5)::INT) OVER w * 100, 6) AS slow_rate,
       round(avg(execution_time) OVER w, 8) AS mean_duration
FROM call_log WINDOW w AS (PARTITION BY query_name ORDER BY ts, event_id ROWS 99 PRECEDING)""")(
    lambda t: W.last_calls(t["call_log"], "query_name", "ts", "event_id", "execution_time", "error").select(
        "event_id", F.round("failure_rate", 6).alias("failure_rate"), F.round("slow_rate", 6).alias("slow_rate"),
        F.round("mean_duration", 8).alias("mean_duration")))
register("wn07_centred_average", ("activities",), """
WITH s AS (SELECT CAST(date_trunc('month', activity_date) AS DATE) AS month, count(*) AS value FROM activities GROUP BY 1)
SELECT month, value, CASE WHEN count(*) OVER a = 4 AND count(*) OVER b = 4 THEN round((avg(value) OVER a + avg(value) OVER b) / 2, 6) END AS trend
FROM s WINDOW a AS (ORDER BY month ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), b AS (ORDER BY month ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)""")(
    lambda t: _R6(W.centred_average_4(t["activities"].groupBy(F.trunc("activity_date", "month").alias("month")).agg(
        F.count(lit(1)).alias("value")), "month", "value"), "trend"))
register("wn08_latest_k", (), """
SELECT event_type, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS rank FROM events) WHERE rank <= 7""")(
    lambda t: W.latest_k(t["events"], "event_type", "ts", 7).select("event_type", "event_id", "rank"))
register("wn09_first_valid", ("research_rows",), """
SELECT source_table, arg_min(severe, row_ordinal) FILTER (WHERE severe IS NOT NULL) AS severe FROM research_rows WHERE severe IS NOT NULL GROUP BY 1""")(
    lambda t: W.first_valid(t["research_rows"], "source_table", "row_ordinal", "severe"))

# --- sorts, limits, set operations
_ST = lambda t: t.pick("providers", "facilities", "affiliations")
register("sr01_text_severity_sort", P, "SELECT severity, row_number() OVER (ORDER BY severity DESC) AS place FROM (SELECT DISTINCT severity FROM ("
         "SELECT CASE WHEN npi_number IS NULL THEN 'CRITICAL' WHEN length(npi_number) <> 10 THEN 'HIGH' WHEN record_status = 'ACTIVE' THEN 'LOW' ELSE 'MEDIUM' END AS severity FROM providers))")(
    lambda t: t["providers"].select(PR.first_match(
        (col("npi_number").isNull(), "CRITICAL"), (F.length("npi_number") != 10, "HIGH"), (col("record_status") == "ACTIVE", "LOW"),
        default="MEDIUM").alias("severity")).distinct().select(
        "severity", F.row_number().over(W.Window.orderBy(col("severity").desc())).alias("place")))
register("sr02_ranked_severity", ("violation_log",), """
SELECT violation_id, severity_level FROM violation_log ORDER BY
  CASE severity_level WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END, violation_id LIMIT 100""")(
    lambda t: t["violation_log"].select("violation_id", "severity_level").orderBy(PR.severity_rank(col("severity_level")), "violation_id").limit(100))
register("sr03_rule_limit", P, "SELECT provider_id FROM providers ORDER BY source_confidence, provider_id LIMIT 1000")(
    lambda t: t["providers"].select("provider_id", "source_confidence").orderBy("source_confidence", "provider_id").limit(1000).select("provider_id"))
register("sr04_ordered_inner_limit", ("providers", "facilities", "affiliations"), """
SELECT 'provider_no_affiliations' AS entity_type, provider_id AS entity_id FROM providers WHERE record_status = 'ACTIVE'
   AND provider_id NOT IN (SELECT provider_id FROM affiliations) ORDER BY 2 LIMIT 50""")(
    lambda t: R.orphan_rows(_ST(t)).where(col("entity_type") == "provider_no_affiliations").orderBy("entity_id").limit(50).select("entity_type", "entity_id"))
register("sr05_top_k", (), """
(SELECT 'largest' AS side, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15) UNION ALL
(SELECT 'smallest', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 15)""")(
    lambda t: A.top_k(t["orders"].select(lit("largest").alias("side"), "o_orderkey", "o_totalprice"), "o_totalprice", 15, "o_orderkey").unionByName(
        A.top_k(t["orders"].select(lit("smallest").alias("side"), "o_orderkey", "o_totalprice"), "o_totalprice", 15, "o_orderkey", False)))
register("sr06_last_months", ("activities",), """
SELECT strftime(activity_date, '%Y-%m') AS month, count(*) AS n FROM activities GROUP BY 1 ORDER BY 1 DESC LIMIT 12""")(
    lambda t: t["activities"].groupBy(F.date_format("activity_date", "yyyy-MM").alias("month")).agg(F.count(lit(1)).alias("n"))
    .orderBy(col("month").desc()).limit(12).orderBy("month"))
register("st01_union_orphans", ("providers", "facilities", "affiliations"), """
SELECT 'affiliation_missing_provider' AS kind, count(*) AS n FROM affiliations WHERE provider_id NOT IN (SELECT provider_id FROM providers)
UNION ALL SELECT 'affiliation_missing_facility', count(*) FROM affiliations WHERE facility_id NOT IN (SELECT facility_id FROM facilities)
UNION ALL SELECT 'provider_no_affiliations', count(*) FROM providers WHERE record_status = 'ACTIVE' AND provider_id NOT IN (SELECT provider_id FROM affiliations)
UNION ALL SELECT 'facility_no_providers', count(*) FROM facilities WHERE facility_id NOT IN (SELECT facility_id FROM affiliations)""")(
    lambda t: _kind_counts(R.orphan_rows(_ST(t))))


def _kind_counts(orphans):
    kinds = ("affiliation_missing_provider", "affiliation_missing_facility", "provider_no_affiliations", "facility_no_providers")
    return orphans.agg(*[F.count_if(col("entity_type") == k).alias(k) for k in kinds]).unpivot([], list(kinds), "kind", "n")


register("st02_union_literal", P, "SELECT 'PROVIDERS' AS item, count(*) AS n FROM providers UNION ALL SELECT 'STATUS', 1")(
    lambda t: t["providers"].agg(F.count(lit(1)).alias("n")).select(lit("PROVIDERS").alias("item"), "n").unionByName(
        t.spark.range(1).select(lit("STATUS").alias("item"), lit(1).cast("bigint").alias("n"))))
register("st03_dedup", (), "SELECT DISTINCT user_id, event_type FROM events")(lambda t: t["events"].select("user_id", "event_type").dropDuplicates())
register("st04_ragged_concat", ("providers", "facilities"), """
SELECT provider_id, full_name, NULL AS facility_id, NULL AS facility_name FROM providers UNION ALL SELECT NULL, NULL, facility_id, facility_name FROM facilities""")(
    lambda t: t["providers"].select("provider_id", "full_name").unionByName(t["facilities"].select("facility_id", "facility_name"), allowMissingColumns=True))
register("st05_expected_minus_found", ("facilities",), """
SELECT t AS facility_type FROM (SELECT unnest(['Hospital', 'Nursing Home', 'Surgery Center', 'Urgent Care']) AS t)
WHERE t NOT IN (SELECT facility_type FROM facilities)""")(
    lambda t: t.spark.createDataFrame([("Hospital",), ("Nursing Home",), ("Surgery Center",), ("Urgent Care",)], "facility_type string").join(
        t["facilities"].select("facility_type").distinct(), "facility_type", "left_anti"))

# --- scalar functions
register("sf01_text_functions", P, """
SELECT provider_id, upper(trim(full_name)) AS u, length(full_name) AS n, substr(full_name, 1, 3) AS s, instr(email, '@') AS i,
       replace(replace(phone_number, '(', ''), ')', '') AS r, concat(coalesce(first_name, '?'), '/', coalesce(last_name, '?')) AS c,
       printf('%s (%d)', provider_id, years_in_practice) AS f FROM providers""")(
    lambda t: t["providers"].select(
        "provider_id", F.upper(F.trim("full_name")).alias("u"), F.length("full_name").alias("n"), F.substring("full_name", 1, 3).alias("s"),
        F.instr("email", "@").cast("bigint").alias("i"),
        F.replace(F.replace("phone_number", lit("("), lit("")), lit(")"), lit("")).alias("r"),
        F.concat(F.coalesce("first_name", lit("?")), lit("/"), F.coalesce("last_name", lit("?"))).alias("c"),
        F.format_string("%s (%d)", "provider_id", "years_in_practice").alias("f")))
register("sf02_phone_length", P, "SELECT provider_id, length(translate(phone_number, '()-', '')) AS n, length(translate(phone_number, '()-', '')) <> 10 AS bad FROM providers")(
    lambda t: t["providers"].select("provider_id", F.length(PR.bare_phone(col("phone_number"))).alias("n"), PR.bad_phone_length(col("phone_number")).alias("bad")))
register("sf03_email_domain", P, """
SELECT substr(email, instr(email, '@') + 1) AS domain, count(*) AS n FROM providers WHERE email LIKE '%@%' AND record_status = 'ACTIVE' GROUP BY 1""")(
    lambda t: t["providers"].where(PR.like_ci(col("email"), "%@%") & (col("record_status") == "ACTIVE")).groupBy(
        F.expr("substr(email, instr(email, '@') + 1)").alias("domain")).agg(F.count(lit(1)).alias("n")))
def soundex_sql(name: str) -> str:
    """Soundex of a name that begins with a letter: consonants as digits, equal neighbours (H and W between them) once."""
    code = f"translate(regexp_replace(upper({name}), '[^A-Z]', 'A', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230127022455012623017202')"
    digits = f"replace(concat(replace({code}[1], '7', '0'), substr({code}, 2)), '7', '')"
    for d in "123456":
        digits = f"regexp_replace({digits}, '{d}+', '{d}', 'g')"
    return f"CASE WHEN {name} IS NOT NULL THEN rpad(concat(upper({name})[1], left(replace(substr({digits}, 2), '0', ''), 3)), 4, '0') END"


register("sf04_name_block", P, """
SELECT concat(upper(first_name[1]), upper(last_name[1]), length(last_name)) AS block, count(*) AS n FROM providers
WHERE first_name IS NOT NULL AND last_name IS NOT NULL GROUP BY 1""")(
    lambda t: t["providers"].where(col("first_name").isNotNull() & col("last_name").isNotNull()).groupBy(
        F.concat(F.upper(F.substring("first_name", 1, 1)), F.upper(F.substring("last_name", 1, 1)), F.length("last_name").cast("string")).alias("block"))
    .agg(F.count(lit(1)).alias("n")))
register("sf05_soundex", P, f"""
SELECT {soundex_sql('last_name')} AS code, count(*) AS n FROM providers GROUP BY 1""")(
    lambda t: t["providers"].groupBy(F.soundex("last_name").alias("code")).agg(F.count(lit(1)).alias("n")))
register("sf06_similarity", P, f"SELECT provider_id, round({similarity_sql('full_name', 'last_name')}, 6) AS sim FROM providers WHERE full_name IS NOT NULL AND last_name IS NOT NULL")(
    lambda t: t["providers"].where(col("full_name").isNotNull() & col("last_name").isNotNull()).select(
        "provider_id", F.round(X.trigram_similarity(col("full_name"), col("last_name")), 6).alias("sim")))
register("sf07_dates", ("affiliations",), """
SELECT provider_id, facility_id, year(start_date) AS y, strftime(start_date, '%Y-%m') AS ym, CAST(date_trunc('month', start_date) AS DATE) AS m,
       date_diff('day', start_date, DATE '2025-01-01') AS age, CAST(start_date + INTERVAL 120 MONTH AS DATE) AS plus10 FROM affiliations""")(
    lambda t: t["affiliations"].select(
        "provider_id", "facility_id", F.year("start_date").alias("y"), F.date_format("start_date", "yyyy-MM").alias("ym"),
        F.trunc("start_date", "month").alias("m"), F.datediff(lit(ASOF), "start_date").alias("age"), F.add_months("start_date", 120).alias("plus10")))
RR = ("research_rows",)
_each = lambda expr, out: (lambda t: t["research_rows"].select("row_ordinal", expr().alias(out)))
register("sf08_integers", RR, """
SELECT row_ordinal, TRY_CAST(nullif(regexp_extract(sample_size, '\\d+'), '') AS BIGINT) AS first_int,
       CAST(list_sum(CAST(regexp_extract_all(sample_size, '\\d+') AS BIGINT[])) AS BIGINT) AS sum_ints, TRY_CAST(nullif(regexp_extract(severe, '\\d+\\.?\\d*'), '') AS DOUBLE) AS first_dec
FROM research_rows""")(lambda t: t["research_rows"].select(
    "row_ordinal", X.first_integer(col("sample_size")).alias("first_int"),
    F.aggregate(X.all_integers(col("sample_size")), lit(0).cast("bigint"), lambda a, x: a + x).alias("sum_ints"),
    X.first_decimal(col("severe")).alias("first_dec")))
register("sf09_patients", RR, "SELECT row_ordinal, TRY_CAST(nullif(regexp_extract(sample_size, 'patients:\\s*(\\d+)', 1), '') AS BIGINT) AS patients FROM research_rows")(
    _each(lambda: X.patients(col("sample_size")), "patients"))
register("sf10_percents", RR, """
SELECT row_ordinal, TRY_CAST(nullif(regexp_extract(accuracy_text, '(\\d+(?:\\.\\d+)?)%', 1), '') AS DOUBLE) AS first_pct,
       CAST(len(regexp_extract_all(accuracy_text, '(\\d+(?:\\.\\d+)?)%', 1)) AS INT) AS n_pct FROM research_rows WHERE accuracy_text IS NOT NULL""")(
    lambda t: t["research_rows"].where(col("accuracy_text").isNotNull()).select(
        "row_ordinal", X.first_percent(col("accuracy_text")).alias("first_pct"), F.size(X.all_percents(col("accuracy_text"))).alias("n_pct")))
register("sf11_odds_ratio", RR, "SELECT row_ordinal, TRY_CAST(nullif(regexp_extract(severe, 'OR[:\\s]*(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS odds FROM research_rows")(
    _each(lambda: X.odds_ratio(col("severe")), "odds"))
register("sf12_accuracy", RR, """
SELECT row_ordinal, TRY_CAST(nullif(regexp_extract(accuracy_text, '(?i)sensitivity[:\\s]*(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS sens,
       TRY_CAST(nullif(regexp_extract(accuracy_text, '(?i)specificity[:\\s]*(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS spec FROM research_rows""")(
    lambda t: t["research_rows"].select("row_ordinal", X.sensitivity(col("accuracy_text")).alias("sens"), X.specificity(col("accuracy_text")).alias("spec")))
AGE_SQL = """a AS (SELECT row_ordinal, round(list_avg(CAST(regexp_extract_all(age, '\\d+\\.?\\d*') AS DOUBLE[])), 6) AS age_mean FROM research_rows)"""
register("sf13_age", RR, f"""
WITH {AGE_SQL} SELECT *, CASE WHEN age_mean <= 0 THEN NULL WHEN age_mean <= 18 THEN 'pediatric' WHEN age_mean <= 40 THEN 'young_adult'
  WHEN age_mean <= 65 THEN 'middle_aged' WHEN age_mean <= 100 THEN 'elderly' END AS age_group, (age_mean >= 65) AS is_elderly FROM a""")(
    lambda t: t["research_rows"].select("row_ordinal", F.round(X.age_mean(col("age")), 6).alias("age_mean")).select(
        "*", X.age_group(col("age_mean")).alias("age_group"), (col("age_mean") >= 65).alias("is_elderly")))
register("sf14_yes_flag", RR, "SELECT row_ordinal, lower(clinical_improvement) LIKE 'y%' AS improved FROM research_rows")(
    _each(lambda: X.yes_flag(col("clinical_improvement")), "improved"))
register("sf15_severity_text", RR, """
SELECT row_ordinal, CASE WHEN lower(severe_significant) LIKE '%severe%' THEN 3 WHEN lower(text) LIKE '%critical%' THEN 4 WHEN lower(text) LIKE '%mild%' THEN 1 ELSE 2 END AS severity
FROM research_rows""")(_each(lambda: X.severity_from_text(col("text")), "severity"))
register("sf16_split_cell", RR, """
SELECT row_ordinal, v AS item FROM (SELECT row_ordinal, unnest(list_transform(string_split(sample_size, ';'), lambda x: trim(x))) AS v FROM research_rows) WHERE v NOT IN ('', '-')""")(
    lambda t: t["research_rows"].select("row_ordinal", F.explode(X.split_cell(col("sample_size"))).alias("item")))
register("sf17_json_array", (), """
SELECT event_id, unnest([json_extract_string(props, '$.k'), event_type]) AS code FROM events""")(
    lambda t: t["events"].select("event_id", F.to_json(F.array(F.get_json_object("props", "$.k"), col("event_type"))).alias("codes")).select(
        "event_id", F.explode(F.from_json("codes", "array<string>")).alias("code")))
register("sf18_fingerprint", (), "SELECT doc_id, sha256(lower(trim(text)))[:16] AS fp FROM documents")(
    lambda t: t["documents"].select("doc_id", X.fingerprint(col("text")).alias("fp")))
register("sf20_half_even", (), "SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity * 0.125::DOUBLE, 2) AS r FROM lineitem")(
    lambda t: t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", F.bround(col("l_quantity") * 0.125, 2).alias("r")))

"""Provider ETL, matching, golden records, change capture, business rules, rule runs, sources and sinks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from cohortlens.fixtures import ASOF
from cohortlens.functions.extract import fingerprint
from cohortlens.operators import joins as J
from cohortlens.operators import master as M
from cohortlens.plans import runner as RN
from cohortlens.plans import saved as SV
from cohortlens.plans.queries_c_basics import similarity_sql, soundex_sql
from cohortlens.plans.registry import SQL, register
from cohortlens.sources import reports as RP
from cohortlens.sources import tables as IO
from cohortlens.session import scratch_path

col, lit = F.col, F.lit
P = ("providers",)
S3 = ("source1", "source2", "source3")

# --- ETL
_PARTS = "list_filter(regexp_split_to_array(regexp_replace(trim({0}), '[^\\w\\s\\-'']', '', 'g'), '\\s+'), lambda x: x <> '')"
_ETL = f"""
WITH a AS (
  SELECT 'PROV_' || coalesce(replace(author_id, ' ', '_')[:20], lpad(CAST(row_no AS VARCHAR), greatest(6, length(CAST(row_no AS VARCHAR)))::INT, '0')) AS provider_id,
         coalesce(nullif(full_name, ''), nullif(authors, ''), 'Provider ' || row_no) AS full_name, license_state, birth_year FROM authors),
b AS (SELECT *, {_PARTS.format('full_name')} AS p, regexp_replace(md5(provider_id), '[^0-9]', '', 'g') || regexp_replace(md5(provider_id || '#'), '[^0-9]', '', 'g') AS d FROM a) """
register("et01_parse_name", ("authors",), f"""
WITH b AS (SELECT row_no, {_PARTS.format('full_name')} AS p FROM authors)
SELECT row_no, if(len(p) > 0, p[1], NULL) AS first_name, if(len(p) > 0, p[-1], NULL) AS last_name, if(len(p) > 2, p[2][1], NULL) AS middle_initial FROM b""")(
    lambda t: M.parse_name(t["authors"].select("row_no", "full_name"), "full_name").drop("full_name"))
register("et02_npi", P, "SELECT provider_id, (regexp_replace(md5(provider_id), '[^0-9]', '', 'g') || regexp_replace(md5(provider_id || '#'), '[^0-9]', '', 'g'))[:10] AS npi FROM providers")(
    lambda t: t["providers"].select("provider_id", M.npi_from_id(col("provider_id")).alias("npi")))
register("et03_license", P, "SELECT provider_id, license_state || upper(md5(license_state || provider_id)[:8]) AS license FROM providers")(
    lambda t: t["providers"].select("provider_id", M.license_from_id(col("license_state"), col("provider_id")).alias("license")))
register("et04_authors_to_providers", ("authors",), _ETL + """
SELECT provider_id, d[:10] AS npi_number, full_name, if(len(p) > 0, p[1], NULL) AS first_name, if(len(p) > 0, p[-1], NULL) AS last_name,
       if(len(p) > 2, p[2][1], NULL) AS middle_initial, license_state || upper(md5(license_state || provider_id)[:8]) AS license_number, license_state, birth_year,
       greatest(0, 2025 - birth_year - 25) AS years_in_practice, 'AUTHORS_TRANSFORMED' AS data_source, 'ACTIVE' AS record_status, TRUE AS is_golden_record FROM b""")(
    lambda t: M.authors_to_providers(t["authors"]))

# --- matching
register("er01_name_variants", ("source1", "source2"), """
WITH u AS (SELECT license_state || 'x' AS last_name, first_name, full_name FROM source1 UNION ALL SELECT license_state || 'x', first_name, full_name FROM source2),
s AS (SELECT CASE last_name WHEN 'CAx' THEN 'C200' WHEN 'NYx' THEN 'N200' WHEN 'TXx' THEN 'T200' WHEN 'MAx' THEN 'M200' ELSE 'X000' END AS soundex_last, first_name[1] AS first_initial, full_name FROM u),
g AS (SELECT soundex_last, first_initial, count(DISTINCT full_name) AS name_variations, count(*) AS total_records FROM s GROUP BY ALL HAVING count(DISTINCT full_name) > 1)
SELECT *, CASE WHEN name_variations = 2 AND total_records > 5 THEN 'HIGH_CONFIDENCE' WHEN name_variations <= 3 AND total_records > 2 THEN 'MEDIUM_CONFIDENCE' ELSE 'LOW_CONFIDENCE' END AS duplicate_confidence FROM g""")(
    lambda t: M.name_variants(t["source1"].select(F.concat("license_state", lit("x")).alias("last_name"), "first_name", "full_name").unionByName(
        t["source2"].select(F.concat("license_state", lit("x")).alias("last_name"), "first_name", "full_name")), all_levels=True))
register("er01b_name_variants_listed", ("source1", "source2"), """
WITH u AS (SELECT license_state || 'x' AS last_name, first_name, full_name FROM source1 UNION ALL SELECT license_state || 'x', first_name, full_name FROM source2),
s AS (SELECT CASE last_name WHEN 'CAx' THEN 'C200' WHEN 'NYx' THEN 'N200' WHEN 'TXx' THEN 'T200' WHEN 'MAx' THEN 'M200' ELSE 'X000' END AS soundex_last, first_name, full_name FROM u),
g AS (SELECT soundex_last, first_name[1] AS first_initial, count(DISTINCT full_name) AS name_variations, count(*) AS total_records, string_agg(DISTINCT full_name, '; ' ORDER BY full_name) AS all_variations
      FROM s GROUP BY ALL HAVING count(DISTINCT full_name) > 1),
c AS (SELECT *, CASE WHEN name_variations = 2 AND total_records > 5 THEN 'HIGH_CONFIDENCE' WHEN name_variations <= 3 AND total_records > 2 THEN 'MEDIUM_CONFIDENCE' ELSE 'LOW_CONFIDENCE' END AS duplicate_confidence FROM g)
SELECT * FROM c WHERE duplicate_confidence <> 'LOW_CONFIDENCE'""")(
    lambda t: M.name_variants(t["source1"].select(F.concat("license_state", lit("x")).alias("last_name"), "first_name", "full_name").unionByName(
        t["source2"].select(F.concat("license_state", lit("x")).alias("last_name"), "first_name", "full_name"))))
register("er02_npi_usage", P, """
WITH n AS (SELECT * FROM providers WHERE npi_number IS NOT NULL),
g AS (SELECT npi_number, count(*) AS usage_count, count(DISTINCT provider_id) AS distinct_providers FROM n GROUP BY 1),
b AS (SELECT *, CASE WHEN distinct_providers > 1 THEN 'DUPLICATE_NPI' ELSE 'INVALID_FORMAT' END AS validation_status FROM g WHERE distinct_providers > 1 OR length(npi_number) <> 10)
SELECT b.*, full_name AS associated_name, count(*) AS name_count FROM b JOIN n USING (npi_number) GROUP BY ALL""")(
    lambda t: M.npi_usage(t["providers"]))
_EXACT = """
a3 AS (SELECT 'source1' AS source, * FROM source1 UNION ALL SELECT 'source2', * FROM source2 UNION ALL SELECT 'source3', * FROM source3),
k1 AS (SELECT npi_number FROM a3 WHERE npi_number IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) = 3),
e AS (SELECT 'NPI_MATCH' AS match_type, npi_number AS match_key, source, provider_id FROM a3 SEMI JOIN k1 USING (npi_number))"""
_FUZZY = f"""
f0 AS (SELECT source, provider_id, concat_ws('|', {soundex_sql('last_name')}, first_name[1], license_number) AS match_key FROM a3
       WHERE last_name IS NOT NULL AND first_name IS NOT NULL AND license_number IS NOT NULL
         AND (source = 'source2' OR (source = 'source1' AND provider_id NOT IN (SELECT provider_id FROM e WHERE source = 'source1')))),
k2 AS (SELECT match_key FROM f0 GROUP BY 1 HAVING count(DISTINCT source) = 2),
f AS (SELECT 'FUZZY_MATCH' AS match_type, match_key, source, provider_id FROM f0 SEMI JOIN k2 USING (match_key))"""
_INST = f"""
nn AS (SELECT a.n AS n1, b.n AS n2, {similarity_sql('a.n', 'b.n')} AS similarity
       FROM (SELECT DISTINCT full_name AS n FROM source1 WHERE full_name IS NOT NULL) a, (SELECT DISTINCT full_name AS n FROM source2 WHERE full_name IS NOT NULL) b),
np AS (SELECT * FROM nn WHERE similarity > 0.8),
i0 AS (SELECT n1 || '~' || n2 || '@' || facility_id AS match_key, 'source1' AS source, s.provider_id, similarity FROM source1 s JOIN np ON s.full_name = n1 JOIN affiliations a ON a.provider_id = s.provider_id
       UNION ALL SELECT n1 || '~' || n2 || '@' || facility_id, 'source2', s.provider_id, similarity FROM source2 s JOIN np ON s.full_name = n2 JOIN affiliations a ON a.provider_id = s.provider_id),
k3 AS (SELECT match_key FROM i0 GROUP BY 1 HAVING count(DISTINCT source) = 2),
i AS (SELECT 'INSTITUTIONAL_MATCH' AS match_type, match_key, source, provider_id, similarity FROM i0 SEMI JOIN k3 USING (match_key))"""
_s = lambda t: (t["source1"], t["source2"], t["source3"])
register("er03_exact", S3, f"WITH {_EXACT.strip()} SELECT * FROM e")(lambda t: M.exact_matches(*_s(t)))
register("er04_fuzzy", S3, f"WITH {_EXACT.strip()}, {_FUZZY} SELECT * FROM f")(
    lambda t: M.fuzzy_matches(t["source1"], t["source2"], M.exact_matches(*_s(t))))
register("er05_institutional", (*S3, "affiliations"), f"WITH {_INST.strip()} SELECT * REPLACE (round(similarity, 6) AS similarity) FROM i")(
    lambda t: M.institutional_matches(t["source1"], t["source2"], t["affiliations"]).withColumn("similarity", F.round("similarity", 6)))
register("er06_stacked", (*S3, "affiliations"), f"""WITH {_EXACT.strip()}, {_FUZZY}, {_INST}
SELECT *, 1.0::DOUBLE AS score FROM e UNION ALL SELECT *, 0.9::DOUBLE FROM f UNION ALL SELECT match_type, match_key, source, provider_id, round(similarity, 6) FROM i""")(
    lambda t: M.all_matches(*_s(t), t["affiliations"]).withColumn("score", F.round("score", 6)))
_FIELDS = ("full_name", "email", "phone_number", "npi_number")
_srcs = lambda t: {n: t[n] for n in S3}
register("er07_credibility", S3, """
SELECT 'source1' AS source, provider_id, email, 0.95::DOUBLE AS weight FROM source1 UNION ALL SELECT 'source2', provider_id, email, 0.85 FROM source2
UNION ALL SELECT 'source3', provider_id, email, 0.75 FROM source3""")(
    lambda t: M.weighted_sources(_srcs(t), ["email"]).select("source", "provider_id", "email", "weight"))
_key12 = lambda t: M._keys_in_all([M._members(t[n], n, col("license_number"), "LICENSE") for n in ("source1", "source2")])
register("er08_conflicts", S3, """
WITH j AS (SELECT a.license_number AS match_key, a.email AS e1, b.email AS e2, a.phone_number AS p1, b.phone_number AS p2, a.last_updated > b.last_updated AS newer1
           FROM source1 a JOIN source2 b ON a.license_number = b.license_number)
SELECT match_key, CASE WHEN e1 <> e2 THEN if(newer1, e1, e2) ELSE coalesce(e1, e2) END AS resolved_email,
       CASE WHEN p1 <> p2 THEN if(newer1, p1, p2) ELSE coalesce(p1, p2) END AS resolved_phone_number,
       coalesce(e1 <> e2, FALSE) AS conflict_email, coalesce(p1 <> p2, FALSE) AS conflict_phone_number FROM j""")(
    lambda t: M.resolve_conflicts(_key12(t), M.stack_sources({n: t[n] for n in ("source1", "source2")}, ["email", "phone_number"]), ["email", "phone_number"]))
_pick = lambda c: f"arg_max({c}, (w, last_updated, node)) FILTER (WHERE {c} IS NOT NULL) AS {c}"
register("er09_golden", (*S3, "affiliations"), f"""WITH RECURSIVE {_EXACT.strip()}, {_FUZZY}, {_INST.strip()},
m AS (SELECT source || ':' || provider_id AS node, match_type || match_key AS k FROM e UNION ALL SELECT source || ':' || provider_id, match_type || match_key FROM f
      UNION ALL SELECT source || ':' || provider_id, match_type || match_key FROM i),
lk AS (SELECT DISTINCT a.node AS x, b.node AS y FROM (SELECT k, min(node) AS node FROM m GROUP BY 1) a JOIN m b USING (k)),
sy AS (SELECT x, y FROM lk UNION SELECT y, x FROM lk),
r(root, node) AS (SELECT x, x FROM sy UNION SELECT r.root, sy.y FROM r JOIN sy ON sy.x = r.node),
c AS (SELECT node, min(root) AS golden_id FROM r GROUP BY 1),
z AS (SELECT a3.*, source || ':' || provider_id AS node, CASE source WHEN 'source1' THEN 0.95::DOUBLE WHEN 'source2' THEN 0.85 ELSE 0.75 END AS w FROM a3),
g AS (SELECT z.*, coalesce(golden_id, z.node) AS golden_id FROM z LEFT JOIN c ON c.node = z.node)
SELECT golden_id, {", ".join(_pick(c) for c in _FIELDS)}, count(*) AS record_count, count(DISTINCT source) AS source_count, round(avg(w), 6) AS confidence,
       arg_max(source, (w, last_updated, node)) AS lead_source, max(last_updated) AS newest_update FROM g GROUP BY 1""")(
    lambda t: M.golden_records(M.all_matches(*_s(t), t["affiliations"]), M.weighted_sources(_srcs(t), _FIELDS), _FIELDS).withColumn("confidence", F.round("confidence", 6)))


def _fuzzy_pairs(t):
    f = M.fuzzy_matches(t["source1"], t["source2"], M.exact_matches(*_s(t)))
    side = lambda s, n: f.where(col("source") == s).select("match_key", col("provider_id").alias(n))
    return side("source1", "s1_id").join(side("source2", "s2_id"), "match_key").drop("match_key")


register("jn10_shared_facility", (*S3, "affiliations"), f"""WITH {_EXACT.strip()}, {_FUZZY},
c AS (SELECT a.provider_id AS s1_id, b.provider_id AS s2_id FROM f a JOIN f b ON a.match_key = b.match_key AND a.source = 'source1' AND b.source = 'source2')
SELECT * FROM c WHERE EXISTS (SELECT 1 FROM affiliations x JOIN affiliations y ON x.facility_id = y.facility_id WHERE x.provider_id = s1_id AND y.provider_id = s2_id)""")(
    lambda t: J.exists_shared_facility(_fuzzy_pairs(t), t["affiliations"]))

# --- change capture
_COLS4 = ("full_name", "email", "phone_number", "record_status")
_img = lambda s: "concat_ws(', ', " + ", ".join(f"'{c}=' || coalesce({s}.{c}, 'NULL')" for c in sorted(_COLS4)) + ")"
_chg = "concat_ws(', ', " + ", ".join(f"CASE WHEN o.{c} IS DISTINCT FROM n.{c} THEN '{c}=' || coalesce(n.{c}, 'NULL') END" for c in sorted(_COLS4)) + ")"


def _text(c):
    return F.concat_ws(", ", F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], lit("="), F.coalesce(e["value"], lit("NULL"))))))


register("cd01_capture", ("snapshot_old", "snapshot_new"), f"""
WITH j AS (SELECT coalesce(o.provider_id, n.provider_id) AS record_id, CASE WHEN o.provider_id IS NULL THEN 'INSERT' WHEN n.provider_id IS NULL THEN 'DELETE' WHEN {_chg} <> '' THEN 'UPDATE' END AS operation_type,
  {_chg} AS changed, {_img('o')} AS b, {_img('n')} AS a FROM snapshot_old o FULL JOIN snapshot_new n ON o.provider_id = n.provider_id)
SELECT record_id, operation_type, if(operation_type = 'UPDATE', changed, '') AS changed_columns, if(operation_type = 'INSERT', '', b) AS before_values,
       if(operation_type = 'DELETE', '', a) AS after_values FROM j WHERE operation_type IS NOT NULL""")(
    lambda t: M.capture_changes(t["snapshot_old"], t["snapshot_new"], "provider_id").withColumns(
        {c: _text(col(c)) for c in ("changed_columns", "before_values", "after_values")}))
_DAY = dt.date(2024, 1, 15)
_HIT = "processed_status = 'PENDING' AND CAST(change_timestamp AS DATE) = DATE '2024-01-15'"
register("cd02a_apply_batch", ("change_log",), f"""
SELECT change_id, if({_HIT}, 'COMPLETED', processed_status) AS processed_status, if({_HIT}, 'batch-1', NULL) AS batch_id FROM change_log""")(
    lambda t: M.apply_batch(t["change_log"], _DAY, "batch-1").select("change_id", "processed_status", "batch_id"))
register("cd02b_batch_log", ("change_log",), f"""
SELECT 'batch-1' AS batch_id, DATE '2024-01-15' AS batch_date, 'COMPLETED' AS status, count(*) AS records_processed,
       count(*) FILTER (WHERE operation_type = 'INSERT') AS inserts, count(*) FILTER (WHERE operation_type = 'UPDATE') AS updates,
       count(*) FILTER (WHERE operation_type = 'DELETE') AS deletes FROM change_log WHERE {_HIT}""")(
    lambda t: M.batch_log(t["change_log"], _DAY, "batch-1"))
APPLIED_SQL = """
WITH l AS (SELECT record_id, max_by(operation_type, (change_timestamp, change_id)) AS op, max_by(new_email, (change_timestamp, change_id)) AS e FROM change_log GROUP BY 1)
SELECT coalesce(provider_id, record_id) AS provider_id, full_name, if(record_id IS NULL, email, e) AS email
FROM providers FULL JOIN l ON record_id = provider_id WHERE record_id IS NULL OR op <> 'DELETE'"""
register("cd03_apply_changes", ("providers", "change_log"), APPLIED_SQL)(
    lambda t: M.apply_changes(t["providers"].select("provider_id", "full_name", "email"), t["change_log"].withColumnRenamed("new_email", "email"),
                              "provider_id", ["change_timestamp", "change_id"], ["email"]))

# --- business rules
PFA = ("providers", "facilities", "affiliations")
_d = lambda t: t.pick(*PFA, "activities")
register("br01_max_affiliations", PFA, """
WITH a AS (SELECT DISTINCT provider_id, facility_id, facility_name FROM affiliations JOIN facilities USING (facility_id) WHERE end_date IS NULL)
SELECT 'MAX_AFFILIATIONS' AS rule_name, provider_id, count(*) AS facility_count, 0 AS part, string_agg(facility_name, '; ' ORDER BY facility_name) AS facilities, 'VIOLATION' AS status
FROM a GROUP BY 2 HAVING count(*) > 5""")(lambda t: M.too_many_facilities(_d(t)))
_MON = "WITH m AS (SELECT provider_id, CAST(date_trunc('month', activity_date) AS DATE) AS month, count(*) AS monthly_count FROM activities GROUP BY ALL), "
register("br02_activity_spike", ("activities",), _MON + """
r AS (SELECT *, avg(monthly_count) OVER (PARTITION BY provider_id ORDER BY month ROWS 11 PRECEDING) AS a FROM m)
SELECT 'ACTIVITY_SPIKE' AS rule_name, provider_id, month, monthly_count, round(a, 6) AS rolling_avg, if(monthly_count > a * 3, 'SEVERE_ANOMALY', 'MODERATE_ANOMALY') AS anomaly_level
FROM r WHERE monthly_count > a * 2""")(lambda t: M.activity_spikes(t["activities"]).withColumn("rolling_avg", F.round("rolling_avg", 6)))
register("br03_monthly_anomaly", ("activities",), _MON + """
s AS (SELECT *, avg(monthly_count) OVER (PARTITION BY provider_id) AS a, stddev(monthly_count) OVER (PARTITION BY provider_id) AS d FROM m)
SELECT provider_id, month, monthly_count, round(a, 6) AS avg_monthly, round(d, 6) AS std_monthly, if(monthly_count > a + 2 * d, 'HIGH_ANOMALY', 'MEDIUM_ANOMALY') AS anomaly_level
FROM s WHERE d > 0 AND monthly_count > a + d""")(lambda t: M.monthly_anomalies(t["activities"]).withColumns(
    {c: F.round(c, 6) for c in ("avg_monthly", "std_monthly")}))
register("br04_configured_limits", ("providers", "activities"), _MON + """
p AS (SELECT provider_id, years_in_practice::BIGINT AS y, (graduation_year - birth_year)::BIGINT AS g FROM providers)
SELECT 'max_monthly_activities' AS rule_name, provider_id, monthly_count AS observed FROM m WHERE monthly_count > 3
UNION ALL SELECT 'career_years', provider_id, y FROM p WHERE NOT y BETWEEN 1 AND 60 UNION ALL SELECT 'graduation_age', provider_id, g FROM p WHERE NOT g BETWEEN 22 AND 40""")(
    lambda t: M.configured_limits(_d(t), {**M.LIMITS, "max_monthly_activities": 3}))
register("br05_specialty_limits", PFA, """
WITH l(specialty_primary, typical_facilities, max_patients_per_day) AS (VALUES ('Family Medicine', 2, 30), ('Emergency Medicine', 3, 50), ('Surgery', 1, 10))
SELECT specialty_primary, provider_id, typical_facilities, max_patients_per_day, count(DISTINCT facility_id) AS facility_count
FROM providers JOIN l USING (specialty_primary) JOIN affiliations USING (provider_id) WHERE end_date IS NULL GROUP BY ALL HAVING count(DISTINCT facility_id) > typical_facilities""")(
    lambda t: M.specialty_limits(_d(t)))
register("br06_high_counts", PFA, """
WITH p AS (SELECT provider_id, count(*) AS affiliations, count(DISTINCT state_province) AS states FROM affiliations LEFT JOIN facilities USING (facility_id) GROUP BY 1),
q AS (SELECT quantile_cont(affiliations, 0.95) AS p95 FROM p)
SELECT provider_id, affiliations, states, affiliations > p95 AS above_p95, states > 1 AS multi_state FROM p, q WHERE affiliations > p95 OR states > 1""")(
    lambda t: M.high_affiliation_counts(_d(t)))
register("br07_state_mismatch", PFA, """
SELECT provider_id, facility_id, license_state, state_province FROM affiliations JOIN providers USING (provider_id) JOIN facilities USING (facility_id)
WHERE end_date IS NULL AND license_state <> state_province""")(lambda t: M.state_mismatch(_d(t)))

# --- rule runs
def _rule_sql(name, entity, provider, facility):
    return f"SELECT rule_name, CAST({entity} AS VARCHAR) AS entity_id, {provider} AS provider_id, {facility} AS facility_id, issue_description, severity FROM r_{name}"


def _violations_sql() -> str:
    """All standard rules stacked, built from the checked rule texts."""
    from cohortlens.plans import queries_a_rules as A

    bodies = {n: s for n, _, v, _, s in A._SPEC if v == "standard"}
    ctes, parts = [], []
    for n, s in bodies.items():
        ctes.append(f"r_{n} AS ({s.strip()})")
        if n.startswith("vr05"):
            parts.append(_rule_sql(n, "entity_id", "CASE WHEN entity_type IN ('affiliation_missing_provider', 'provider_no_affiliations') THEN entity_id END",
                                   "CASE WHEN entity_type IN ('affiliation_missing_facility', 'facility_no_providers') THEN entity_id END"))
        else:
            parts.append(_rule_sql(n, "provider_id", "provider_id", "NULL"))
    return "WITH " + ", ".join(ctes) + ", v AS (" + " UNION ALL ".join(parts) + ") "


_V = _violations_sql()
_viol = lambda t: RN.run_rules(t.pick(*PFA), ASOF)
register("rr01_all_rules", PFA, _V + "SELECT * FROM v")(lambda t: _viol(t).drop("details"))
register("rr01b_one_rule", PFA, _V + "SELECT * FROM v WHERE rule_name = 'npi_validation'")(
    lambda t: RN.run_rules(t.pick(*PFA), ASOF, only=["npi_validation"]).drop("details"))
_SET = """s(rule_name, rule_severity) AS (VALUES ('provider_name_inconsistency', 'HIGH'), ('npi_validation', 'CRITICAL'), ('affiliation_anomaly', 'MEDIUM'),
  ('temporal_consistency', 'HIGH'), ('cross_reference_integrity', 'CRITICAL'))"""
register("rr02_settings", PFA, _V + f", {_SET} SELECT rule_name, entity_id, severity, coalesce(rule_severity, 'MEDIUM') AS rule_severity FROM v LEFT JOIN s USING (rule_name)")(
    lambda t: RN.apply_settings(_viol(t), RN.settings_table(t.spark)).select("rule_name", "entity_id", "severity", "rule_severity"))
_sev = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "ERROR"))
register("rr03_rule_summary", PFA, _V + f""", k AS (SELECT *, row_number() OVER (PARTITION BY rule_name ORDER BY entity_id, issue_description) AS r FROM v)
SELECT rule_name, count(*) AS total_violations, {_sev}, count(DISTINCT entity_id) AS distinct_entities, count(DISTINCT provider_id) AS distinct_providers,
       count(DISTINCT facility_id) AS distinct_facilities, string_agg(entity_id, ', ' ORDER BY entity_id) FILTER (WHERE r <= 5) AS samples FROM k GROUP BY 1""")(
    lambda t: RN.rule_summary(_viol(t)))
register("rr04_run_summary", PFA, _V + "SELECT severity, count(*) AS violations, count(DISTINCT rule_name) AS rules FROM v GROUP BY 1")(lambda t: RN.run_summary(_viol(t)))
register("rr05a_saved_results", ("call_log",), """
WITH s AS (SELECT sha256(lower(trim(query_name)))[:16] AS fingerprint, event_id, ts AS saved_at, ts + INTERVAL 60 MINUTE AS expires_at, (event_id * 37) % 80000 AS row_count FROM call_log)
SELECT fingerprint, max(saved_at) AS saved_at, max_by(event_id, (saved_at, event_id)) AS event_id, max_by(row_count, (saved_at, event_id)) AS row_count
FROM s WHERE expires_at > TIMESTAMP '2024-01-30 12:00:00' AND row_count <= 50000 GROUP BY 1""")(
    lambda t: RN.newest_valid(t["call_log"].select(
        fingerprint(col("query_name")).alias("fingerprint"), "event_id", col("ts").alias("saved_at"), (col("ts") + F.expr("INTERVAL 60 MINUTE")).alias("expires_at"),
        (col("event_id") * 37 % 80000).alias("row_count")), dt.datetime(2024, 1, 30, 12)).select("fingerprint", "saved_at", "event_id", "row_count"))
register("rr05b_hit_rate", ("call_log",), """
SELECT count(*) AS lookups, count(*) FILTER (WHERE cache_hit) AS hits, count(*) FILTER (WHERE NOT cache_hit) AS misses, round(avg(cache_hit::INT) * 100, 6) AS hit_rate FROM call_log""")(
    lambda t: RN.hit_statistics(t["call_log"]).withColumn("hit_rate", F.round("hit_rate", 6)))
def _reused(t):
    """Second of two runs over the same files: what the first one saved is read back."""
    store = scratch_path(t.spark, "saved")
    inputs = {n: f"{t.folder}/{n}.parquet" for n in ("customer", "supplier", "orders", "lineitem")}
    at = dt.datetime(2025, 1, 1, 12)
    SV.run_rules_saved(t.pick(*PFA), inputs, store, ASOF, at)
    return SV.run_rules_saved(t.pick(*PFA), inputs, store, ASOF, at + dt.timedelta(minutes=4)).drop("details")


register("rr05c_saved_rules", PFA, _V + "SELECT *, count(*) OVER (PARTITION BY rule_name) <= 50000 AS from_saved FROM v")(_reused)
register("rr06_critical", PFA, _V + "SELECT count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) AS total FROM v")(lambda t: RN.critical_count(_viol(t)))

# --- sources and sinks
SRW = ("study_rows",)


_CSV = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _csv_folder(t):
    """Study rows with their whole texts as category folders with one CSV per table, each in the order of its ids."""
    base = scratch_path(t.spark, "categories")
    rows = t["study_rows"].withColumnRenamed("row_ordinal", "study_id")
    for r in rows.select("source_category", "source_table").distinct().collect():  # one row per table
        part = rows.where((col("source_category") == r[0]) & (col("source_table") == r[1])).drop("source_category", "source_table")
        part.orderBy("study_id").write.options(**_CSV).csv(f"{base}/{r[0]}/{r[1]}.csv")
    return base


_HAVE = "SELECT source_category AS c, count(DISTINCT source_table) AS n FROM study_rows GROUP BY 1"
# The CSV reader gives line breaks inside a cell as \n; empty cells are NULL.
_CELL = "nullif(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '')"
register("io01_category_tables", SRW, f"""
SELECT source_category, source_table, row_number() OVER (PARTITION BY source_category, source_table ORDER BY study_id) - 1 AS row_ordinal, CAST(study_id AS VARCHAR) AS study_id, sample_size,
       length({_CELL})::INT AS text_length, sha256({_CELL}) AS text_sha256 FROM (SELECT *, row_ordinal AS study_id FROM study_rows)""")(
    lambda t: IO.read_category_tables(t.spark, _csv_folder(t)).select(
        "source_category", "source_table", "row_ordinal", "study_id", "sample_size", F.length("text").alias("text_length"), F.sha2("text", 256).alias("text_sha256")))


register("io07_inventory", SRW, f"""
WITH h AS ({_HAVE}), w AS (SELECT unnest(['1_population', '2_relevant_factors', '3_patient_descriptions', '4_models_and_open_questions', '5_materials', '6_diagnostics',
  '7_therapeutics_interventions_and_clinical_studies', '8_risk_factors']) AS category)
SELECT category, coalesce(n, 0) AS files, n IS NOT NULL AS found, (SELECT count(*) >= 4 FROM h) AS usable FROM w LEFT JOIN h ON c = category""")(
    lambda t: IO.input_inventory(t.spark, _csv_folder(t)))
register("io02_standardize", SRW, """
SELECT row_ordinal, source_table, journal AS journal_name, TRY_CAST(study_date AS TIMESTAMP) AS study_date FROM study_rows""")(
    lambda t: IO.standardize(t["study_rows"].select("row_ordinal", "source_table", col("journal").alias(" Journal Name"),
                                                    col("study_date").cast("string").alias("Study Date "))))
register("io03_unify", SRW, """
SELECT 'patients' AS kind, source_table AS tag, count(*) AS n FROM study_rows WHERE source_category IN ('3_patient_descriptions', '7_therapeutics_interventions_and_clinical_studies') GROUP BY 2
UNION ALL SELECT 'risk', CASE source_table WHEN 'male_gender' THEN 'Male Gender' WHEN 'age' THEN 'Age' ELSE 'Diabetes' END, count(*) FROM study_rows WHERE source_category = '8_risk_factors' GROUP BY 2
UNION ALL SELECT 'therapeutics', source_table, count(*) FROM study_rows WHERE source_category = '7_therapeutics_interventions_and_clinical_studies' GROUP BY 2
UNION ALL SELECT 'diagnostics', source_table, count(*) FROM study_rows WHERE source_category = '6_diagnostics' GROUP BY 2""")(lambda t: _unified(t))


def _unified(t):
    out = None
    for kind, tag in (("patients", "source_table"), ("risk", "risk_factor_type"), ("therapeutics", "study_type"), ("diagnostics", "diagnostic_type")):
        part = IO.unify(t["study_rows"], kind).groupBy(lit(kind).alias("kind"), col(tag).alias("tag")).agg(F.count(lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


register("io04_texts", SRW, """
SELECT source_category, source_table, row_ordinal, 'abstract' AS text_type, text FROM study_rows WHERE length(text) > 50""")(
    lambda t: IO.extract_texts(t["study_rows"].select("source_category", "source_table", "row_ordinal", "journal", col("text").alias("abstract"))))
register("io05_dates", SRW, "SELECT study_date AS date, source_category, count(*) AS study_count FROM study_rows GROUP BY ALL")(lambda t: IO.extract_dates(t["study_rows"]))
register("io06_sample_rows", ("authors",), "SELECT row_no, full_name FROM authors ORDER BY md5(row_no || ':42'), row_no LIMIT 100")(lambda t: IO.sample_rows(t["authors"], "row_no", 100).select("row_no", "full_name"))
def _author_csv(t):
    path = scratch_path(t.spark, "authors")
    t["authors"].orderBy("row_no").select(
        col("author_id").alias("Author_ID"), F.regexp_replace("full_name", "^ | $", "").alias("name"), "authors", "license_state").write.options(**_CSV).csv(path)
    return path


_AUT = """a AS (SELECT row_number() OVER (ORDER BY row_no) - 1 AS row_no, author_id, nullif(regexp_replace(full_name, '^ | $', '', 'g'), '') AS full_name, authors FROM authors)"""
register("io06b_author_csv", ("authors",), f"WITH {_AUT} SELECT * FROM a")(lambda t: IO.read_authors(t.spark, _author_csv(t)))
register("io06c_author_csv_sample", ("authors",), f"WITH {_AUT} SELECT * FROM a ORDER BY md5(row_no || ':42'), row_no LIMIT 100")(
    lambda t: IO.read_authors(t.spark, _author_csv(t), 100))
register("io09_load_summary", PFA, """
SELECT 'providers' AS item, count(*) AS n FROM providers UNION ALL SELECT 'facilities', count(*) FROM facilities UNION ALL SELECT 'affiliations', count(*) FROM affiliations
UNION ALL SELECT 'distinct_specialties', count(DISTINCT specialty_primary) FROM providers UNION ALL SELECT 'distinct_states', count(DISTINCT license_state) FROM providers""")(
    lambda t: IO.load_summary(t.pick(*PFA)))
register("io10_table_overview", PFA, """
WITH o AS (SELECT 'providers' AS table_name, count(*) AS row_count, (SELECT count(*) FROM (SELECT DISTINCT * FROM providers)) AS distinct_rows FROM providers
  UNION ALL SELECT 'facilities', count(*), (SELECT count(*) FROM (SELECT DISTINCT * FROM facilities)) FROM facilities
  UNION ALL SELECT 'affiliations', count(*), (SELECT count(*) FROM (SELECT DISTINCT * FROM affiliations)) FROM affiliations)
SELECT *, (SELECT sum(row_count)::BIGINT FROM o) AS total_rows, (SELECT max_by(table_name, row_count) FROM o) AS largest_table FROM o""")(
    lambda t: IO.table_overview(t.pick(*PFA)))
register("io11_explore", ("facilities",), "SELECT * FROM facilities ORDER BY facility_id LIMIT 10")(lambda t: IO.explore(t["facilities"], "facility_id"))
register("io12_copy", ("affiliations",), "SELECT count(*) AS source_rows, count(*) AS target_rows, TRUE AS matches FROM affiliations")(
    lambda t: IO.copy_and_reconcile(t["affiliations"], scratch_path(t.spark, "copy")))


def _append(t):
    path = scratch_path(t.spark, "append")
    for n in ("providers", "facilities", "affiliations"):
        IO.append_table(t[n], f"{path}/{n}")
        IO.append_table(t[n], f"{path}/{n}")
    return IO.load_summary({n: t.spark.read.parquet(f"{path}/{n}") for n in ("providers", "facilities", "affiliations")})


register("io08_append", PFA, """
SELECT 'providers' AS item, 2 * count(*) AS n FROM providers UNION ALL SELECT 'facilities', 2 * count(*) FROM facilities UNION ALL SELECT 'affiliations', 2 * count(*) FROM affiliations
UNION ALL SELECT 'distinct_specialties', count(DISTINCT specialty_primary) FROM providers UNION ALL SELECT 'distinct_states', count(DISTINCT license_state) FROM providers""")(_append)


_AT = dt.datetime(2025, 1, 1)


def _timed(t):
    found, runs = RN.run_rules_timed(t.pick(*PFA), scratch_path(t.spark, "runs"), ASOF)
    return found, runs, RN.settings_table(t.spark)


def _exported_csv(t):
    path = scratch_path(t.spark, "csv")
    found, runs, settings = _timed(t)
    RP.export_violations(RP.export_rows(found, runs.select("rule_name", "execution_time").join(settings, "rule_name", "left"), _AT), path)
    return t.spark.read.csv(path, header=True, escape='"').select(
        "validation_rule", "entity_id", "provider_id", "facility_id", "issue_description", "severity", "rule_severity",
        (col("execution_time").cast("double") > 0).alias("timed"), col("check_timestamp").cast("timestamp").alias("check_timestamp"))


def _exported_json(t):
    path = scratch_path(t.spark, "json")
    found, runs, settings = _timed(t)
    RP.export_violations(RP.export_documents(found, runs, settings, _AT), path, "json")
    docs = t.spark.read.json(path)
    return docs.select("rule_name", col("severity").alias("rule_severity"), "enabled", "success", "violation_count", (col("execution_time") > 0).alias("timed"),
                       F.explode("violations").alias("v")).select("rule_name", "rule_severity", "enabled", "success", "violation_count", "timed",
                                                                  "v.entity_id", "v.provider_id", "v.facility_id", "v.issue_description", "v.severity")


register("io13_export_csv", PFA, _V + f""", {_SET} SELECT rule_name AS validation_rule, nullif(entity_id, '') AS entity_id, nullif(provider_id, '') AS provider_id, nullif(facility_id, '') AS facility_id,
  nullif(issue_description, '') AS issue_description, severity, rule_severity, TRUE AS timed, TIMESTAMP '2025-01-01 00:00:00' AS check_timestamp FROM v LEFT JOIN s USING (rule_name)""")(_exported_csv)
register("io14_export_json", PFA, _V + f""", {_SET} SELECT rule_name, coalesce(rule_severity, 'MEDIUM') AS rule_severity, TRUE AS enabled, TRUE AS success, count(*) OVER (PARTITION BY rule_name) AS violation_count, TRUE AS timed,
  entity_id, provider_id, facility_id, issue_description, severity FROM v LEFT JOIN s USING (rule_name)""")(_exported_json)
register("io13b_export_rows", PFA, _V + f""", {_SET}
SELECT rule_name AS validation_rule, entity_id, severity, rule_severity, TIMESTAMP '2025-01-01 00:00:00' AS check_timestamp FROM v LEFT JOIN s USING (rule_name)""")(
    lambda t: RP.export_rows(_viol(t), RN.settings_table(t.spark).withColumn("execution_time", lit(0.0)), dt.datetime(2025, 1, 1)).select(
        "validation_rule", "entity_id", "severity", "rule_severity", "check_timestamp"))
register("io15_report", SRW, """
SELECT 'category_summary' AS section, count(DISTINCT source_category) AS n FROM study_rows UNION ALL SELECT 'key_finding', 3""")(lambda t: _report(t))


def _report(t):
    path = scratch_path(t.spark, "report")
    RP.export_report(t["study_rows"], path)
    return t.spark.read.json(path).groupBy("section").agg(F.count(lit(1)).alias("n"))


def _violation_history(t):
    path = scratch_path(t.spark, "violations")
    IO.append_violations(t["violation_log"], path)
    return t.spark.read.parquet(path).groupBy("violation_date", "severity_level").agg(F.count(lit(1)).alias("n"), F.count_distinct("entity_id").alias("entities"))


register("io16b_violation_history", ("violation_log",), "SELECT violation_date, severity_level, count(*) AS n, count(DISTINCT entity_id) AS entities FROM violation_log GROUP BY ALL")(_violation_history)


def _history(t):
    path = scratch_path(t.spark, "history")
    IO.append_quality_metrics(t["quality_log"], path)
    return t.spark.read.parquet(path).groupBy("table_name").agg(F.count(lit(1)).alias("n"), F.max("measurement_date").alias("latest"))


register("io16_metric_history", ("quality_log",), "SELECT table_name, count(*) AS n, max(measurement_date) AS latest FROM quality_log GROUP BY 1")(_history)
del SQL

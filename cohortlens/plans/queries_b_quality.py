"""Quality scores, record scores and constraint checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.fixtures import ASOF
from cohortlens.operators import constraints as C
from cohortlens.operators import records as RL
from cohortlens.operators import scores as S
from cohortlens.plans.registry import register

P = ("providers",)
CONSISTENCY = {
    "phone_format": True, "name_format": True, "date_format": True,
    "categorical_consistency": {"record_status": ["ACTIVE"], "license_state": ["CA", "NY", "TX", "MA"]},
}
VALIDITY = {
    "required_combinations": [["first_name", "last_name"], ["email", "phone_number"]],
    "value_ranges": {"years_in_practice": (0, 60), "source_confidence": (0.1, 1.0)},
    "cross_field_rules": True,
}
_COLS = ("provider_id npi_number full_name first_name last_name email phone_number specialty_primary license_number "
         "license_state license_expiry_date years_in_practice birth_year graduation_year source_confidence last_updated "
         "record_status").split()
_FILLED = " + ".join(f"count(*) FILTER (WHERE regexp_matches(CAST({c} AS VARCHAR), '\\S'))" for c in _COLS)

_COMPLETE = f"SELECT round_even(({_FILLED}) / (count(*) * {len(_COLS)}) * 100, 2) AS completeness FROM providers"


def _chain_sql(steps, name):
    """steps: (ok, seen) conditions; returns SQL for 100 * chained floor / n."""
    cs = ", ".join(f"count(*) FILTER (WHERE ({s}) AND ({o})) AS o{i}, count(*) FILTER (WHERE {s}) AS s{i}"
                   for i, (o, s) in enumerate(steps))
    expr = "CAST(n AS DOUBLE)"
    for i in range(len(steps)):
        expr = f"floor({expr} * (o{i} / s{i}))"
    return f"SELECT round_even({expr} / n * 100, 2) AS {name} FROM (SELECT count(*) AS n, {cs} FROM providers)"


_CONS = _chain_sql([
    (r"regexp_matches(phone_number, '^(\d{3}-\d{3}-\d{4}|\(\d{3}\)\s\d{3}-\d{4}|\d{10}$)')", "phone_number IS NOT NULL"),
    (r"regexp_full_match(full_name, '[A-Za-z\s.,\-'']+')", "full_name IS NOT NULL"),
    ("record_status = 'ACTIVE'", "record_status IS NOT NULL"),
    ("license_state IN ('CA', 'NY', 'TX', 'MA')", "license_state IS NOT NULL"),
], "consistency")
_ACC = _chain_sql([
    (r"regexp_full_match(email, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')", "email IS NOT NULL"),
    (r"regexp_full_match(npi_number, '\d{10}')", "npi_number IS NOT NULL"),
    ("birth_year BETWEEN 1920 AND 2007", "birth_year IS NOT NULL"),
    ("regexp_full_match(license_state, '[A-Z]{2}')", "license_state IS NOT NULL"),
], "accuracy")
_VAL = _chain_sql([
    ("first_name IS NOT NULL AND last_name IS NOT NULL", "TRUE"),
    ("email IS NOT NULL AND phone_number IS NOT NULL", "TRUE"),
    ("years_in_practice BETWEEN 0 AND 60", "years_in_practice IS NOT NULL"),
    ("source_confidence BETWEEN 0.1 AND 1.0", "source_confidence IS NOT NULL"),
    ("graduation_year - birth_year >= 22", "graduation_year - birth_year IS NOT NULL"),
], "validity")
_TIME = """
WITH a AS (SELECT avg(date_diff('day', last_updated, DATE '2025-01-01')) AS age FROM providers)
SELECT round_even(if(age <= 90, 100 - age / 90 * 20, greatest(0, 100 - age / 90 * 50)), 2) AS timeliness FROM a
"""
_UNIQ = """
SELECT round_even((count(DISTINCT provider_id) / count(provider_id) * 100 + count(DISTINCT npi_number) / count(npi_number) * 100
       + count(DISTINCT email) / count(email) * 100) / 3, 2) AS uniqueness FROM providers
"""
_OVERALL = (
    "WITH " + ", ".join(f"m{i} AS ({q.strip()})" for i, q in enumerate((_COMPLETE, _CONS, _ACC, _TIME, _UNIQ, _VAL)))
    + ", r AS (SELECT *, round_even(completeness * 0.25::DOUBLE + consistency * 0.2::DOUBLE + accuracy * 0.25::DOUBLE"
    " + timeliness * 0.1::DOUBLE + uniqueness * 0.15::DOUBLE + validity * 0.05::DOUBLE, 2) AS overall_score"
    " FROM m0, m1, m2, m3, m4, m5)"
    ", o AS (SELECT *, CASE WHEN overall_score >= 95 THEN 'A' WHEN overall_score >= 85 THEN 'B' WHEN overall_score >= 75 THEN 'C'"
    " WHEN overall_score >= 65 THEN 'D' ELSE 'F' END AS grade FROM r) "
)

register("dq01_completeness", P, _COMPLETE)(lambda t: S.completeness(t["providers"]))
register("dq02_consistency", P, _CONS)(lambda t: S.consistency(t["providers"], CONSISTENCY))
register("dq03_accuracy", P, _ACC)(lambda t: S.accuracy(t["providers"], ASOF))
register("dq04_timeliness", P, _TIME)(lambda t: S.timeliness(t["providers"], asof=ASOF))
register("dq05_uniqueness", P, _UNIQ)(lambda t: S.uniqueness(t["providers"]))
register("dq06_validity", P, _VAL)(lambda t: S.validity(t["providers"], VALIDITY))


def _metrics(t):
    return S.quality_metrics(t["providers"], ASOF, consistency_rules=CONSISTENCY, validity_rules=VALIDITY)


register("dq07_overall", P, _OVERALL + "SELECT * FROM o")(_metrics)
_ADVICE = ", ".join(str((d, x, p, r, a)) for d, x, p, r, a in S.ADVICE)
register("dq08_report", P, _OVERALL + f""",
v(dimension, advice_limit, priority, recommendation, action) AS (VALUES {_ADVICE}),
u AS (UNPIVOT (SELECT completeness, consistency, accuracy, timeliness, uniqueness, validity FROM o)
      ON COLUMNS(*) INTO NAME dimension VALUE score)
SELECT u.dimension, score, overall_score, grade, overall_score >= 85 AS meets_threshold, score < advice_limit AS needs_action,
       if(score < advice_limit, priority, NULL) AS priority, if(score < advice_limit, recommendation, NULL) AS recommendation,
       if(score < advice_limit, action, NULL) AS action
FROM u JOIN v USING (dimension), o
""")(lambda t: S.quality_report(_metrics(t)))
register("dq09_kpi", P, """
WITH q AS (
  SELECT 'COMPLETENESS' AS dimension, avg((full_name IS NOT NULL)::INT) * 100 AS score FROM providers
  UNION ALL SELECT 'CONSISTENCY', (1 - count(DISTINCT upper(trim(full_name))) / count(full_name)) * 100 FROM providers
  UNION ALL SELECT 'ACCURACY', avg(regexp_full_match(npi_number, '[0-9]{10}')::INT) * 100 FROM providers)
SELECT dimension, round(score, 2) AS score_percentage,
       CASE WHEN score >= 95 THEN 'EXCELLENT' WHEN score >= 85 THEN 'GOOD' WHEN score >= 70 THEN 'FAIR' ELSE 'POOR' END AS quality_grade
FROM q
""")(lambda t: S.kpi_scores(t["providers"]))
register("dq10_thresholds", P, "WITH " + ", ".join(
    f"m{i} AS ({q.strip()})" for i, q in enumerate((_COMPLETE, _CONS, _ACC, _UNIQ))) + """,
a AS (SELECT round_even(avg(date_diff('day', last_updated, DATE '2025-01-01')), 2) AS age FROM providers),
q(dimension, score, limit_value, up) AS (
  SELECT 'completeness', completeness, 95.0::DOUBLE, TRUE FROM m0 UNION ALL SELECT 'consistency', consistency, 90.0, TRUE FROM m1
  UNION ALL SELECT 'accuracy', accuracy, 95.0, TRUE FROM m2 UNION ALL SELECT 'timeliness_days', age, 30.0, FALSE FROM a
  UNION ALL SELECT 'uniqueness', uniqueness, 99.0, TRUE FROM m3)
SELECT dimension, score, limit_value, if(up, score >= limit_value, score <= limit_value) AS meets_sla FROM q
""")(lambda t: S.check_thresholds(t["providers"], ASOF, consistency_rules=CONSISTENCY))
register("dq11a_formats", P, r"""
SELECT provider_id, coalesce(regexp_full_match(email, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'), FALSE) AS email_ok,
       coalesce(regexp_full_match(phone_number, '\d{3}-\d{3}-\d{4}|\(\d{3}\) ?\d{3}-\d{4}|\d{10}'), FALSE) AS phone_ok
FROM providers
""")(lambda t: t["providers"].select("provider_id", S.valid_email(F.col("email")).alias("email_ok"),
                                     S.valid_phone(F.col("phone_number")).alias("phone_ok")))
register("dq11b_outliers", (), """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders)
SELECT o_orderkey, o_totalprice, o_totalprice < a - 0.1 * (b - a) OR o_totalprice > b + 0.1 * (b - a) AS is_outlier FROM orders, q
""")(lambda t: S.outlier_flag(t["orders"].select("o_orderkey", "o_totalprice"), "o_totalprice", factor=0.1))
register("dq11c_freshness", P, """
WITH a AS (SELECT avg(date_diff('day', last_updated, DATE '2025-01-01')) AS x,
                  avg(date_diff('day', license_expiry_date, DATE '2025-01-01')) AS y FROM providers)
SELECT round_even((if(x <= 90, 100 - x / 90 * 20, greatest(0, 100 - x / 90 * 50))
                   + if(y <= 90, 100 - y / 90 * 20, greatest(0, 100 - y / 90 * 50))) / 2, 2) AS freshness FROM a
""")(lambda t: S.freshness(t["providers"], ["last_updated", "license_expiry_date"], ASOF))
register("dq12_trend", ("quality_log",), """
WITH w AS (SELECT *, lag(overall_quality_score) OVER (PARTITION BY table_name ORDER BY measurement_date) AS p FROM quality_log)
SELECT table_name, measurement_date, overall_quality_score AS overall_score, p AS previous_score,
       round(overall_quality_score - p, 2) AS change,
       CASE WHEN p IS NULL THEN 'FIRST' WHEN overall_quality_score > p THEN 'UP' WHEN overall_quality_score < p THEN 'DOWN'
            ELSE 'FLAT' END AS trend
FROM w
""")(lambda t: S.quality_trend(t["quality_log"].withColumnRenamed("overall_quality_score", "overall_score")))

# record scores
_f = lambda c: f"coalesce(regexp_matches({c}, '\\S'), FALSE)::INT"
_CORE = " + ".join(_f(c) for c in ("full_name", "first_name", "last_name", "specialty_primary", "license_number", "license_state"))
_EXTRA = " + ".join(_f(c) for c in ("npi_number", "email", "phone_number")) + " + coalesce(years_in_practice <> 0, FALSE)::INT"
_OVER = f"(({_CORE}) / 6 * 0.7::DOUBLE + ({_EXTRA}) / 5 * 0.3::DOUBLE) * 100"
register("rl01_provider_completeness", P, f"""
SELECT provider_id, coalesce(regexp_full_match(npi_number, '[0-9]{{10}}'), FALSE) AS has_valid_npi,
       round(({_f('full_name')} + {_f('first_name')} + {_f('last_name')}) / 3 * 100, 6) AS name_completeness,
       ({_f('email')} + {_f('phone_number')}) / 2 * 100 AS contact_completeness,
       ({_f('license_number')} + {_f('license_state')}) / 2 * 100 AS license_completeness FROM providers
""")(lambda t: RL.provider_completeness(t["providers"]).select(
    "provider_id", "has_valid_npi", F.round("name_completeness", 6).alias("name_completeness"), "contact_completeness",
    "license_completeness"))
register("rl02_provider_overall", P, f"SELECT provider_id, round({_OVER}, 6) AS completeness_score FROM providers")(
    lambda t: RL.provider_overall(t["providers"]).select("provider_id", F.round("completeness_score", 6).alias("completeness_score")))
_ISSUES = [
    ("coalesce(trim(full_name), '') = ''", "'Missing or empty full name'"),
    ("coalesce(trim(last_name), '') = ''", "'Missing or empty last name'"),
    ("npi_number <> '' AND NOT regexp_full_match(npi_number, '[0-9]{10}')", "'Invalid NPI number format'"),
    ("license_state <> '' AND length(license_state) <> 2", "'Invalid license state format'"),
    ("email <> '' AND position('@' IN email) = 0", "'Invalid email format'"),
    ("birth_year <> 0 AND NOT birth_year BETWEEN 1920 AND 2005", "'Unrealistic birth year'"),
    ("NOT years_in_practice BETWEEN 0 AND 60", "'Invalid years in practice'"),
]
_concat = lambda iss: "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN {x} END" for c, x in iss) + ")"
register("rl03_provider_issues", P, f"""
WITH i AS (SELECT provider_id, {_concat(_ISSUES)} AS issues FROM providers) SELECT *, issues = '' AS is_valid FROM i
""")(lambda t: RL.provider_issues(t["providers"]).select("provider_id", "issues", "is_valid"))
register("rl04_facility_completeness", ("facilities",), f"""
SELECT facility_id, ({_f('city')} + {_f('state_province')} + {_f('postal_code')}) / 4 * 100 AS address_completeness,
       0.0::DOUBLE AS contact_completeness,
       round((({_f('facility_name')} + {_f('facility_type')} + {_f('city')} + {_f('state_province')}) / 5 * 0.8::DOUBLE
        + ({_f('postal_code')} + (bed_count IS NOT NULL)::INT) / 5 * 0.2::DOUBLE) * 100, 6) AS completeness_score FROM facilities
""")(lambda t: RL.facility_completeness(t["facilities"]).select(
    "facility_id", "address_completeness", "contact_completeness", F.round("completeness_score", 6).alias("completeness_score")))
_FISSUES = [
    ("coalesce(trim(facility_name), '') = ''", "'Missing or empty facility name'"), ("TRUE", "'Missing street address'"),
    ("coalesce(trim(city), '') = ''", "'Missing city'"), ("coalesce(trim(state_province), '') = ''", "'Missing state/province'"),
    ("postal_code <> '' AND NOT regexp_full_match(translate(postal_code, '- ', ''), '[0-9]{5}|[0-9]{9}')", "'Invalid postal code format'"),
    ("bed_count <= 0", "'Invalid bed count'"),
    ("facility_type <> '' AND facility_type NOT IN " + str(RL.FACILITY_TYPES), "'Unrecognized facility type: ' || facility_type"),
]
register("rl05_facility_issues", ("facilities",), f"""
WITH i AS (SELECT facility_id, {_concat(_FISSUES)} AS issues FROM facilities) SELECT *, issues = '' AS is_valid FROM i
""")(lambda t: RL.facility_issues(t["facilities"]).select("facility_id", "issues", "is_valid"))
register("rl06_facility_address", ("facilities",), """
SELECT facility_id, concat_ws(', ', trim(city), trim(state_province), trim(postal_code)) AS full_address,
       concat_ws('|', upper(trim(city)), upper(trim(state_province)),
                 if(length(translate(postal_code, '- ', '')) >= 5, translate(postal_code, '- ', '')[:5], NULL)) AS geographic_key
FROM facilities
""")(lambda t: RL.facility_address(t["facilities"]).select("facility_id", "full_address", "geographic_key"))


# constraints
def _ck(key, table, checks):
    return " UNION ALL ".join(
        f"SELECT '{n}' AS constraint_name, {key} AS key, CAST({v} AS VARCHAR) AS value FROM {table} WHERE NOT ({ok})"
        for n, v, ok in checks)


register("ck01_provider", P, _ck("provider_id", "providers", [
    ("chk_npi_format", "npi_number", "regexp_full_match(npi_number, '[0-9]{10}')"),
    ("chk_license_state", "license_state", "length(license_state) = 2"),
    ("chk_record_status", "record_status", "record_status IN ('ACTIVE','INACTIVE','PENDING','MERGED','DUPLICATE')"),
    ("chk_confidence_range", "source_confidence", "source_confidence BETWEEN 0 AND 1"),
    ("chk_birth_year", "birth_year", "birth_year BETWEEN 1920 AND 2005"),
    ("chk_years_practice", "years_in_practice", "years_in_practice BETWEEN 0 AND 60"),
]))(lambda t: C.provider_checks(t["providers"]))
register("ck02_facility", ("facilities",), _ck("facility_id", "facilities", [
    ("chk_facility_type", "facility_type", "facility_type IN " + str(RL.FACILITY_TYPES)),
    ("chk_postal_code_format", "postal_code", "length(postal_code) IN (5, 10) AND regexp_matches(postal_code, '^[0-9]')"),
    ("chk_validation_status", "validation_status", "validation_status IN ('PENDING','VERIFIED','FAILED','MANUAL_REVIEW')"),
    ("chk_bed_count", "bed_count", "bed_count > 0"),
]))(lambda t: C.facility_checks(t["facilities"]))
register("ck03_activity", ("activities",), _ck("activity_id", "activities", [
    ("chk_activity_type", "activity_type", "activity_type IN ('CLINICAL','RESEARCH','ADMINISTRATIVE','EDUCATION','PUBLICATION')"),
    ("chk_citation_count", "citation_count", "citation_count >= 0"),
]))(lambda t: C.activity_checks(t["activities"]))
register("ck04_affiliation", ("affiliations",), _ck("concat(provider_id, '|', facility_id)", "affiliations", [
    ("chk_date_logic", "end_date", "start_date <= end_date")]) + """
UNION ALL SELECT 'unique_provider_facility_start', concat(provider_id, '|', facility_id, '|', start_date), CAST(count(*) AS VARCHAR)
FROM affiliations GROUP BY provider_id, facility_id, start_date HAVING count(*) > 1
""")(lambda t: C.affiliation_checks(t["affiliations"]))
register("ck05a_metrics", ("quality_log",), _ck("metric_id", "quality_log", [
    ("chk_quality_scores", "overall_quality_score",
     "completeness_score IS NULL OR completeness_score BETWEEN 0 AND 100 AND consistency_score IS NULL OR consistency_score BETWEEN 0 "
     "AND 100 AND accuracy_score IS NULL OR accuracy_score BETWEEN 0 AND 100 AND timeliness_score IS NULL OR timeliness_score BETWEEN "
     "0 AND 100 AND uniqueness_score IS NULL OR uniqueness_score BETWEEN 0 AND 100 AND validity_score IS NULL OR validity_score "
     "BETWEEN 0 AND 100 AND overall_quality_score IS NULL OR overall_quality_score BETWEEN 0 AND 100"),
    ("chk_quality_grade", "quality_grade", "quality_grade IN ('A','B','C','D','F')"),
    ("chk_record_counts", "total_records", "total_records >= 0 AND valid_records >= 0 AND invalid_records >= 0 AND duplicate_records >= 0"),
]))(lambda t: C.metric_checks(t["quality_log"]))
register("ck05b_violation_log", ("violation_log",), _ck("CAST(violation_id AS VARCHAR)", "violation_log", [
    ("chk_severity", "severity_level", "severity_level IN ('CRITICAL','HIGH','MEDIUM','LOW')"),
    ("chk_violation_status", "status", "status IN ('OPEN','IN_PROGRESS','RESOLVED','FALSE_POSITIVE','ACCEPTED_RISK')"),
    ("chk_entity_type", "entity_type", "entity_type IN ('PROVIDER','FACILITY','AFFILIATION','ACTIVITY')"),
]))(lambda t: C.violation_log_checks(t["violation_log"]))


def _uq(name, table, key):
    return (f"SELECT '{name}' AS constraint_name, {key} AS key, CAST(count(*) AS VARCHAR) AS value FROM {table} "
            f"WHERE {key} IS NOT NULL GROUP BY 2 HAVING count(*) > 1")


def _fk(name, table, key, c, parent):
    return f"SELECT '{name}', {key}, {c} FROM {table} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {c} FROM {parent})"


register("ck06_keys", ("providers", "facilities", "affiliations", "activities"), " UNION ALL ".join([
    _uq("pk_provider", "providers", "provider_id"), _uq("uq_npi", "providers", "npi_number"),
    _uq("pk_facility", "facilities", "facility_id"), _uq("pk_activity", "activities", "activity_id"),
    *[f"SELECT 'nn_{c}', provider_id, NULL FROM providers WHERE {c} IS NULL" for c in ("full_name", "first_name", "last_name")],
    "SELECT 'nn_facility_name', facility_id, NULL FROM facilities WHERE facility_name IS NULL",
    _fk("fk_affiliation_provider", "affiliations", "facility_id", "provider_id", "providers"),
    _fk("fk_affiliation_facility", "affiliations", "provider_id", "facility_id", "facilities"),
    _fk("fk_activity_provider", "activities", "activity_id", "provider_id", "providers"),
    _fk("fk_activity_facility", "activities", "activity_id", "facility_id", "facilities"),
]))(lambda t: C.key_checks(t.pick("providers", "facilities", "affiliations", "activities")))

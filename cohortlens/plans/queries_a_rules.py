"""Validation rules in both variants."""

from __future__ import annotations

from cohortlens.fixtures import ASOF
from cohortlens.operators import rules as R
from cohortlens.plans.registry import register

P, PA, PFA = ("providers",), ("providers", "affiliations"), ("providers", "facilities", "affiliations")


def _domain(t):
    return t.pick("providers", "facilities", "affiliations")


_NAME_STD = """
WITH f AS (
  SELECT *, coalesce(trim(full_name), '') = '' AS blank, coalesce(first_name, last_name) IS NULL AS bare,
         full_name ILIKE ('%' || first_name || '%') AS has_first, full_name ILIKE ('%' || last_name || '%') AS has_last,
         regexp_matches(lower(full_name), 'test|dummy|sample') AS fake
  FROM providers)
SELECT 'provider_name_inconsistency' AS rule_name, provider_id, full_name, first_name, last_name,
       'Name format inconsistency detected' AS issue_description,
       if(blank, 'CRITICAL', if(bare, 'HIGH',
          if(NOT coalesce(has_first, TRUE) OR NOT coalesce(has_last, TRUE), 'MEDIUM', 'LOW'))) AS severity
FROM f WHERE blank OR bare OR NOT has_first OR NOT has_last OR fake
"""
_NAME_OPT = """
WITH f AS (
  SELECT *, coalesce(trim(full_name), '') = '' AS blank, coalesce(first_name, last_name) IS NULL AS bare,
         coalesce(full_name NOT ILIKE ('%' || first_name || '%'), FALSE) AS off1,
         coalesce(full_name NOT ILIKE ('%' || last_name || '%'), FALSE) AS off2,
         coalesce(regexp_matches(lower(full_name), 'test|dummy|sample'), FALSE) AS fake
  FROM providers WHERE record_status = 'ACTIVE'),
g AS (
  SELECT *, CASE WHEN blank THEN 1 WHEN bare THEN 2 WHEN off1 OR off2 THEN 3 ELSE 4 END AS lvl
  FROM f WHERE blank OR bare OR off1 OR off2 OR fake)
SELECT 'provider_name_inconsistency' AS rule_name, provider_id, full_name, first_name, last_name,
       CASE WHEN blank THEN 'Missing full name' WHEN bare THEN 'Missing name components'
            WHEN off1 THEN 'First name inconsistency' WHEN off2 THEN 'Last name inconsistency'
            ELSE 'Suspicious test data detected' END AS issue_description,
       (['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'])[lvl] AS severity
FROM g ORDER BY lvl, provider_id LIMIT 10000
"""
_NPI_STD = """
WITH d AS (SELECT npi_number AS k, count(*) AS c FROM providers GROUP BY 1),
f AS (
  SELECT p.*, c, length(npi_number) <> 10 AS badlen, NOT regexp_full_match(npi_number, '[0-9]{10}') AS badfmt
  FROM providers p JOIN d ON k = npi_number)
SELECT 'npi_validation' AS rule_name, provider_id, npi_number, full_name,
       CASE WHEN badlen THEN 'Invalid NPI length (must be 10 digits)'
            WHEN badfmt THEN 'Invalid NPI format (must be numeric)' ELSE 'Duplicate NPI detected' END AS issue_description,
       CASE WHEN badlen OR NOT regexp_matches(npi_number, '^[0-9]') OR c > 1 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM f WHERE badlen OR badfmt OR c > 1
"""
_NPI_OPT = """
WITH d AS (SELECT npi_number AS k, count(*) AS c FROM providers WHERE length(npi_number) = 10 GROUP BY 1),
f AS (
  SELECT p.*, coalesce(c, 1) AS c, npi_number IS NULL AS missing, coalesce(length(npi_number) <> 10, FALSE) AS badlen,
         coalesce(NOT regexp_full_match(npi_number, '[0-9]{10}'), FALSE) AS badfmt
  FROM providers p LEFT JOIN d ON k = npi_number WHERE record_status = 'ACTIVE'),
g AS (SELECT *, if(missing, 1, 2) AS lvl FROM f WHERE missing OR badlen OR badfmt OR c > 1)
SELECT 'npi_validation' AS rule_name, provider_id, npi_number, full_name,
       CASE WHEN missing THEN 'Missing NPI number' WHEN badlen THEN 'Invalid NPI length (must be 10 digits)'
            WHEN badfmt THEN 'Invalid NPI format (must be numeric)'
            ELSE 'Duplicate NPI detected (' || c || ' occurrences)' END AS issue_description,
       (['CRITICAL', 'HIGH'])[lvl] AS severity
FROM g ORDER BY lvl, provider_id LIMIT 5000
"""
_AFF = """
WITH s AS (
  SELECT provider_id, count(facility_id) AS total_affiliations,
         count(*) FILTER (WHERE is_primary_affiliation) AS primary_affiliations,
         count(*) FILTER (WHERE end_date IS NULL) AS active_affiliations, count(*) AS n
  FROM affiliations GROUP BY ALL),
g AS (
  SELECT s.*, full_name, CASE WHEN primary_affiliations = 0 THEN 1 WHEN primary_affiliations > 1 THEN 2
                              WHEN active_affiliations = 0 THEN 3 ELSE 4 END AS lvl
  FROM s JOIN providers USING (provider_id)
  WHERE (primary_affiliations <> 1 OR active_affiliations = 0 OR total_affiliations > 10) AND {extra}),
o AS (
  SELECT 'affiliation_anomaly' AS rule_name, provider_id, full_name, total_affiliations, primary_affiliations,
         active_affiliations,
         (['Provider has no primary affiliation', 'Provider has multiple primary affiliations'{c1},
           'Provider has no active affiliations', 'Unusually high number of affiliations'{c2}])[lvl] AS issue_description,
         (['CRITICAL', 'HIGH', 'MEDIUM', 'MEDIUM'])[lvl] AS severity, least(lvl, 3) AS rk
  FROM g)
SELECT * EXCLUDE (rk) FROM o ORDER BY {order}, total_affiliations DESC, provider_id LIMIT 1000
"""
_TEMPORAL = """
WITH f AS (
  SELECT *, birth_year < 1920 OR birth_year > 2007 AS b, graduation_year - birth_year < 18 AS e,
         graduation_year - birth_year > 50 AS l, years_in_practice < 0 AS neg, {toolong} AS tl, {toolong_where} AS tlw,
         license_expiry_date < DATE '2025-01-01' AS past, license_expiry_date > DATE '2035-01-01' AS far,
         birth_year < 1900 OR birth_year > 2009 AS b2
  FROM providers WHERE birth_year IS NOT NULL AND {active}),
g AS (SELECT *, CASE WHEN b2 OR past THEN 1 WHEN e OR l OR neg OR years_in_practice > 60 THEN 2 ELSE 3 END AS lvl
      FROM f WHERE b OR e OR l OR neg OR tlw OR past OR far)
SELECT 'temporal_consistency' AS rule_name, provider_id, full_name, birth_year, graduation_year, years_in_practice,
       license_expiry_date,
       CASE WHEN b THEN 'Unrealistic birth year' WHEN e THEN 'Graduation before reasonable age'
            WHEN l THEN 'Graduation age too old' WHEN neg THEN 'Negative years in practice' WHEN tl THEN '{text}'
            WHEN past THEN 'Expired medical license' WHEN far THEN 'License expiry too far in future'
            ELSE 'Other temporal inconsistency' END AS issue_description,
       (['CRITICAL', 'HIGH', 'MEDIUM'])[lvl] AS severity
FROM g {tail}
"""
_XREF_PARTS = (
    ("affiliation_missing_provider", "provider_id", "'Provider ID: ' || provider_id",
     "affiliations a WHERE provider_id NOT IN (SELECT provider_id FROM providers)"),
    ("affiliation_missing_facility", "facility_id", "'Facility ID: ' || facility_id",
     "affiliations a WHERE facility_id NOT IN (SELECT facility_id FROM facilities)"),
    ("provider_no_affiliations", "provider_id", "'Provider: ' || coalesce(full_name, provider_id)",
     "providers WHERE record_status = 'ACTIVE' AND provider_id NOT IN (SELECT provider_id FROM affiliations)"),
    ("facility_no_providers", "facility_id", "'Facility: ' || coalesce(facility_name, facility_id)",
     "facilities WHERE facility_id NOT IN (SELECT facility_id FROM affiliations)"),
)


def _xref(limit: str, tail: str) -> str:
    parts = " UNION ALL ".join(
        f"(SELECT '{k}' AS entity_type, {i} AS entity_id, {n} AS entity_name FROM {src} {limit})"
        for k, i, n, src in _XREF_PARTS)
    return (f"SELECT 'cross_reference_integrity' AS rule_name, *, 'Orphaned record detected' AS issue_description, "
            f"'HIGH' AS severity FROM ({parts}) {tail}")


_CONTACT_STD = """
WITH d AS (SELECT email AS k, count(*) AS c FROM providers WHERE trim(email) <> '' GROUP BY 1),
f AS (
  SELECT p.*, c, coalesce(trim(phone_number), '') = '' AS nophone,
         NOT regexp_matches(email, '(?s)@.*[.]') AS bademail, regexp_matches(lower(email), 'test|example|dummy') AS fake,
         coalesce(length(translate(phone_number, '()-', '')) <> 10, FALSE) AS badphone
  FROM providers p JOIN d ON k = email)
SELECT 'contact_validation' AS rule_name, provider_id, full_name, email, phone_number,
       CASE WHEN bademail THEN 'Invalid email format' WHEN fake THEN 'Test/dummy email detected'
            WHEN nophone THEN 'Missing phone number' WHEN badphone THEN 'Invalid phone number format'
            ELSE 'Duplicate email address' END AS issue_description,
       CASE WHEN phone_number IS NULL THEN 'HIGH' WHEN bademail OR badphone OR c > 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM f WHERE nophone OR bademail OR badphone OR fake OR c > 1
"""
_CONTACT_OPT = """
WITH a AS (SELECT * FROM providers WHERE record_status = 'ACTIVE'),
d AS (SELECT email AS k, count(*) AS c FROM a WHERE trim(email) <> '' GROUP BY 1),
f AS (
  SELECT a.*, coalesce(c, 1) AS c, coalesce(trim(email), '') = '' AS noemail, coalesce(trim(phone_number), '') = '' AS nophone,
         coalesce(NOT regexp_matches(email, '(?s)@.*[.]'), FALSE) AS bademail,
         coalesce(regexp_matches(lower(email), 'test|example|dummy'), FALSE) AS fake,
         coalesce(length(translate(phone_number, '()-', '')) <> 10, FALSE) AS badphone
  FROM a LEFT JOIN d ON k = email),
g AS (SELECT *, CASE WHEN noemail AND nophone THEN 1 WHEN noemail OR nophone THEN 2
                     WHEN bademail OR badphone OR c > 1 THEN 3 ELSE 4 END AS lvl
      FROM f WHERE noemail OR nophone OR bademail OR fake OR badphone)
SELECT 'contact_validation' AS rule_name, provider_id, full_name, email, phone_number,
       CASE WHEN lvl = 1 THEN 'Missing both email and phone' WHEN noemail THEN 'Missing email address'
            WHEN nophone THEN 'Missing phone number' WHEN bademail THEN 'Invalid email format'
            WHEN fake THEN 'Test/dummy email detected' ELSE 'Invalid phone number format' END AS issue_description,
       (['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'])[lvl] AS severity
FROM g ORDER BY lvl, provider_id LIMIT 10000
"""
_SUM_STD = """
SELECT 'validation_summary' AS rule_name, 'SUMMARY' AS provider_id, 'Validation Summary Statistics' AS full_name,
       'Total Providers: ' || (SELECT count(*) FROM providers) || ', Total Facilities: ' ||
       (SELECT count(*) FROM facilities) || ', Total Affiliations: ' || (SELECT count(*) FROM affiliations)
       AS issue_description, 'INFO' AS severity
"""
_SUM_OPT = """
SELECT 'validation_summary' AS rule_name, 'SYSTEM' AS provider_id, 'Data Quality Validation Summary' AS full_name,
       'Database: ' || (SELECT count(*) FROM providers) || ' providers, ' || (SELECT count(*) FROM facilities) ||
       ' facilities, ' || (SELECT count(*) FROM affiliations) || ' affiliations | Active: ' ||
       (SELECT count(*) FROM providers WHERE record_status = 'ACTIVE') || ' providers, ' ||
       (SELECT count(*) FROM affiliations WHERE end_date IS NULL) || ' active affiliations' AS issue_description,
       'INFO' AS severity
UNION ALL SELECT 'validation_summary', 'PERFORMANCE', 'Query Optimization Status',
       'All validation queries optimized for <5s execution time. Target: 10x data volume scaling.', 'INFO'
"""

_SPEC = [
    ("vr01a_provider_name", "provider_name_inconsistency", "standard", P, _NAME_STD),
    ("vr01b_provider_name", "provider_name_inconsistency", "optimized", P, _NAME_OPT),
    ("vr02a_npi", "npi_validation", "standard", P, _NPI_STD),
    ("vr02b_npi", "npi_validation", "optimized", P, _NPI_OPT),
    ("vr03a_affiliation_anomaly", "affiliation_anomaly", "standard", PA,
     _AFF.format(extra="TRUE", c1="", c2="", order="severity DESC")),
    ("vr03b_affiliation_anomaly", "affiliation_anomaly", "optimized", PA,
     _AFF.format(extra="(n > 1 OR primary_affiliations <> 1)", c1=" || ' (' || primary_affiliations || ')'",
                 c2=" || ' (' || total_affiliations || ')'", order="rk")),
    ("vr04a_temporal", "temporal_consistency", "standard", P,
     _TEMPORAL.format(toolong="years_in_practice > 2030 - graduation_year",
                      toolong_where="years_in_practice > 2030 - coalesce(graduation_year, birth_year + 25)",
                      active="TRUE", text="Years in practice exceeds possible time", tail="")),
    ("vr04b_temporal", "temporal_consistency", "optimized", P,
     _TEMPORAL.format(toolong="years_in_practice > 60", toolong_where="years_in_practice > 60",
                      active="record_status = 'ACTIVE'", text="Excessive years in practice",
                      tail="ORDER BY lvl, provider_id LIMIT 5000")),
    ("vr05a_cross_reference", "cross_reference_integrity", "standard", PFA, _xref("", "")),
    ("vr05b_cross_reference", "cross_reference_integrity", "optimized", PFA,
     _xref("ORDER BY entity_id LIMIT 1000", "ORDER BY entity_type, entity_id LIMIT 2000")),
    ("vr06a_contact", "contact_validation", "standard", P, _CONTACT_STD),
    ("vr06b_contact", "contact_validation", "optimized", P, _CONTACT_OPT),
    ("vr07a_summary", "validation_summary", "standard", PFA, _SUM_STD),
    ("vr07b_summary", "validation_summary", "optimized", PFA, _SUM_OPT),
]

for _name, _rule, _variant, _views, _sql in _SPEC:
    register(_name, _views, _sql)(
        lambda t, rule=_rule, variant=_variant: R.RULES[rule](_domain(t), variant=variant, asof=ASOF))

"""Domain tables defined as views over the driver tables.

Every text is valid for Spark SQL and DuckDB alike, so a query and its check start from the same rows.
``{name}`` stands for a driver table.
"""

from __future__ import annotations

import datetime as dt

ASOF = dt.date(2025, 1, 1)

VIEWS: dict[str, str] = {
    "providers": """
WITH b AS (
  SELECT c_custkey AS k, c_nationkey AS n,
         CASE c_custkey % 5 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Bob' WHEN 2 THEN 'Carla' WHEN 3 THEN 'Dev' ELSE 'Eve' END AS fn,
         concat('Smith', CAST(c_nationkey AS STRING)) AS ln,
         CASE WHEN c_custkey % 59 = 0 THEN NULL WHEN c_custkey % 53 = 0 THEN 1915 ELSE CAST(1940 + c_custkey % 60 AS INT) END AS birth_year
  FROM {customer})
SELECT concat('PROV_', lpad(CAST(k AS STRING), CAST(greatest(6, length(CAST(k AS STRING))) AS INT), '0')) AS provider_id,
       CASE WHEN k % 41 = 0 THEN NULL WHEN k % 37 = 0 THEN '12345' WHEN k % 31 = 0 THEN '12345A7890'
            WHEN k % 29 = 0 THEN '1999999999' ELSE CAST(1000000000 + k AS STRING) END AS npi_number,
       CASE WHEN k % 43 = 0 THEN ' ' WHEN k % 47 = 0 THEN 'TEST Record' WHEN k % 61 = 0 THEN fn ELSE concat(fn, ' ', ln) END AS full_name,
       CASE WHEN k % 67 = 0 THEN NULL ELSE fn END AS first_name,
       CASE WHEN k % 67 = 0 THEN NULL ELSE ln END AS last_name,
       CASE WHEN k % 17 = 0 THEN NULL WHEN k % 23 = 0 THEN 'bad-email' WHEN k % 71 = 0 THEN 'dup@clinic.org'
            ELSE concat(lower(fn), CAST(k AS STRING), '@clinic.org') END AS email,
       CASE WHEN k % 73 = 0 THEN NULL WHEN k % 7 = 0 THEN concat('(555) 123-', lpad(CAST(k % 10000 AS STRING), 4, '0'))
            ELSE concat('555-123-', lpad(CAST(k % 10000 AS STRING), 4, '0')) END AS phone_number,
       CASE n % 3 WHEN 0 THEN 'Cardiology' WHEN 1 THEN 'Surgery' ELSE 'Family Medicine' END AS specialty_primary,
       concat('L', CAST(k % 500 AS STRING)) AS license_number,
       CASE WHEN k % 83 = 0 THEN 'Xx' ELSE CASE n % 4 WHEN 0 THEN 'CA' WHEN 1 THEN 'NY' WHEN 2 THEN 'TX' ELSE 'MA' END END AS license_state,
       DATE '2024-06-01' + CAST((k * 37) % 5000 AS INT) AS license_expiry_date,
       CAST(CASE WHEN k % 79 = 0 THEN -1 WHEN k % 89 = 0 THEN 75 ELSE k % 40 END AS INT) AS years_in_practice,
       birth_year,
       CAST(CASE WHEN k % 97 = 0 THEN birth_year + 15 WHEN k % 101 = 0 THEN birth_year + 55 ELSE birth_year + 26 END AS INT) AS graduation_year,
       CAST((k % 100) / 100.0 AS DOUBLE) AS source_confidence,
       DATE '2024-12-31' - CAST(k % 200 AS INT) AS last_updated,
       CASE WHEN k % 19 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS record_status
FROM b
""",
    "facilities": """
SELECT concat('FAC_', lpad(CAST(s_suppkey AS STRING), CAST(greatest(6, length(CAST(s_suppkey AS STRING))) AS INT), '0')) AS facility_id,
       concat('Clinic ', CAST(s_suppkey AS STRING)) AS facility_name,
       CASE s_suppkey % 4 WHEN 0 THEN 'Hospital' WHEN 1 THEN 'Urgent Care' WHEN 2 THEN 'Private Practice' ELSE 'Research Institute' END AS facility_type,
       CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE concat('City', CAST(s_nationkey AS STRING)) END AS city,
       CASE s_nationkey % 4 WHEN 0 THEN 'CA' WHEN 1 THEN 'NY' WHEN 2 THEN 'TX' ELSE 'MA' END AS state_province,
       CASE WHEN s_suppkey % 13 = 0 THEN '12A' ELSE CAST(10000 + s_suppkey % 90000 AS STRING) END AS postal_code,
       CAST(CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE 50 + s_suppkey % 700 END AS INT) AS bed_count,
       CASE WHEN s_suppkey % 5 = 0 THEN 'PENDING' ELSE 'VERIFIED' END AS validation_status
FROM {supplier}
""",
    "affiliations": """
WITH p AS (
  SELECT o_custkey AS c, l_suppkey AS s, min(CAST(o_orderdate AS DATE)) AS d0
  FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey),
r AS (SELECT c, s, d0, row_number() OVER (PARTITION BY c ORDER BY s) AS rn FROM p)
SELECT concat('PROV_', CASE WHEN c % 103 = 0 THEN 'X' ELSE '' END, lpad(CAST(c AS STRING), CAST(greatest(6, length(CAST(c AS STRING))) AS INT), '0')) AS provider_id,
       concat('FAC_', CASE WHEN (c + s) % 107 = 0 THEN 'X' ELSE '' END, lpad(CAST(s AS STRING), CAST(greatest(6, length(CAST(s AS STRING))) AS INT), '0')) AS facility_id,
       d0 AS start_date,
       CASE WHEN c % 9 = 0 OR (c + s) % 4 = 0 THEN d0 + CAST(100 + (c + s) % 900 AS INT) ELSE NULL END AS end_date,
       (CASE WHEN c % 13 = 0 THEN FALSE WHEN c % 11 = 0 THEN rn <= 2 ELSE rn = 1 END) AS is_primary_affiliation
FROM r
""",
    "activities": """
SELECT concat('ACT_', CAST(o_orderkey AS STRING)) AS activity_id,
       concat('PROV_', lpad(CAST(o_custkey AS STRING), CAST(greatest(6, length(CAST(o_custkey AS STRING))) AS INT), '0')) AS provider_id,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('FAC_', lpad(CAST(o_orderkey % 10 AS STRING), CAST(greatest(6, length(CAST(o_orderkey % 10 AS STRING))) AS INT), '0')) END AS facility_id,
       CAST(o_orderdate AS DATE) AS activity_date,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CLINICAL' WHEN '2' THEN 'RESEARCH' WHEN '3' THEN 'PUBLICATION' WHEN '4' THEN 'EDUCATION' ELSE 'ADMINISTRATIVE' END AS activity_type,
       CAST(o_orderkey % 50 AS INT) AS citation_count
FROM {orders}
""",
    "research_rows": """
SELECT doc_id AS row_ordinal,
       CASE doc_id % 4 WHEN 0 THEN '8_risk_factors' WHEN 1 THEN '3_patient_descriptions' WHEN 2 THEN '6_diagnostics' ELSE '7_therapeutics_interventions_and_clinical_studies' END AS source_category,
       concat('table_', CAST(doc_id % 12 AS STRING)) AS source_table,
       DATE '2020-01-01' + CAST(doc_id % 400 AS INT) AS study_date,
       source AS journal,
       CASE doc_id % 5 WHEN 0 THEN 'Case series' WHEN 1 THEN 'Cohort study' WHEN 2 THEN 'Systematic review' WHEN 3 THEN 'Retrospective observational study' ELSE NULL END AS study_type,
       CASE WHEN doc_id % 9 = 0 THEN NULL ELSE concat('patients: ', CAST(5 + (doc_id * 37) % 900 AS STRING), '; studies: ', CAST(doc_id % 7 AS STRING)) END AS sample_size,
       CASE WHEN doc_id % 4 = 0 THEN concat('OR: ', CAST(doc_id % 4 + doc_id % 3 AS STRING), '.', CAST(doc_id % 10 AS STRING)) END AS severe,
       CASE WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 8 = 0 THEN 'Significant' ELSE 'Not significant' END END AS severe_significant,
       CASE WHEN doc_id % 4 = 2 THEN concat('Sensitivity: ', CAST(60 + doc_id % 40 AS STRING), '%, specificity ', CAST(70 + doc_id % 30 AS STRING), '%') END AS accuracy_text,
       CASE WHEN doc_id % 4 = 3 THEN concat('drug ', CAST(doc_id % 9 AS STRING)) END AS treatment,
       CASE WHEN doc_id % 4 = 3 THEN CASE WHEN doc_id % 3 = 0 THEN 'N' ELSE 'Y' END END AS clinical_improvement,
       CASE WHEN doc_id % 4 = 1 THEN concat('mean ', CAST(20 + doc_id % 60 AS STRING), ', range ', CAST(10 + doc_id % 20 AS STRING), '-', CAST(60 + doc_id % 30 AS STRING)) END AS age,
       text
FROM {documents}
""",
    "survival": """
SELECT l_orderkey AS rec_id, l_linenumber AS rec_no,
       CAST(1 + l_partkey % 60 AS INT) AS duration,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS event,
       CAST(20 + l_suppkey % 60 AS INT) AS age, CAST(l_linenumber % 4 AS INT) AS comorbidities,
       CASE l_linestatus WHEN 'F' THEN 'A' ELSE CASE WHEN l_suppkey % 2 = 0 THEN 'B' ELSE 'C' END END AS treatment_group
FROM {lineitem}
""",
    "call_log": """
SELECT event_id, ts, event_type AS query_name, value / 25.0 AS execution_time,
       (event_type = 'error') AS error, (user_id % 2 = 0) AS cache_hit
FROM {events}
""",
    "interactions": """
SELECT user_id AS patient_id, event_type AS treatment, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS outcome,
       CAST(1 + event_id % 4 AS INT) AS severity_score,
       CASE user_id % 3 WHEN 0 THEN 'young' WHEN 1 THEN 'middle' ELSE 'elderly' END AS age_group
FROM {events}
""",
    "quality_log": """
WITH g AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS d, o_orderpriority AS pr, count(*) AS n,
         CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f,
         CAST(sum(CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END) AS BIGINT) AS h
  FROM {orders} GROUP BY CAST(date_trunc('month', o_orderdate) AS DATE), o_orderpriority)
SELECT concat(CAST(d AS STRING), '/', pr) AS metric_id, d AS measurement_date, pr AS table_name,
       CASE WHEN f = 0 THEN NULL ELSE CAST(floor(10000 * f / n) AS DOUBLE) / CAST(100 AS DOUBLE) END AS completeness_score,
       CASE WHEN n % 5 = 0 THEN NULL ELSE CAST(floor(10000 * h / n) AS DOUBLE) / CAST(100 AS DOUBLE) END AS consistency_score,
       CASE WHEN n % 7 = 0 THEN CAST(120 AS DOUBLE) ELSE CAST(n % 100 AS DOUBLE) END AS accuracy_score,
       CASE WHEN n % 3 = 0 THEN NULL ELSE CAST(f % 101 AS DOUBLE) END AS timeliness_score,
       CAST(h % 130 AS DOUBLE) AS uniqueness_score,
       CAST(f % 101 AS DOUBLE) AS validity_score,
       CAST(floor((10000 * f + 5000 * h) / n) AS DOUBLE) / CAST(100 AS DOUBLE) AS overall_quality_score,
       n AS total_records, n - f AS valid_records, f - h AS invalid_records, h AS duplicate_records,
       CASE n % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 4 THEN 'F' ELSE 'E' END AS quality_grade
FROM g
""",
    "violation_log": """
SELECT event_id AS violation_id, event_type AS rule_name, CAST(ts AS DATE) AS violation_date,
       CASE user_id % 5 WHEN 0 THEN 'PROVIDER' WHEN 1 THEN 'FACILITY' WHEN 2 THEN 'AFFILIATION' WHEN 3 THEN 'ACTIVITY' ELSE 'PAYER' END AS entity_type,
       CAST(user_id AS STRING) AS entity_id,
       CASE event_id % 7 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' WHEN 4 THEN 'MEDIUM' WHEN 5 THEN 'LOW' ELSE 'INFO' END AS severity_level,
       CASE event_id % 6 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'IN_PROGRESS' WHEN 2 THEN 'RESOLVED' WHEN 3 THEN 'FALSE_POSITIVE' WHEN 4 THEN 'ACCEPTED_RISK' ELSE 'CLOSED' END AS status
FROM {events}
""",
    "study_rows": """
SELECT row_ordinal, source_category,
       CASE WHEN row_ordinal % 12 = 0 THEN 'age' WHEN row_ordinal % 12 = 4 THEN 'diabetes' WHEN row_ordinal % 12 = 8 THEN 'male_gender' ELSE source_table END AS source_table,
       study_date, journal, study_type, sample_size, severe, severe_significant, accuracy_text, treatment, clinical_improvement, age, text,
       CASE WHEN row_ordinal % 12 = 5 THEN concat(CAST(row_ordinal % 60 AS STRING), '.5% of cases, later ', CAST(row_ordinal % 30 AS STRING), '%') END AS asymptomatic,
       CASE WHEN row_ordinal % 12 = 9 THEN concat('factor ', CAST(row_ordinal % 11 AS STRING)) END AS factors,
       CASE WHEN row_ordinal % 12 = 9 THEN CASE WHEN row_ordinal % 5 < 3 THEN 'Y' ELSE 'N' END END AS influential,
       CASE WHEN row_ordinal % 4 = 2 THEN concat('method ', CAST(row_ordinal % 15 AS STRING)) END AS detection_method,
       CASE WHEN row_ordinal % 4 = 2 AND row_ordinal % 7 <> 0 THEN CASE WHEN row_ordinal % 3 = 0 THEN 'Y' ELSE 'N' END END AS fda_approval,
       CASE WHEN row_ordinal % 4 = 3 THEN CASE row_ordinal % 3 WHEN 0 THEN 'Severe' WHEN 1 THEN 'Mild' ELSE 'Critical' END END AS severity_of_disease,
       CASE WHEN row_ordinal % 8 = 4 THEN concat('HR: 1.', CAST(row_ordinal % 10 AS STRING)) END AS fatality
FROM {research_rows}
""",
    "authors": """
SELECT c_custkey AS row_no,
       CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE concat('auth ', CAST(c_custkey AS STRING), ' of ', c_mktsegment) END AS author_id,
       CASE c_custkey % 6 WHEN 0 THEN concat('Mary Jane Smith', CAST(c_nationkey AS STRING)) WHEN 1 THEN 'Cher'
            WHEN 2 THEN concat('Pat O''Neil, (', CAST(c_custkey AS STRING), ')') WHEN 3 THEN NULL WHEN 4 THEN ''
            ELSE concat(' Dr. Ann-Marie van der Berg', CAST(c_nationkey AS STRING), ' ') END AS full_name,
       CASE WHEN c_custkey % 2 = 0 THEN concat('A. Author', CAST(c_custkey AS STRING)) END AS authors,
       CASE c_nationkey % 4 WHEN 0 THEN 'CA' WHEN 1 THEN 'NY' WHEN 2 THEN 'TX' ELSE 'MA' END AS license_state,
       CAST(1950 + c_custkey % 60 AS INT) AS birth_year
FROM {customer}
""",
    "source1": """
SELECT provider_id, npi_number, full_name, first_name, last_name, concat(license_state, substr(provider_id, 6)) AS license_number,
       license_state, email, phone_number, last_updated
FROM {providers}
""",
    "source2": """
SELECT provider_id, CASE WHEN CAST(substr(provider_id, 6) AS BIGINT) % 6 = 0 THEN NULL ELSE npi_number END AS npi_number,
       CASE WHEN CAST(substr(provider_id, 6) AS BIGINT) % 10 = 0 THEN upper(full_name)
            WHEN CAST(substr(provider_id, 6) AS BIGINT) % 7 = 0 THEN first_name || ' M ' || last_name ELSE full_name END AS full_name,
       first_name, last_name, concat(license_state, substr(provider_id, 6)) AS license_number, license_state,
       CASE WHEN CAST(substr(provider_id, 6) AS BIGINT) % 11 = 0 THEN 'new.' || email ELSE email END AS email,
       CASE WHEN CAST(substr(provider_id, 6) AS BIGINT) % 9 = 0 THEN NULL ELSE phone_number END AS phone_number,
       last_updated + CAST(CAST(substr(provider_id, 6) AS BIGINT) % 5 - 2 AS INT) AS last_updated
FROM {providers} WHERE record_status = 'ACTIVE'
""",
    "source3": """
SELECT provider_id, CASE WHEN CAST(substr(provider_id, 6) AS BIGINT) % 8 = 0 THEN NULL ELSE npi_number END AS npi_number,
       full_name, first_name, last_name, concat(license_state, 'X', substr(provider_id, 6)) AS license_number, license_state,
       CAST(NULL AS STRING) AS email, phone_number, last_updated - CAST(30 AS INT) AS last_updated
FROM {providers} WHERE CAST(substr(provider_id, 6) AS BIGINT) % 3 <> 0
""",
    "people": """
SELECT p.*, CASE k % 5 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Bob' WHEN 2 THEN 'Carla' WHEN 3 THEN 'Dev' ELSE 'Eve' END AS fn,
       concat(CASE k % 6 WHEN 0 THEN 'Bar' WHEN 1 THEN 'Schu' WHEN 2 THEN 'Hawl' WHEN 3 THEN 'Fitz' WHEN 4 THEN 'Tym' ELSE 'Pfis' END,
              CASE ((k - k % 7) / 7) % 4 WHEN 0 THEN 'den' WHEN 1 THEN 'tar' WHEN 2 THEN 'wig' ELSE 'kell' END,
              CASE ((k - k % 11) / 11) % 5 WHEN 0 THEN 'son' WHEN 1 THEN 'ley' WHEN 2 THEN 'man' WHEN 3 THEN 'berg' ELSE 'czyk' END) AS ln
FROM (SELECT *, CAST(substr(provider_id, 6) AS BIGINT) AS k FROM {providers}) p
""",
    "people1": """
SELECT provider_id, npi_number, concat(fn, ' ', ln) AS full_name, fn AS first_name, ln AS last_name,
       concat(license_state, substr(provider_id, 6)) AS license_number, license_state, email, phone_number, last_updated
FROM {people}
""",
    "people2": """
SELECT provider_id, CASE WHEN k % 3 = 0 THEN NULL ELSE npi_number END AS npi_number, concat(fn, ' ', CASE WHEN k % 4 = 0 THEN concat(ln, substr(ln, length(ln), 1)) WHEN k % 7 = 0 THEN replace(ln, 'e', 'i') ELSE ln END) AS full_name, fn AS first_name, CASE WHEN k % 4 = 0 THEN concat(ln, substr(ln, length(ln), 1)) WHEN k % 7 = 0 THEN replace(ln, 'e', 'i') ELSE ln END AS last_name,
       concat(license_state, substr(provider_id, 6)) AS license_number, license_state, email, phone_number, last_updated
FROM {people}
""",
    "activity_records": """
SELECT activity_id, CASE WHEN citation_count = 13 THEN 'TRAVEL' ELSE activity_type END AS activity_type,
       CASE WHEN citation_count % 17 = 5 THEN -1 WHEN citation_count % 5 = 0 THEN NULL ELSE citation_count * 3 END AS patient_count,
       CASE WHEN citation_count = 7 THEN -citation_count ELSE citation_count END AS citation_count,
       CASE WHEN citation_count % 10 = 9 THEN NULL ELSE citation_count % 10 END AS author_position
FROM {activities}
""",
    "employments": """
WITH e AS (
  SELECT provider_id, facility_id, CASE WHEN year(start_date) = 1995 AND day(start_date) = 3 THEN end_date + 1 ELSE start_date END AS start_date, end_date,
         CASE day(start_date) % 8 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'Part-time' WHEN 2 THEN 'Consulting' WHEN 3 THEN 'Locum' WHEN 4 THEN 'Volunteer'
              WHEN 5 THEN 'Academic' WHEN 6 THEN NULL ELSE 'Gig' END AS employment_type,
         CAST(CASE WHEN day(start_date) = 17 THEN 2 ELSE 1 END AS DOUBLE) AS confidence_score
  FROM {affiliations})
SELECT * FROM e UNION ALL SELECT * FROM e WHERE day(start_date) = 29
""",
    "notes": """
SELECT doc_id, concat(coalesce(text, ''), CASE doc_id % 6 WHEN 0 THEN ' The mechanism is UNCLEAR, and future research needs further data.' WHEN 1 THEN ' Lack of evidence.'
       WHEN 2 THEN ' More studies needed: the dose is not well understood' ELSE '' END) AS text
FROM {documents}
""",
    "snapshot_new": """
SELECT provider_id, full_name, CASE WHEN CAST(substr(provider_id, 6) AS BIGINT) % 11 = 0 THEN 'changed@clinic.org' ELSE email END AS email,
       CASE WHEN CAST(substr(provider_id, 6) AS BIGINT) % 14 = 0 THEN NULL ELSE phone_number END AS phone_number, record_status
FROM {providers} WHERE CAST(substr(provider_id, 6) AS BIGINT) % 47 <> 0
""",
    "snapshot_old": """
SELECT provider_id, full_name, email, phone_number, record_status FROM {providers} WHERE CAST(substr(provider_id, 6) AS BIGINT) % 53 <> 0
""",
    "change_log": """
SELECT event_id AS change_id, concat('PROV_', lpad(CAST(user_id AS STRING), CAST(greatest(6, length(CAST(user_id AS STRING))) AS INT), '0')) AS record_id,
       CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS operation_type,
       concat('mail', CAST(event_id AS STRING), '@clinic.org') AS new_email, ts AS change_timestamp,
       CASE WHEN event_id % 4 = 0 THEN 'COMPLETED' ELSE 'PENDING' END AS processed_status
FROM {events}
""",
    "metric_log": """
SELECT event_id AS metric_id, ts, event_type AS component, value * 20 AS query_time_ms, CAST(user_id % 100 AS DOUBLE) AS cache_hit_rate,
       CAST(event_id % 100 AS DOUBLE) AS cpu_percent, CAST(300 + event_id % 400 AS DOUBLE) AS memory_mb,
       CAST(50 + (event_id * 7) % 51 AS DOUBLE) AS health_score
FROM {events}
""",
    "alert_log": """
SELECT event_id AS alert_id, ts, event_type AS alert_type, CASE event_id % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'CRITICAL' END AS severity,
       (event_id % 3 = 0) AS resolved
FROM {events}
""",
    "referrals": """
SELECT o_custkey AS src, CAST(floor(o_orderkey / 10) AS BIGINT) AS dst FROM {orders}
""",
}

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

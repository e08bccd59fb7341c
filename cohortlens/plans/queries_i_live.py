"""Checks and matches on rows that hold what they look for: varied and misspelt surnames, keys out of bounds, gap phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import constraints as C
from cohortlens.operators import joins as J
from cohortlens.operators import master as M
from cohortlens.operators import text as T
from cohortlens.plans.queries_b_quality import _ck
from cohortlens.plans.queries_c_basics import similarity_sql, soundex_sql
from cohortlens.plans.queries_e_master import _EXACT, _FUZZY, _INST
from cohortlens.plans.queries_g_text import _gap_sql
from cohortlens.plans.registry import register

col, lit = F.col, F.lit
S3 = ("people1", "people2", "source3")
_NAMED = "source1 AS (SELECT * FROM people1), source2 AS (SELECT * FROM people2)"
_s = lambda t: (t["people1"], t["people2"], t["source3"])

register("sf05b_soundex_surnames", ("people2",), f"SELECT last_name, {soundex_sql('last_name')} AS code, count(*) AS n FROM people2 GROUP BY ALL")(
    lambda t: t["people2"].groupBy("last_name", F.soundex("last_name").alias("code")).agg(F.count(lit(1)).alias("n")))
register("jn11b_misspelt_names", ("people1", "people2"), f"""
WITH a AS (SELECT DISTINCT full_name AS n FROM people1), b AS (SELECT DISTINCT full_name AS n FROM people2),
s AS (SELECT a.n AS n1, b.n AS n2, {similarity_sql('a.n', 'b.n')} AS sim FROM a, b)
SELECT n1, n2, round(sim, 6) AS similarity FROM s WHERE sim > 0.8""")(
    lambda t: J.similar_names(t["people1"], t["people2"], "full_name").select("n1", "n2", F.round("similarity", 6).alias("similarity")))
register("er04b_fuzzy_surnames", S3, f"WITH {_NAMED}, {_EXACT.strip()}, {_FUZZY} SELECT * FROM f")(
    lambda t: M.fuzzy_matches(t["people1"], t["people2"], M.exact_matches(*_s(t))))
register("er05b_institutional_names", ("people1", "people2", "affiliations"), f"""
WITH {_NAMED}, {_INST.strip()} SELECT * REPLACE (round(similarity, 6) AS similarity) FROM i""")(
    lambda t: M.institutional_matches(t["people1"], t["people2"], t["affiliations"]).withColumn("similarity", F.round("similarity", 6)))
register("ck03b_activity_keys", ("activity_records",), _ck("activity_id", "activity_records", [
    ("chk_activity_type", "activity_type", "activity_type IN ('CLINICAL','RESEARCH','ADMINISTRATIVE','EDUCATION','PUBLICATION')"),
    ("chk_patient_count", "patient_count", "patient_count >= 0"),
    ("chk_citation_count", "citation_count", "citation_count >= 0"),
    ("chk_author_position", "author_position", "author_position > 0"),
]))(lambda t: C.activity_checks(t["activity_records"]))
register("ck04b_employments", ("employments",), _ck("concat(provider_id, '|', facility_id)", "employments", [
    ("chk_date_logic", "end_date", "start_date <= end_date"),
    ("chk_employment_type", "employment_type", "employment_type IN ('Full-time','Part-time','Consulting','Locum','Volunteer','Academic')"),
    ("chk_confidence_score", "confidence_score", "confidence_score BETWEEN 0 AND 1"),
]) + """
UNION ALL SELECT 'unique_provider_facility_start', concat(provider_id, '|', facility_id, '|', start_date), CAST(count(*) AS VARCHAR)
FROM employments WHERE start_date IS NOT NULL GROUP BY provider_id, facility_id, start_date HAVING count(*) > 1
""")(lambda t: C.affiliation_checks(t["employments"]))
register("tx07d_gaps_in_notes", ("notes",), _gap_sql(T.GAP_PHRASES).replace("FROM documents", "FROM notes"))(
    lambda t: T.research_gaps(t["notes"], "text", ["doc_id"]))

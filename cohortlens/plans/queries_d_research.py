"""Summaries, insights, meta-analysis and quality of study rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.fixtures import ASOF
from cohortlens.operators import learning as L
from cohortlens.operators import research as R
from cohortlens.operators import text as T
from cohortlens.plans.registry import register

col = F.col
SR = ("study_rows",)
INTS = "CAST(regexp_extract_all({c}, '\\d+') AS BIGINT[])"
CAT = {"P": R.PATIENTS, "D": R.DIAGNOSTICS, "T": R.THERAPEUTICS, "K": R.RISK}
TITLE = "array_to_string(list_transform(string_split(source_table, '_'), lambda w: upper(w[1]) || w[2:]), ' ')"
NAMES = "CASE source_category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.CATEGORIES.items()) + " END"


def rnd(df, digits=6):
    """Round every double column."""
    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema.fields if f.dataType.typeName() == "double"})


def q(name, body, fn, digits=6):
    body = body.replace("$INTS", INTS.format(c="sample_size")).replace("$TITLE", TITLE).replace("$NAMES", NAMES)
    for k, v in CAT.items():
        body = body.replace(f"${k}", f"'{v}'")
    register(name, SR, body)(lambda t: rnd(fn(t["study_rows"]), digits))


q("rs01a_category_summary", """
WITH s AS (SELECT source_category, study_type, count(*) AS n FROM study_rows WHERE study_type IS NOT NULL GROUP BY ALL)
SELECT r.source_category, count(DISTINCT source_table) AS total_tables, count(*) AS total_records, min(study_date) AS earliest, max(study_date) AS latest,
       (SELECT count(*) FROM s WHERE s.source_category = r.source_category) AS study_types,
       (SELECT max_by(study_type, (n, study_type)) FROM s WHERE s.source_category = r.source_category) AS top_study_type,
       (SELECT max(n) FROM s WHERE s.source_category = r.source_category) AS top_study_type_count, $NAMES AS category_name
FROM study_rows r GROUP BY r.source_category""", R.category_summary)
q("rs01b_journals", """
WITH c AS (SELECT source_category, source_table, journal, count(*) AS n FROM study_rows WHERE journal IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY source_category, source_table ORDER BY n DESC, journal) AS r FROM c)
SELECT source_category, journal, sum(n)::BIGINT AS n FROM k WHERE r <= 10 GROUP BY ALL""", R.journal_counts)
q("rs02_risk_tables", """
WITH b AS (SELECT source_table, count(severe) AS severe_outcomes, count(fatality) AS fatality_outcomes, count(sample_size) AS total_studies
           FROM study_rows WHERE source_category = $K GROUP BY 1),
i AS (SELECT source_table, unnest($INTS) AS n FROM study_rows WHERE source_category = $K)
SELECT b.*, sum(n)::BIGINT AS total_patients, round(avg(n), 6) AS avg_sample_size, round(median(n), 6) AS median_sample_size
FROM b JOIN i USING (source_table) GROUP BY ALL""", R.risk_table_metrics)
q("rs03_patient_tables", """
WITH b AS (SELECT source_table, count(sample_size) AS total_studies, count(age) AS studies_with_age FROM study_rows WHERE source_category = $P GROUP BY 1),
i AS (SELECT source_table, unnest(CAST(regexp_extract_all(asymptomatic, '(\\d+(?:\\.\\d+)?)%', 1) AS DOUBLE[])) AS p FROM study_rows WHERE source_category = $P)
SELECT b.*, round(avg(p), 6) AS asymptomatic_mean, min(p) AS asymptomatic_min, max(p) AS asymptomatic_max,
       if(count(p) = 0, NULL, count(p)) AS asymptomatic_studies, round(median(p), 6) AS asymptomatic_median
FROM b LEFT JOIN i USING (source_table) GROUP BY ALL""", R.patient_table_metrics)
q("rs04_factor_tables", """
SELECT source_table, count(DISTINCT factors) AS unique_factors, count(factors) AS total_factor_studies,
       count(*) FILTER (WHERE influential = 'Y') AS influential_yes, count(*) FILTER (WHERE influential = 'N') AS influential_no
FROM study_rows WHERE factors IS NOT NULL GROUP BY 1""", R.factor_table_metrics)
q("rs05_diagnostic_tables", """
WITH d AS (SELECT * FROM study_rows WHERE source_category = $D),
m0 AS (SELECT source_table, detection_method AS item, count(*) AS n FROM d WHERE detection_method IS NOT NULL GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY source_table ORDER BY n DESC, item) AS r FROM m0)
SELECT source_table, 'detection_method' AS metric, item, n FROM m WHERE r <= 10
UNION ALL SELECT source_table, 'fda_approval', fda_approval, count(*) FROM d WHERE fda_approval IS NOT NULL GROUP BY ALL
UNION ALL SELECT source_table, 'studies_with_accuracy', '', count(accuracy_text) FROM d GROUP BY ALL""", R.diagnostic_table_metrics)
q("rs06_therapy_tables", """
WITH d AS (SELECT * FROM study_rows WHERE source_category = $T)
SELECT source_table, 'clinical_improvement' AS metric, clinical_improvement AS item, count(*) AS n FROM d WHERE clinical_improvement IS NOT NULL GROUP BY ALL
UNION ALL SELECT source_table, 'therapeutic_methods', '', count(DISTINCT treatment) FROM d GROUP BY ALL
UNION ALL SELECT source_table, 'severity_of_disease', severity_of_disease, count(*) FROM d WHERE severity_of_disease IS NOT NULL GROUP BY ALL""",
  R.therapeutic_table_metrics)
_TOPJ = """c AS (SELECT source_category, source_table, journal, count(*) AS n FROM study_rows WHERE journal IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY source_category, source_table ORDER BY n DESC, journal) AS r FROM c),
j AS (SELECT journal, sum(n)::BIGINT AS n FROM k WHERE r <= 10 GROUP BY 1),
y AS (SELECT study_type, count(*) AS n FROM study_rows WHERE study_type IS NOT NULL GROUP BY 1)"""
q("rs07_cross_category", f"""
WITH {_TOPJ}
SELECT min(study_date) AS earliest_study, max(study_date) AS latest_study, count(DISTINCT (source_category, source_table)) AS total_studies,
       (SELECT max_by(study_type, (n, study_type)) FROM y) AS top_study_type, (SELECT max(n) FROM y) AS top_study_type_count,
       (SELECT max_by(journal, (n, journal)) FROM j) AS top_journal, (SELECT max(n) FROM j) AS top_journal_count,
       max(study_date) - min(study_date) AS time_span_days FROM study_rows""", R.cross_category)
q("rs08_monthly", "SELECT strftime(study_date, '%Y-%m') AS month, count(*) AS studies FROM study_rows GROUP BY 1", R.monthly_publications)
q("rs09_risk_overview", """
WITH r AS (SELECT *, $TITLE AS rf FROM study_rows WHERE source_category = $K),
p AS (SELECT row_ordinal, unnest(CAST(regexp_extract_all(sample_size, 'patients:\\s*(\\d+)', 1) AS BIGINT[])) AS n FROM r)
SELECT * FROM (SELECT 'studies' AS section, rf AS item, count(*) AS n FROM r GROUP BY 2 ORDER BY n DESC, item LIMIT 15)
UNION ALL SELECT 'significance', severe_significant, count(*) FROM r WHERE severe_significant IS NOT NULL GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'study_type' AS s, study_type AS i, count(*) AS n FROM r WHERE study_type IS NOT NULL GROUP BY 2 ORDER BY n DESC, i LIMIT 8)
UNION ALL SELECT * FROM (SELECT 'largest_sample' AS s, CAST(row_ordinal AS VARCHAR) AS i, n FROM p ORDER BY n DESC, row_ordinal LIMIT 5)
UNION ALL SELECT 'samples', 'count', count(*) FROM p UNION ALL SELECT 'samples', 'patients', sum(n)::BIGINT FROM p""", R.risk_factor_table)
q("rs10a_asymptomatic", """
SELECT source_table, row_ordinal, CAST(nullif(regexp_extract(asymptomatic, '(\\d+(?:\\.\\d+)?)%', 1), '') AS DOUBLE) AS rate
FROM study_rows WHERE source_category = $P AND regexp_matches(asymptomatic, '\\d%')""", R.asymptomatic_rates)
q("rs10b_dashboard", """
SELECT 'improvement' AS section, clinical_improvement AS item, count(*) AS n FROM study_rows WHERE source_category = $T AND clinical_improvement IS NOT NULL GROUP BY 2
UNION ALL SELECT 'month', strftime(study_date, '%Y-%m'), count(*) FROM study_rows WHERE source_category IN ($P, $T) GROUP BY 2""", R.outcome_dashboard)
q("rs10c_sample_histogram", """
WITH i AS (SELECT unnest($INTS) AS n FROM study_rows WHERE source_category IN ($P, $T)), f AS (SELECT n::DOUBLE AS n FROM i WHERE n < 10000),
s AS (SELECT min(n) AS lo, (max(n) - min(n)) / 30 AS w FROM f), b AS (SELECT least(floor((n - lo) / w), 29)::INT AS bin, lo, w FROM f, s)
SELECT bin, round(lo + bin * w, 6) AS bin_start, round(lo + (bin + 1) * w, 6) AS bin_end, count(*) AS n FROM b GROUP BY ALL""", R.outcome_histogram)
q("rs11_key_findings", f"""
WITH {_TOPJ}, g AS (SELECT source_category, $NAMES AS nm, count(*) AS n FROM study_rows GROUP BY ALL)
SELECT 'Most Researched Area' AS finding, max_by(nm, (n, source_category)) AS subject, max(n) AS amount FROM g
UNION ALL SELECT 'Dominant Study Type', max_by(study_type, (n, study_type)), max(n) FROM y
UNION ALL SELECT 'Research Timeline', min(study_date) || ' to ' || max(study_date), max(study_date) - min(study_date) FROM study_rows""", R.key_findings)
q("rs12_actionable", """
WITH i AS (SELECT unnest($INTS) AS n FROM study_rows), g AS (SELECT $NAMES AS nm, count(*) AS n FROM study_rows GROUP BY 1 ORDER BY n, nm LIMIT 3),
k AS (SELECT $TITLE AS f, count(*) AS n FROM study_rows WHERE source_category = $K GROUP BY 1 ORDER BY n DESC, f LIMIT 5)
SELECT 'gap' AS kind, printf('Increase research focus in %s - currently only %d records', nm, n) AS insight FROM g
UNION ALL SELECT 'design', 'Need more randomized controlled trials - currently dominated by observational studies' FROM study_rows
  WHERE study_type IS NOT NULL HAVING avg(regexp_matches(lower(study_type), 'observational|retrospective')::INT) > 0.6
UNION ALL SELECT 'sample', printf('Increase sample sizes - current average is only %.0f patients', round_even(avg(n), 0)) FROM i WHERE n < 100000 HAVING avg(n) < 500
UNION ALL SELECT 'stale', printf('Research may be outdated - latest study is %d days old', DATE '2025-01-01' - max(study_date)) FROM study_rows
UNION ALL SELECT 'risk', printf('%s: %d studies', f, n) FROM k""", lambda r: R.actionable_insights(r, ASOF))

_OR = "TRY_CAST(nullif(regexp_extract(severe, 'OR[:\\s]*(\\d+\\.?\\d*)', 1), '') AS DOUBLE)"
_RISK = f"""
WITH o AS (SELECT $TITLE AS risk_factor, row_ordinal, {_OR} AS odds_ratio, severe_significant AS significant FROM study_rows
           WHERE source_category = $K AND severe IS NOT NULL AND severe_significant IS NOT NULL),
s AS (SELECT *, CASE WHEN odds_ratio > 2 THEN 'High' WHEN odds_ratio > 1.5 THEN 'Moderate' ELSE 'Low' END AS effect_size,
             if(odds_ratio < 1, 'Protective', 'Risk') AS direction FROM o WHERE odds_ratio IS NOT NULL) """
q("in01a_risk_severity", _RISK + "SELECT * FROM s", R.risk_severity)
q("in01b_risk_top", _RISK + "SELECT * FROM s ORDER BY odds_ratio DESC, row_ordinal LIMIT 15", R.risk_severity_top)
q("in01c_risk_summary", _RISK + """
SELECT count(*) AS studies, count(*) FILTER (WHERE significant = 'Significant') AS significant, count(*) FILTER (WHERE direction = 'Protective') AS protective,
       max_by(risk_factor, (odds_ratio, -row_ordinal)) AS highest_factor, max(odds_ratio) AS highest_odds_ratio FROM s""", R.risk_severity_summary)
_TH = """WITH r AS (SELECT treatment[:50] AS treatment, clinical_improvement AS e,
  coalesce(TRY_CAST(nullif(regexp_extract(sample_size, 'patients:\\s*(\\d+)', 1), '') AS BIGINT), 0) AS n
  FROM study_rows WHERE source_category = $T AND clinical_improvement IS NOT NULL AND treatment IS NOT NULL) """
q("in02a_therapy_rates", _TH + """
SELECT treatment, count(*) AS studies, count(*) FILTER (WHERE e = 'Y') AS effective_studies, round(avg((e = 'Y')::INT), 6) AS rate
FROM r GROUP BY 1 HAVING count(*) >= 2 ORDER BY avg((e = 'Y')::INT) DESC, treatment LIMIT 10""", R.therapy_rates)
q("in02b_therapy_summary", _TH + """
SELECT count(*) AS studies, count(*) FILTER (WHERE e = 'Y') AS effective_studies, round(avg((e = 'Y')::INT) * 100, 6) AS overall_rate,
       round(avg(n) FILTER (WHERE e = 'Y'), 6) AS mean_patients_effective, round(avg(n) FILTER (WHERE e = 'N'), 6) AS mean_patients_ineffective FROM r""",
  R.therapy_summary)
_DG = """WITH d AS (SELECT row_ordinal, $TITLE AS test_type, detection_method, fda_approval,
  TRY_CAST(nullif(regexp_extract(accuracy_text, '(?i)sensitivity[:\\s]*(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS sensitivity,
  TRY_CAST(nullif(regexp_extract(accuracy_text, '(?i)specificity[:\\s]*(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS specificity
  FROM study_rows WHERE source_category = $D) """
q("in03a_diagnostic_rows", _DG + "SELECT * FROM d", R.diagnostic_accuracy)
q("in03b_diagnostic_summary", _DG + """, b AS (SELECT *, (sensitivity + specificity) / 2 AS c FROM d)
SELECT count(*) AS tests, round(avg(sensitivity) FILTER (WHERE c IS NOT NULL), 6) AS mean_sensitivity, round(avg(specificity) FILTER (WHERE c IS NOT NULL), 6) AS mean_specificity,
       max_by(test_type, (c, -row_ordinal)) FILTER (WHERE c IS NOT NULL) AS best_test, max(c) AS best_accuracy,
       round(count(*) FILTER (WHERE fda_approval = 'Y') / count(fda_approval) * 100, 6) AS approval_rate FROM b""", R.diagnostic_summary)
_VU = f"""WITH r AS (SELECT $TITLE AS factor, row_ordinal, {_OR} AS v FROM study_rows WHERE source_category = $K),
u AS (SELECT factor, v AS risk_level, 'Demographic' AS category FROM r WHERE factor = 'Age' AND v IS NOT NULL
      UNION ALL SELECT factor, arg_min(v, row_ordinal), 'Comorbidity' FROM r WHERE v IS NOT NULL AND factor IN ('Diabetes', 'Hypertension', 'Heart Disease', 'COPD', 'Cancer') GROUP BY 1
      UNION ALL SELECT replace(factor, ' Vs ', ' vs '), arg_min(v, row_ordinal), 'Demographic' FROM r WHERE v IS NOT NULL AND factor IN ('Male Gender', 'Race Black Vs White', 'Race Asian Vs White') GROUP BY 1) """
q("in04a_vulnerability", _VU + """SELECT *, CASE WHEN risk_level > 2 THEN 'Priority' WHEN risk_level > 1.5 THEN 'High' WHEN risk_level > 1.2 THEN 'Moderate' ELSE 'Low' END AS band FROM u""",
  R.vulnerability)
q("in04b_vulnerability_summary", _VU + """
SELECT count(*) FILTER (WHERE risk_level > 1.5) AS high_risk, count(*) FILTER (WHERE risk_level > 1.2 AND risk_level <= 1.5) AS moderate_risk,
       round(avg(risk_level) FILTER (WHERE category = 'Comorbidity'), 6) AS comorbidity_mean,
       round(avg(risk_level) FILTER (WHERE category = 'Demographic'), 6) AS demographic_mean, max(risk_level) AS highest FROM u""", R.vulnerability_summary)


def _score_sql(c, table, default):
    return "CASE " + " ".join(f"WHEN contains(lower({c}), '{k.lower()}') THEN {v}" for k, v in table) + f" ELSE {default} END"


q("in05_research_quality", f"""
WITH i AS (SELECT unnest($INTS) AS n FROM study_rows), f AS (SELECT n FROM i WHERE n BETWEEN 10 AND 100000),
a AS (SELECT count(*) AS sample_studies, avg(n) AS mean_sample_size, avg((n < 100)::INT) * 100 AS small_studies_pct, avg((n > 1000)::INT) * 100 AS large_studies_pct,
             avg((n > 400)::INT) * 100 AS adequate_power_pct, median(n) AS median_sample_size FROM f),
t AS (SELECT avg({_score_sql('study_type', R.EVIDENCE, 0)}) AS avg_quality_score,
             avg(regexp_matches(lower(study_type), 'randomized|meta-analysis|systematic')::INT) * 100 AS high_quality_pct FROM study_rows WHERE study_type IS NOT NULL),
h AS (SELECT max(study_date) AS hi, min(study_date) AS lo FROM study_rows),
w AS (SELECT (max(hi) - max(lo))::INT AS time_span_days, count(*) / greatest(1, max(hi) - max(lo)) * 30 AS studies_per_month,
             avg((hi - study_date <= 365)::INT) * 100 AS recent_studies_pct FROM study_rows, h),
p AS (SELECT count(severe_significant) AS sig, count(clinical_improvement) AS imp,
             count(*) FILTER (WHERE contains(lower(severe_significant), 'significant')) AS hits FROM study_rows GROUP BY source_category, source_table),
s AS (SELECT sum(if(sig > 0, sig, imp))::BIGINT AS studies_with_stats, sum(hits) / sum(if(sig > 0, sig, imp)) * 100 AS significant_findings_pct,
             sum(if(sig > 0, sig, imp)) / count(*) * 100 AS statistical_testing_rate FROM p),
z AS (SELECT *, (least(5, adequate_power_pct / 20) + avg_quality_score + least(5, recent_studies_pct / 20) + least(5, statistical_testing_rate / 20)) / 4 AS o FROM a, t, w, s)
SELECT sample_studies, round(mean_sample_size, 6) AS mean_sample_size, round(small_studies_pct, 6) AS small_studies_pct, round(large_studies_pct, 6) AS large_studies_pct,
       round(adequate_power_pct, 6) AS adequate_power_pct, median_sample_size, round(avg_quality_score, 6) AS avg_quality_score, round(high_quality_pct, 6) AS high_quality_pct,
       time_span_days, round(studies_per_month, 6) AS studies_per_month, round(recent_studies_pct, 6) AS recent_studies_pct, studies_with_stats,
       round(significant_findings_pct, 6) AS significant_findings_pct, round(statistical_testing_rate, 6) AS statistical_testing_rate, round(o, 6) AS overall_score,
       CASE WHEN o >= 4 THEN 'EXCELLENT' WHEN o >= 3 THEN 'GOOD' WHEN o >= 2 THEN 'MODERATE' ELSE 'NEEDS IMPROVEMENT' END AS quality_level FROM z""", R.research_quality)

_N1 = "coalesce(TRY_CAST(nullif(regexp_extract(sample_size, '\\d+'), '') AS BIGINT), 0)"
_MT = f"""WITH m AS (SELECT coalesce(treatment, 'Unknown')[:30] AS treatment, (lower(clinical_improvement) LIKE 'y%')::INT AS f, {_N1} AS n
  FROM study_rows WHERE source_category = $T AND clinical_improvement IS NOT NULL), x AS (SELECT * FROM m WHERE n > 0) """
q("mt01a_treatment_meta", _MT + """SELECT treatment, sum(f)::BIGINT AS positive, count(*) AS studies, round_even(avg(f), 3) AS rate, sum(n)::BIGINT AS patients FROM x GROUP BY 1""",
  R.treatment_meta)
q("mt01b_treatment_overall", _MT + "SELECT count(*) AS total_studies, round(avg(f), 6) AS overall_effectiveness, sum(n)::BIGINT AS total_patients FROM x HAVING count(*) >= 3",
  R.treatment_meta_overall)
_MR = f"""WITH m AS (SELECT $TITLE AS risk_factor, (lower(severe_significant) LIKE 'y%')::INT AS f, {_N1} AS n
  FROM study_rows WHERE source_category = $K AND severe_significant IS NOT NULL), x AS (SELECT * FROM m WHERE n > 0) """
q("mt02_risk_meta", _MR + """SELECT risk_factor, sum(f)::BIGINT AS positive, count(*) AS studies, round_even(avg(f), 3) AS rate, sum(n)::BIGINT AS patients
FROM x GROUP BY 1 ORDER BY rate DESC, risk_factor LIMIT 5""", R.risk_meta)
_MD = """WITH x AS (SELECT source_table AS diagnostic_type, TRY_CAST(nullif(regexp_extract(accuracy_text, '(\\d+(?:\\.\\d+)?)%', 1), '') AS DOUBLE) AS a
  FROM study_rows WHERE source_category = $D) """
q("mt03_diagnostic_meta", _MD + """SELECT diagnostic_type, round_even(avg(a), 2) AS mean_accuracy, round_even(stddev_samp(a), 2) AS std_accuracy, count(*) AS studies
FROM x WHERE a IS NOT NULL GROUP BY 1 ORDER BY mean_accuracy DESC, diagnostic_type LIMIT 5""", R.diagnostic_meta)
_REC = f"""WITH t0 AS (SELECT (lower(clinical_improvement) LIKE 'y%')::INT AS f, {_N1} AS n FROM study_rows WHERE source_category = $T AND clinical_improvement IS NOT NULL),
t AS (SELECT avg(f) AS eff, count(*) AS ts, sum(n)::BIGINT AS tp FROM t0 WHERE n > 0),
r0 AS (SELECT (lower(severe_significant) LIKE 'y%')::INT AS f, {_N1} AS n FROM study_rows WHERE source_category = $K AND severe_significant IS NOT NULL),
r AS (SELECT avg(f) AS sr, count(*) AS rs FROM r0 WHERE n > 0),
d0 AS (SELECT TRY_CAST(nullif(regexp_extract(accuracy_text, '(\\d+(?:\\.\\d+)?)%', 1), '') AS DOUBLE) AS a FROM study_rows WHERE source_category = $D),
d AS (SELECT avg(a) AS da, count(a) AS ds FROM d0),
o(priority, category, recommendation, evidence) AS (
  SELECT 'HIGH', 'Treatment Optimization', 'Current treatment effectiveness is below 60%. Consider combination therapies and personalized medicine approaches.',
         'Meta-analysis of ' || ts || ' studies shows ' || printf('%.1f%%', eff * 100) || ' effectiveness' FROM t WHERE eff < 0.6
  UNION ALL SELECT 'MEDIUM', 'Treatment Monitoring', 'Implement real-time treatment response monitoring using AI-powered predictive models.',
         'Analysis of ' || tp || ' patients across multiple studies' FROM t
  UNION ALL SELECT 'HIGH', 'Risk Assessment Protocol', 'Implement standardized risk assessment using the ' || printf('%.1f%%', sr * 100) || ' significant risk factors identified.',
         'Meta-analysis of ' || rs || ' studies on risk factors' FROM r WHERE rs >= 3
  UNION ALL SELECT 'HIGH', 'Diagnostic Improvement', printf('Current diagnostic accuracy at %.1f%% needs improvement through AI-enhanced diagnostics.', da),
         'Meta-analysis of diagnostic studies' FROM d WHERE ds >= 3 AND da < 90) """
# Phrases that the texts of the tables hold, as in the gap queries of the text group.
_PHRASES = ("stupid", "worthless", "tion", "copyright")
_REC = _REC.replace("o(priority", "g0 AS (SELECT source_table, unnest(list_filter(['" + "', '".join(_PHRASES) + """'], lambda p: contains(lower(text), p))) FROM study_rows),
g AS (SELECT count(*) AS gs, least(10, count(DISTINCT source_table)) AS ga FROM g0),
o(priority""").rstrip().removesuffix(")") + """
  UNION ALL SELECT 'HIGH', 'Research Gap Closure', 'Address ' || gs || ' identified research gaps through targeted funding.',
         'NLP analysis identified specific knowledge gaps across ' || ga || ' research areas' FROM g WHERE gs > 0) """
_gaps = lambda r: T.research_gaps(r, "text", ["source_table"], _PHRASES)
_rec = lambda r: R.recommendations(r, R.model_figures(r.sparkSession, gaps=_gaps(r)))
_TL = "if(priority = 'HIGH', 'immediate', 'short_term') AS timeline"
q("mt04a_recommendations", _REC + f"SELECT *, {_TL} FROM o", _rec)
q("mt04b_priorities", _REC + f"SELECT priority, {_TL}, count(*) AS n FROM o GROUP BY 1", lambda r: R.priority_counts(_rec(r)))
q("mt05_findings", _REC + """SELECT 'Meta-analysis shows ' || printf('%.1f%%', eff * 100) || ' overall treatment effectiveness across studies' AS finding FROM t
UNION ALL SELECT 'Generated ' || count(*) || ' AI-powered actionable recommendations across multiple categories' FROM o""",
  lambda r: R.findings_report(r, _rec(r)))


def _all_recommendations(t):
    """All seven, with the severe-outcome model and the clustering of the model queries; their figures have no SQL form, so
    the digits of those two are masked."""
    sv = t["survival"].withColumns({"treatment_a": (col("treatment_group") == "A").cast("int"), "treatment_b": (col("treatment_group") == "B").cast("int")})
    scores = L.severe_outcome_models(sv, ("rec_id", "rec_no"), ["age", "comorbidities", "duration", "treatment_a", "treatment_b"], "event", trees=20, rounds=10)
    scan = L.kmeans_scan(t["lineitem"], ["l_quantity", "l_discount", "l_extendedprice"])
    rows = t["study_rows"]
    out = R.recommendations(rows, R.model_figures(t.spark, scores, _gaps(rows), scan=scan))
    mask = lambda c: F.when(col("category").isin("Risk-Based Treatment", "Patient Subgroup Research"), F.regexp_replace(c, r"-?[0-9]+(\.[0-9]+)?", "#")).otherwise(col(c))
    return out.withColumns({c: mask(c) for c in ("recommendation", "evidence")})


_ALL = _REC.rstrip().removesuffix(")") + """
  UNION ALL SELECT 'HIGH', 'Risk-Based Treatment', 'Use AI risk prediction models to stratify patients and personalize treatment intensity.', 'ML model achieved #% accuracy in predicting severe outcomes'
  UNION ALL SELECT 'MEDIUM', 'Patient Subgroup Research', 'Focus research on # distinct patient phenotypes identified through ML clustering.',
         'Clustering analysis revealed # patient subgroups with silhouette score #') """
for _k, _v in CAT.items():
    _ALL = _ALL.replace(f"${_k}", f"'{_v}'")
register("mt04c_all_recommendations", SR, _ALL.replace("$TITLE", TITLE) + f"SELECT *, {_TL} FROM o")(_all_recommendations)


_LET = "CASE WHEN {0} >= 90 THEN 'A' WHEN {0} >= 80 THEN 'B' WHEN {0} >= 70 THEN 'C' WHEN {0} >= 60 THEN 'D' ELSE 'F' END"
_POW = "CASE WHEN n >= 64 THEN 0.8::DOUBLE WHEN n >= 26 THEN 0.5::DOUBLE + (n - 26) * (0.3::DOUBLE / 38) ELSE greatest(0.2::DOUBLE, n * 0.5::DOUBLE / 26) END"
_SQ1 = f"""s0 AS (SELECT unnest($INTS) AS n FROM study_rows), s1 AS (SELECT n, {_POW} AS p FROM s0 WHERE n < 100000),
sq1 AS (SELECT count(*) AS total_studies, round(avg(n), 6) AS mean_sample_size, round(stddev_pop(n), 6) AS std_sample_size, count(*) FILTER (WHERE n < 50) AS small_studies,
  count(*) FILTER (WHERE n BETWEEN 100 AND 499) AS adequate_studies, count(*) FILTER (WHERE n >= 500) AS large_studies, round(avg(p), 6) AS mean_power,
  count(*) FILTER (WHERE p >= 0.8) AS studies_with_power, count(*) FILTER (WHERE p < 0.5) AS underpowered_studies, median(n) AS median_sample_size,
  least(100, count(*) FILTER (WHERE n >= 100) / count(*) * 100) AS quality_score FROM s1)"""
_SQ3 = f"""d0 AS (SELECT {_score_sql('study_type', R.DESIGNS, 1)} AS s FROM study_rows WHERE study_type IS NOT NULL),
sq3 AS (SELECT count(*) AS total_studies, round(avg(s), 6) AS mean_design_score, count(*) FILTER (WHERE s >= 4) AS high_quality_studies,
  count(*) FILTER (WHERE s <= 2) AS low_quality_studies, avg(s) / 5 * 100 AS quality_score FROM d0)"""
_cnt = " + ".join(f"(count({c}) > 0)::INT" for c in R.REPORTING)
_fill = " + ".join(f"count({c}) / count(*)" for c in R.REPORTING)
_SQ4 = f"""r0 AS (SELECT source_category, source_table, (({_cnt}) / 8 + ({_fill}) / ({_cnt})) / 2 AS completeness FROM study_rows GROUP BY 1, 2),
sq4 AS (SELECT round(avg(completeness), 6) AS mean_completeness, count(*) FILTER (WHERE completeness >= 0.8) AS complete_tables,
  count(*) FILTER (WHERE completeness < 0.5) AS incomplete_tables, round(median(completeness), 6) AS median_completeness, avg(completeness) * 100 AS quality_score FROM r0)"""
_miss = " + ".join(f"if(count({c}) > 0, 1 - count({c}) / count(*), 0)" for c in R.OUTCOMES)
_seen = " + ".join(f"(count({c}) > 0)::INT" for c in R.OUTCOMES)
_SQ5 = f"""b0 AS (SELECT source_category, source_table,
  if(sum(list_sum($INTS)) / nullif(sum(len($INTS)), 0) < 50, 2, 0) + coalesce(({_miss}) / nullif({_seen}, 0) * 3, 0)
  + coalesce(max(regexp_matches(lower(study_type), 'case report|case series')::INT), 0) AS bias_score FROM study_rows GROUP BY 1, 2),
sq5 AS (SELECT round(avg(bias_score), 6) AS mean_bias_score, count(*) FILTER (WHERE bias_score <= 1) AS low_bias, count(*) FILTER (WHERE bias_score >= 3) AS high_bias,
  greatest(0, 100 - avg(bias_score) * 20) AS quality_score FROM b0)"""


def _sq(n):
    return f" SELECT * REPLACE (round(quality_score, 6) AS quality_score), {_LET.format('quality_score')} AS quality_grade FROM sq{n}"


q("sq01_sample_adequacy", f"WITH {_SQ1}" + _sq(1), R.sample_adequacy)
q("sq02_power", f"""WITH i AS (SELECT row_ordinal, unnest($INTS) AS n FROM study_rows) SELECT row_ordinal, n, round({_POW}, 6) AS power FROM i WHERE n < 100000""", R.study_power)
q("sq03_design", f"WITH {_SQ3}" + _sq(3), R.design_quality)
q("sq04a_reporting_tables", f"WITH {_SQ4} SELECT source_category, source_table, round(completeness, 6) AS completeness FROM r0", R.reporting_by_table)
q("sq04b_reporting", f"WITH {_SQ4}" + _sq(4), R.reporting_quality)
q("sq05a_bias_tables", f"WITH {_SQ5} SELECT source_category, source_table, round(bias_score, 6) AS bias_score FROM b0", R.bias_by_table)
q("sq05b_bias", f"WITH {_SQ5}" + _sq(5), R.bias_quality)
q("sq06_overall", f"""WITH {_SQ1}, {_SQ3}, {_SQ4}, {_SQ5},
l(dimension, quality_score, w, pr, rec) AS (
  SELECT 'sample_size', quality_score, 0.3::DOUBLE, 'HIGH', 'Increase sample sizes to improve statistical power' FROM sq1
  UNION ALL SELECT 'study_design', quality_score, 0.3, 'HIGH', 'Improve study design quality' FROM sq3
  UNION ALL SELECT 'reporting', quality_score, 0.2, 'MEDIUM', 'Improve reporting completeness' FROM sq4
  UNION ALL SELECT 'bias_risk', quality_score, 0.2, 'HIGH', 'Implement bias reduction measures' FROM sq5),
o AS (SELECT sum(quality_score * w) / sum(w) AS s FROM l)
SELECT dimension, round(quality_score, 6) AS quality_score, round(s, 6) AS overall_score, {_LET.format('s')} AS grade,
       CASE WHEN s >= 90 THEN 'Excellent quality with minimal limitations' WHEN s >= 80 THEN 'Good quality with minor limitations'
            WHEN s >= 70 THEN 'Acceptable quality with some limitations' WHEN s >= 60 THEN 'Fair quality with notable limitations'
            ELSE 'Poor quality with significant limitations' END AS interpretation,
       if(quality_score < 70, pr, NULL) AS priority, if(quality_score < 70, rec, NULL) AS recommendation FROM l, o""", R.overall_study_quality)

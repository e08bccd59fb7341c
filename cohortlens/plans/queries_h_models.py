"""Survival analysis, features, models and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import learning as L
from cohortlens.operators import survival as SV
from cohortlens.plans.registry import register

col, lit = F.col, F.lit
S = ("survival",)


def rnd(df, n=6):
    return df.withColumns({f.name: F.round(f.name, n) for f in df.schema.fields if f.dataType.typeName() == "double"})


_CELLS = ("source_table", "study_type", "sample_size", "age", "text", "severity_of_disease", "treatment")
_low = "[" + ", ".join(f"lower({c})" for c in _CELLS) + "]"
register("sv01_records", ("study_rows",), f"""
WITH a AS (SELECT row_ordinal, 1 + row_ordinal % 60 AS duration, (row_ordinal % 5 = 0)::INT AS ev, clinical_improvement, list_filter({_low}, lambda x: x IS NOT NULL) AS c,
           coalesce(TRY_CAST(nullif(regexp_extract(age, '\\d+'), '') AS BIGINT), 50) AS ag FROM study_rows)
SELECT row_ordinal, duration, if(contains(lower(coalesce(clinical_improvement, '')), 'severe') OR contains(array_to_string(c, ' '), 'mortality'), 1, ev) AS event,
       least(100, greatest(0, ag))::INT AS age, least(5, len(list_filter(c, lambda x: regexp_matches(x, 'diabetes|hypertension|cardiovascular|obesity|chronic'))))::INT AS comorbidities,
       least(10, greatest(1, 3 + list_sum(list_transform(c, lambda x: CASE WHEN contains(x, 'severe') THEN 2 WHEN contains(x, 'critical') THEN 3 WHEN contains(x, 'mild') THEN -1 ELSE 0 END))))::DOUBLE AS severity_score
FROM a""")(lambda t: SV.survival_records(
    t["study_rows"].withColumns({"duration": 1 + col("row_ordinal") % 60, "ev": (col("row_ordinal") % 5 == 0).cast("int")}), _CELLS, "row_ordinal", "duration", "ev"))


def _km(group):
    p = f"PARTITION BY {group} " if group else ""
    g = f"{group}, " if group else ""
    return f"""WITH c AS (SELECT {g}duration::DOUBLE AS t, count(*) AS n, sum(event)::BIGINT AS events FROM survival GROUP BY ALL),
r AS (SELECT *, sum(n) OVER ({p}ORDER BY t DESC)::BIGINT AS at_risk FROM c),
k AS (SELECT *, exp(sum(if(events < at_risk, ln(1 - events / at_risk), 0)) OVER w) * (max((events = at_risk)::INT) OVER w = 0)::INT AS s,
             sum(if(events < at_risk, events / (at_risk * (at_risk - events)), 0)) OVER w AS gw FROM r WINDOW w AS ({p}ORDER BY t)),
z AS (SELECT {g}t, at_risk, events, s AS survival, if(s > 0 AND s < 1, exp(-exp(ln(-ln(s)) + 1.959963984540054 * sqrt(gw) / abs(ln(s)))), s) AS lower,
             if(s > 0 AND s < 1, exp(-exp(ln(-ln(s)) - 1.959963984540054 * sqrt(gw) / abs(ln(s)))), s) AS upper FROM k) """


_KR = "SELECT * REPLACE (round(survival, 6) AS survival, round(lower, 6) AS lower, round(upper, 6) AS upper) FROM z"
_KS = "min(t) FILTER (WHERE survival <= 0.5) AS median, " + ", ".join(f"round(coalesce(min(survival) FILTER (WHERE t <= {x}), 1), 6) AS s_{x}" for x in (7, 14, 30)) + " FROM z"
register("sv02a_km_overall", S, _km("") + _KR)(lambda t: rnd(SV.km_curve(t["survival"], "duration", "event")))
register("sv02b_km_groups", S, _km("treatment_group") + _KR)(lambda t: rnd(SV.km_curve(t["survival"], "duration", "event", "treatment_group")))
register("sv02c_km_summary", S, _km("treatment_group") + f"SELECT treatment_group, {_KS} GROUP BY 1")(lambda t: rnd(SV.km_summary(t["survival"], "duration", "event", "treatment_group")))


def _sv(t):
    g = col("treatment_group")
    return t["survival"].select("rec_id", "rec_no", "duration", "event", "age", "comorbidities", (g == "A").cast("int").alias("treatment_a"), (g == "B").cast("int").alias("treatment_b"))


register("sv03_cox", S)(lambda t: rnd(SV.cox_fit(_sv(t), "duration", "event", ["age", "comorbidities", "treatment_a", "treatment_b"]), 5))
register("sv04_weibull", S)(lambda t: rnd(SV.weibull_aft(_sv(t), "duration", "event", ["age", "comorbidities", "treatment_a", "treatment_b"]), 4))
_PAIR = """
SELECT '{a}_vs_{b}' AS test, a - e AS o, v FROM (SELECT sum(d1) AS a, sum(d * n1 / n) AS e, sum(if(n > 1, d * (n - d) / (n - 1) * (n1 / n) * (1 - n1 / n), 0)) AS v FROM (
  SELECT t, sum(n1) OVER w AS n1, sum(n1 + n2) OVER w AS n, d1, d1 + d2 AS d FROM (SELECT duration AS t, count(*) FILTER (WHERE treatment_group = '{a}') AS n1, count(*) FILTER (WHERE treatment_group = '{b}') AS n2,
    coalesce(sum(event) FILTER (WHERE treatment_group = '{a}'), 0) AS d1, coalesce(sum(event) FILTER (WHERE treatment_group = '{b}'), 0) AS d2 FROM survival GROUP BY 1) WINDOW w AS (ORDER BY t DESC)))"""
register("sv05a_logrank_pairs", S, "WITH q AS (" + " UNION ALL ".join(_PAIR.format(a=a, b=b) for a, b in (("A", "B"), ("A", "C"), ("B", "C"))) + ") SELECT test, round(o * o / v, 6) AS statistic FROM q")(
    lambda t: rnd(SV.logrank(t["survival"], "duration", "event", "treatment_group").where(col("test") != "multivariate").select("test", "statistic")))
# Tails of chi-square: one degree of freedom by the series of the error function, two in closed form.
_TAIL1 = """CASE WHEN x > 60 THEN 0 ELSE greatest(0, 1 - 2 / sqrt(pi()) * exp(-x / 2) * list_sum(list_transform(range(0, 150),
  lambda n: exp(n * ln(2) + (2 * n + 1) * ln(greatest(sqrt(x / 2), 1e-150)) - (lgamma(2 * n + 2) - n * ln(2) - lgamma(n + 1)))))) END"""
_MULTI = """m AS (SELECT sum(da - d * na / n) AS oa, sum(db - d * nb / n) AS ob, sum(if(n > 1, d * (n - d) / (n - 1) * (na / n) * (1 - na / n), 0)) AS vaa,
  sum(if(n > 1, d * (n - d) / (n - 1) * (nb / n) * (1 - nb / n), 0)) AS vbb, -sum(if(n > 1, d * (n - d) / (n - 1) * (na / n) * (nb / n), 0)) AS vab FROM (
  SELECT t, sum(ca) OVER w AS na, sum(cb) OVER w AS nb, sum(c) OVER w AS n, da, db, d FROM (SELECT duration AS t, count(*) AS c, sum(event) AS d, count(*) FILTER (WHERE treatment_group = 'A') AS ca,
    count(*) FILTER (WHERE treatment_group = 'B') AS cb, coalesce(sum(event) FILTER (WHERE treatment_group = 'A'), 0) AS da, coalesce(sum(event) FILTER (WHERE treatment_group = 'B'), 0) AS db FROM survival GROUP BY 1) WINDOW w AS (ORDER BY t DESC))),
z AS (SELECT 'multivariate' AS test, (oa * oa * vbb - 2 * oa * ob * vab + ob * ob * vaa) / (vaa * vbb - vab * vab) AS x FROM m)"""
register("sv05b_logrank", S, "WITH q AS (" + " UNION ALL ".join(_PAIR.format(a=a, b=b) for a, b in (("A", "B"), ("A", "C"), ("B", "C"))) + f"""), {_MULTI},
a AS (SELECT test, o * o / v AS x FROM q), r AS (SELECT test, x, {_TAIL1} AS p FROM a UNION ALL SELECT test, x, exp(-x / 2) FROM z)
SELECT test, round(x, 6) AS statistic, round(p, 6) AS p_value, p < 0.05 AS significant FROM r""")(lambda t: rnd(SV.logrank(t["survival"], "duration", "event", "treatment_group")))

# --- features
register("fe01_age", ("study_rows",), """
WITH a AS (SELECT row_ordinal, round(list_avg(CAST(regexp_extract_all(age, '\\d+\\.?\\d*') AS DOUBLE[])), 6) AS age_numeric FROM study_rows)
SELECT *, CASE WHEN age_numeric <= 0 THEN NULL WHEN age_numeric <= 18 THEN 'pediatric' WHEN age_numeric <= 40 THEN 'young_adult' WHEN age_numeric <= 65 THEN 'middle_aged' WHEN age_numeric <= 100 THEN 'elderly' END AS age_group,
       (age_numeric >= 65)::INT AS elderly FROM a""")(
    lambda t: rnd(L.age_features(t["study_rows"].select("row_ordinal", "age")).drop("age")))
register("fe02_comorbidity", ("study_rows",), "SELECT row_ordinal, (severity_of_disease IS NOT NULL)::INT AS has_severity_of_disease FROM study_rows")(
    lambda t: L.comorbidity_features(t["study_rows"].select("row_ordinal", "severity_of_disease")).drop("severity_of_disease"))
register("fe03_clinical", ("study_rows",), """
SELECT row_ordinal, TRY_CAST(nullif(regexp_extract(accuracy_text, '\\d+\\.?\\d*'), '') AS DOUBLE) AS test_accuracy_numeric,
       TRY_CAST(nullif(regexp_extract(severe, '\\d+\\.?\\d*'), '') AS DOUBLE) AS lab_ratio_numeric FROM study_rows""")(
    lambda t: L.clinical_features(t["study_rows"].select("row_ordinal", col("accuracy_text").alias("test_accuracy"), col("severe").alias("lab_ratio"))).select(
        "row_ordinal", "test_accuracy_numeric", "lab_ratio_numeric"))
register("fe04_targets", ("study_rows",), """
SELECT row_ordinal, greatest(0, (severe IS NOT NULL)::INT, (severe_significant = 'Significant')::INT) AS severe_outcome, greatest(0, (fatality IS NOT NULL)::INT) AS mortality_risk FROM study_rows""")(
    lambda t: L.target_features(t["study_rows"].select(
        "row_ordinal", col("severe").isNotNull().cast("int").alias("has_severe"), (col("severe_significant") == "Significant").cast("int").alias("severe_sig"),
        col("fatality").isNotNull().cast("int").alias("fatality_flag"))).select("row_ordinal", "severe_outcome", "mortality_risk"))
_ID = ("rec_id", "rec_no", "part")
_withp = lambda t: t["lineitem"].select(
    col("l_orderkey").alias("rec_id"), col("l_linenumber").alias("rec_no"), col("l_partkey").alias("part"), "l_quantity", "l_discount", "l_extendedprice", "l_tax")
register("fe05_scaled", (), """
SELECT l_orderkey AS rec_id, l_linenumber AS rec_no, l_partkey AS part, round((l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER (), 6) AS l_quantity,
       round((l_discount - avg(l_discount) OVER ()) / stddev_samp(l_discount) OVER (), 6) AS l_discount FROM lineitem""")(
    lambda t: rnd(L.scaled_columns(_withp(t), _ID, ["l_quantity", "l_discount"])))

# --- models (no SQL form; seeds and hash splits make them repeatable)
_F = ["age", "comorbidities", "duration", "treatment_a", "treatment_b"]
_K = ("rec_id", "rec_no")
register("md01_severe_outcome", S)(lambda t: rnd(L.severe_outcome_models(_sv(t), _K, _F, "event"), 4))
register("md02_mortality", S)(lambda t: rnd(L.mortality_model(_sv(t).withColumn("mortality", ((col("event") == 1) & (col("duration") <= 30)).cast("int")), _K, ["age", "comorbidities", "treatment_a", "treatment_b"], "mortality"), 4))
register("md03_length_of_stay", S)(lambda t: rnd(L.stay_model(_sv(t), _K, ["age", "comorbidities", "event", "treatment_a", "treatment_b"], "duration"), 4))
register("md04a_importance", S)(lambda t: rnd(L.feature_importance(_sv(t), _F, "event"), 4))
register("md04b_overview", S)(lambda t: rnd(L.model_overview(L.severe_outcome_models(_sv(t), _K, _F, "event").union(
    L.stay_model(_sv(t), _K, ["age", "comorbidities", "event"], "duration").where(col("metric") == "r2").withColumn("is_best", lit(False)))), 4))

# --- clustering
_CF = ["l_quantity", "l_discount", "l_extendedprice"]
register("cl01_kmeans_scan")(lambda t: rnd(L.kmeans_scan(_withp(t), _CF), 3))
register("cl02_comparison")(lambda t: rnd(L.clustering_comparison(_withp(t), _CF, L.chosen_k(_withp(t), _CF)), 4))
_PT = """p AS (SELECT c_custkey AS id, c_acctbal / 500 AS x, c_nationkey::DOUBLE AS y FROM customer),
nb AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.25::DOUBLE),
co AS (SELECT a AS id FROM nb GROUP BY 1 HAVING count(*) >= 3)"""
_DB = f"""WITH RECURSIVE {_PT}, ce AS (SELECT a, b FROM nb WHERE a IN (SELECT id FROM co) AND b IN (SELECT id FROM co)),
r(root, id) AS (SELECT id, id FROM co UNION SELECT r.root, ce.b FROM r JOIN ce ON ce.a = r.id), k AS (SELECT id, min(root) AS c FROM r GROUP BY 1) """
register("cl03a_dbscan_counts", (), _DB + """, bd AS (SELECT DISTINCT a FROM nb WHERE b IN (SELECT id FROM co) AND a NOT IN (SELECT id FROM co))
SELECT (SELECT count(DISTINCT c) FROM k) AS clusters, (SELECT count(*) FROM p) - (SELECT count(*) FROM co) - (SELECT count(*) FROM bd) AS noise_points, (SELECT count(*) FROM co) AS core_points, (SELECT count(*) FROM p) AS points""")(
    lambda t: L.cluster_counts(_dbscan(t)))
register("cl03b_dbscan_sizes", (), _DB + "SELECT min(id) AS first_core, count(*) AS core_members FROM k GROUP BY c")(
    lambda t: _dbscan(t).where("is_core").groupBy("cluster").agg(F.min("id").alias("first_core"), F.count(lit(1)).alias("core_members")).drop("cluster"))


def _dbscan(t):
    pts = t["customer"].select(col("c_custkey").alias("id"), (col("c_acctbal") / 500).alias("x"), col("c_nationkey").cast("double").alias("y"))
    return L.dbscan(pts, ["id"], ["x", "y"], eps=0.5, min_points=3)


register("cl04_hierarchical")(lambda t: L.hierarchical_labels(_withp(t), _ID, _CF, L.chosen_k(_withp(t), _CF)).groupBy("cluster").agg(F.count(lit(1)).alias("n")))
_PCA = """
WITH c AS (SELECT corr(l_quantity, l_discount) AS a, corr(l_quantity, l_extendedprice) AS b, corr(l_discount, l_extendedprice) AS c FROM lineitem),
p AS (SELECT *, sqrt((a * a + b * b + c * c) / 3) AS p FROM c),
f AS (SELECT p, acos(greatest(-1, least(1, a * b * c / (p * p * p)))) / 3 AS phi FROM p),
e AS (SELECT 1 + 2 * p * cos(phi) AS e1, 1 + 2 * p * cos(phi + 2 * pi() / 3) AS e3 FROM f)
SELECT round(sqrt(e1), 6) AS std_pc1, round(sqrt(3 - e1 - e3), 6) AS std_pc2 FROM e"""
register("cl05_pca", (), _PCA)(lambda t: rnd(L.principal_axes(_withp(t), _ID, _CF).agg(*[F.stddev_samp(f"pc{i}").alias(f"std_pc{i}") for i in (1, 2)]), 6))

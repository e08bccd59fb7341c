"""Text mining, time series and recommendation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import graph as G
from cohortlens.operators import recommend as RC
from cohortlens.operators import research as R
from cohortlens.operators import text as T
from cohortlens.operators import timeseries as TS
from cohortlens.plans.registry import register
from cohortlens.session import cut_lineage, stored

col, lit = F.col, F.lit


def rnd(df, n=6):
    return df.withColumns({f.name: F.round(f.name, n) for f in df.schema.fields if f.dataType.typeName() == "double"})


def _list(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _tok_sql(stop, min_len):
    return f"""k AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z\\s]', '', 'g'), '\\s+'),
  lambda x: len(x) >= {min_len} AND x NOT IN {_list(stop)}) AS w FROM documents WHERE length(text) >= 10), t AS (SELECT * FROM k WHERE len(w) > 0)"""


def _grams_sql(max_n):
    parts = ["w"] + [f"list_transform(range(1, greatest(1, len(w) - {n - 2})), lambda i: array_to_string(w[i:i + {n - 1}], ' '))" for n in range(2, max_n + 1)]
    return "list_concat(" + ", ".join(parts) + ")" if len(parts) > 1 else parts[0]


def _word_sql(stop):
    return f"""k AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN {_list(stop)}) AS w FROM documents),
  t AS (SELECT * FROM k WHERE len(w) > 0)"""


_BOTH = T.ENGLISH + T.DOMAIN
_tok = lambda t: T.tokens(t["documents"], "text", ["doc_id"])
register("tx01_preprocess", (), f"WITH {_tok_sql(_BOTH, 3)} SELECT doc_id, array_to_string(w, ' ') AS processed FROM t")(
    lambda t: T.preprocess(t["documents"], "text", "doc_id"))
_LEM = (("the", "a"), ("erst", "er"), ("tion", "to"), ("ofthe", "of"), ("thes", "the"), ("ing", "in"), ("entr", "en"))
register("tx02_lemmas", (), f"""WITH {_tok_sql(_BOTH, 3)}
SELECT doc_id, array_to_string(list_transform(w, lambda x: CASE x {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _LEM)} ELSE x END), ' ') AS lemmas FROM t""")(
    lambda t: T.lemmatize(_tok(t), "doc_id", _LEM).select("doc_id", F.concat_ws(" ", "tokens").alias("lemmas")))
_VOC = f"""WITH {_tok_sql(_BOTH, 3)}, g AS (SELECT doc_id, unnest({_grams_sql(2)}) AS term FROM t),
v AS (SELECT term FROM g GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 100) """
register("tx03_count_vectors", (), _VOC + "SELECT doc_id, term, count(*) AS n FROM g SEMI JOIN v USING (term) GROUP BY ALL")(lambda t: T.count_vectors(_tok(t), "doc_id"))
register("tx04_topics")(lambda t: rnd(T.topics(_tok(t), "doc_id", n_texts=10)))
_LEX = "x(word, polarity, subjectivity) AS (VALUES " + ", ".join(str(r) for r in T.LEXICON) + ")"
_SENT = f"""WITH d AS (SELECT doc_id, text, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z\\s]', '', 'g'), '\\s+')) AS word FROM documents WHERE length(text) >= 10), {_LEX},
h AS (SELECT doc_id, avg(polarity::DOUBLE) AS p, avg(subjectivity::DOUBLE) AS s FROM d JOIN x USING (word) GROUP BY 1),
r AS (SELECT doc_id, length(text) AS text_length, round(coalesce(p, 0), 6) AS sentiment_score, round(coalesce(s, 0), 6) AS subjectivity,
  CASE WHEN p > 0.1 THEN 'positive' WHEN p < -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment_label FROM documents LEFT JOIN h USING (doc_id) WHERE length(text) >= 10) """
register("tx05a_sentiment", (), _SENT + "SELECT * FROM r")(lambda t: rnd(T.sentiment(t["documents"], "text", "doc_id")))
register("tx05b_sentiment_summary", (), _SENT + """SELECT round(avg(sentiment_score), 4) AS avg_sentiment, round(avg(subjectivity), 4) AS avg_subjectivity,
  count(*) FILTER (WHERE sentiment_label = 'positive') AS positive, count(*) FILTER (WHERE sentiment_label = 'neutral') AS neutral, count(*) FILTER (WHERE sentiment_label = 'negative') AS negative FROM r""")(
    lambda t: rnd(T.sentiment_summary(T.sentiment(t["documents"], "text", "doc_id")), 4))
register("tx06_key_phrases", (), f"""WITH {_word_sql(T.ENGLISH)}, g AS (SELECT unnest({_grams_sql(3)}) AS phrase FROM t),
v AS (SELECT phrase, count(*) AS total FROM g GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)
SELECT phrase, total, round(total / (SELECT sqrt(sum(total::DOUBLE * total)) FROM v), 6) AS score FROM v ORDER BY total DESC, phrase LIMIT 20""")(
    lambda t: rnd(T.key_phrases(t["documents"], "text", "doc_id")))
_WORDS = ("stupid", "worthless", "tion", "copyright")


def _gap_sql(phrases):
    return f"""WITH g AS (SELECT doc_id, text, unnest(list_filter({_list(phrases)}, lambda p: contains(lower(text), p))) AS gap_indicator FROM documents),
q AS (SELECT *, instr(lower(text), gap_indicator) - 1 AS s FROM g)
SELECT doc_id, gap_indicator, substr(text, greatest(0, s - 50) + 1, s + 100 - greatest(0, s - 50)) AS context FROM q"""


register("tx07a_gaps", (), _gap_sql(T.GAP_PHRASES))(lambda t: T.research_gaps(t["documents"], "text", ["doc_id"]))
register("tx07b_gap_phrases", (), _gap_sql(_WORDS))(lambda t: T.research_gaps(t["documents"], "text", ["doc_id"], _WORDS))
register("tx07c_gap_summary", (), "WITH z AS (" + _gap_sql(_WORDS) + ") SELECT gap_indicator, count(*) AS n FROM z GROUP BY 1")(
    lambda t: T.gap_summary(T.research_gaps(t["documents"], "text", ["doc_id"], _WORDS)))
_terms = lambda t: T.vocabulary(T.word_tokens(t["documents"], "text", ["doc_id"]), "doc_id", 2, 30).select("term")
_centrality = lambda docs, terms: T.term_centrality(T.cooccurrence(docs, "text", terms), terms)
_CO = f"""WITH {_word_sql(T.ENGLISH)}, g AS (SELECT unnest({_grams_sql(2)}) AS term FROM t), v AS (SELECT term FROM g GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 30),
h AS (SELECT doc_id, term FROM documents, v WHERE contains(lower(text), term)),
e AS (SELECT a.term AS src, b.term AS dst, count(*) AS weight FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.term < b.term GROUP BY ALL) """
register("tx08_cooccurrence", (), _CO + "SELECT * FROM e")(lambda t: T.cooccurrence(t["documents"], "text", _terms(t)))
register("nw09_term_centrality", (), _CO + """, u AS (SELECT src AS term FROM e UNION ALL SELECT dst FROM e)
SELECT term, (SELECT count(*) FROM u WHERE u.term = v.term) AS degree, round((SELECT count(*) FROM u WHERE u.term = v.term) / (SELECT count(*) - 1 FROM v), 6) AS centrality FROM v""")(
    lambda t: rnd(_centrality(t["documents"], stored(_terms(t), "terms"))))

# --- time series over activities (daily) and study dates
_A = ("activities",)
_S = """WITH b AS (SELECT min(activity_date) AS lo, max(activity_date) AS hi FROM activities),
d AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM b),
s AS (SELECT d.date, count(activity_id) AS value FROM d LEFT JOIN activities a ON a.activity_date = d.date GROUP BY 1) """
_series = lambda t: TS.daily_series(t["activities"], "activity_date")
register("ts01_daily_spine", _A, _S + "SELECT * FROM s")(_series)
register("ts02_trend", _A, _S + """, x AS (SELECT *, date - (SELECT min(date) FROM s) AS i FROM s)
SELECT count(*) AS days, round(regr_slope(value, i), 9) AS slope, round(stddev_samp(value) / avg(value), 6) AS volatility, sum(value)::BIGINT AS total, round(avg(value), 6) AS daily_mean,
       arg_max(date, (value, -i)) AS peak_day, max(value) AS peak, if(regr_slope(value, i) > 0, 'increasing', 'decreasing') AS direction FROM x""")(
    lambda t: TS.trend(_series(t)).withColumns({"slope": F.round("slope", 9), "volatility": F.round("volatility", 6), "daily_mean": F.round("daily_mean", 6)}))
_WK = _S + """, w AS (SELECT CAST(date_trunc('week', date) AS DATE) + 6 AS week, sum(value)::BIGINT AS value FROM s GROUP BY 1) """
register("ts03_weekly", _A, _WK + "SELECT * FROM w")(lambda t: TS.weekly(_series(t)))
register("ts04_decompose", _A, _WK + """, m AS (SELECT week, value, row_number() OVER (ORDER BY week) - 1 AS i,
  CASE WHEN count(*) OVER a = 4 AND count(*) OVER b = 4 THEN (avg(value) OVER a + avg(value) OVER b) / 2 END AS trend
  FROM w WINDOW a AS (ORDER BY week ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), b AS (ORDER BY week ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)),
p AS (SELECT i % 4 AS phase, avg(value - trend) AS m FROM m GROUP BY 1), q AS (SELECT phase, m - (SELECT avg(m) FROM p) AS seasonal FROM p)
SELECT week, value, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(value - trend - seasonal, 6) AS residual FROM m JOIN q ON q.phase = i % 4""")(
    lambda t: rnd(TS.decompose(TS.weekly(_series(t)))))
_FC = _WK + """, r AS (SELECT week, value, row_number() OVER (ORDER BY week) AS i, count(*) OVER () AS n, value - lag(value) OVER (ORDER BY week) AS dx FROM w),
l AS (SELECT *, floor(n * 0.8) AS tr, lag(dx) OVER (ORDER BY week) AS dp FROM r),
f AS (SELECT regr_slope(dx, dp) FILTER (WHERE i <= tr) AS phi, regr_intercept(dx, dp) FILTER (WHERE i <= tr) AS c, max(value) FILTER (WHERE i = tr) AS xl, max(dx) FILTER (WHERE i = tr) AS dl FROM l),
o AS (SELECT week, value, xl + (i - tr) * c / (1 - phi) + (dl - c / (1 - phi)) * phi * (1 - pow(phi, i - tr)) / (1 - phi) AS forecast FROM l, f WHERE i > tr) """
register("ts05a_forecast", _A, _FC + "SELECT week, value, round(forecast, 6) AS forecast FROM o")(lambda t: rnd(TS.forecast(TS.weekly(_series(t)))))
register("ts05b_forecast_errors", _A, _FC + "SELECT round(avg(abs(value - forecast)), 6) AS mae, round(avg(pow(value - forecast, 2)), 6) AS mse, count(*) AS steps FROM o")(
    lambda t: rnd(TS.forecast_errors(TS.forecast(TS.weekly(_series(t))))))
_K = "activity_type"
register("ts05c_forecast_by_type", _A, f"""WITH b AS (SELECT {_K}, min(activity_date) AS lo, max(activity_date) AS hi FROM activities GROUP BY 1),
d AS (SELECT {_K}, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM b),
s AS (SELECT d.{_K}, d.date, count(activity_id) AS value FROM d LEFT JOIN activities a ON a.activity_date = d.date AND a.{_K} = d.{_K} GROUP BY ALL),
w AS (SELECT {_K}, CAST(date_trunc('week', date) AS DATE) + 6 AS week, sum(value)::BIGINT AS value FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER k AS i, count(*) OVER (PARTITION BY {_K}) AS n, value - lag(value) OVER k AS dx FROM w WINDOW k AS (PARTITION BY {_K} ORDER BY week)),
l AS (SELECT *, floor(n * 0.8) AS tr, lag(dx) OVER (PARTITION BY {_K} ORDER BY week) AS dp FROM r),
f AS (SELECT {_K}, regr_slope(dx, dp) FILTER (WHERE i <= tr) AS phi, regr_intercept(dx, dp) FILTER (WHERE i <= tr) AS c, max(value) FILTER (WHERE i = tr) AS xl, max(dx) FILTER (WHERE i = tr) AS dl FROM l GROUP BY 1)
SELECT {_K}, week, value, round(xl + (i - tr) * c / (1 - phi) + (dl - c / (1 - phi)) * phi * (1 - pow(phi, i - tr)) / (1 - phi), 6) AS forecast FROM l JOIN f USING ({_K}) WHERE i > tr""")(
    lambda t: rnd(TS.forecast(TS.weekly(TS.daily_series(t["activities"], "activity_date", [_K]), [_K]), [_K])))

# --- recommendation
_I = ("interactions",)
register("rc01_interactions", ("study_rows",), """
SELECT 'patient_' || row_ordinal AS patient_id, coalesce(treatment[:50], 'unknown') AS treatment, coalesce(lower(clinical_improvement) LIKE 'y%', FALSE)::INT AS outcome,
       CASE WHEN severity_of_disease ILIKE '%severe%' THEN 3 WHEN severity_of_disease ILIKE '%critical%' THEN 4 WHEN severity_of_disease ILIKE '%mild%' THEN 1 ELSE 2 END AS severity_score
FROM study_rows WHERE source_category = '7_therapeutics_interventions_and_clinical_studies'""")(
    lambda t: RC.interactions_from_rows(t["study_rows"].where(col("source_category") == R.THERAPEUTICS)))
register("rc02_success_rates", _I, "SELECT treatment, round_even(avg(outcome), 3) AS mean_outcome, count(*) AS n FROM interactions GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")(
    lambda t: RC.success_rates(t["interactions"]))
# Every treatment that occurs is a component: means by patient and treatment, divided by the patient's norm.
register("rc03_nearest_patients", _I, """
WITH m AS (SELECT patient_id, treatment, avg(outcome) AS m FROM interactions WHERE treatment IS NOT NULL GROUP BY ALL),
u AS (SELECT patient_id, treatment, m / sqrt(sum(m * m) OVER (PARTITION BY patient_id)) AS x FROM m WHERE m <> 0),
z AS (SELECT DISTINCT patient_id FROM u), d AS (SELECT a.patient_id, b.patient_id AS neighbour, sum(a.x * b.x) AS s FROM u a JOIN u b USING (treatment) GROUP BY ALL),
p AS (SELECT a.patient_id, b.patient_id AS neighbour, round(coalesce(s, 0), 9) AS similarity FROM z a JOIN z b ON a.patient_id <> b.patient_id
      LEFT JOIN d ON d.patient_id = a.patient_id AND d.neighbour = b.patient_id),
r AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY similarity DESC, neighbour)::INT AS rank FROM p) SELECT * FROM r WHERE rank <= 5""")(
    lambda t: RC.nearest_patients(t["interactions"]))
register("rc04a_patient_features", _I, """
SELECT patient_id, round(avg(severity_score), 6) AS severity_score, avg((age_group = 'elderly')::INT) AS age_elderly, avg((age_group = 'middle')::INT) AS age_middle, avg((age_group = 'young')::INT) AS age_young FROM interactions GROUP BY 1""")(
    lambda t: rnd(RC.patient_features(t["interactions"])))
_EFF = """e AS (SELECT treatment, 'overall' AS facet, 'all' AS value, avg(outcome) AS score, count(*) AS n FROM interactions GROUP BY 1
 UNION ALL SELECT treatment, 'severity', CAST(severity_score AS VARCHAR), avg(outcome), count(*) FROM interactions GROUP BY 1, 3
 UNION ALL SELECT treatment, 'age_group', age_group, avg(outcome), count(*) FROM interactions GROUP BY 1, 3)"""
register("rc04b_effectiveness", _I, f"WITH {_EFF} SELECT treatment, facet, value, round(score, 6) AS score, n FROM e")(lambda t: rnd(RC.effectiveness(t["interactions"])))
register("rc04c_best", _I, f"WITH {_EFF} SELECT treatment, round(score, 6) AS score, n FROM e WHERE facet = 'overall' ORDER BY e.score DESC, treatment LIMIT 1")(lambda t: rnd(RC.best_treatment(t["interactions"])))
register("rc05_hybrid", _I, f"""WITH {_EFF}, c AS (SELECT treatment, round_even(score, 3) AS m, score, n FROM e WHERE facet = 'overall')
SELECT treatment, round(m * 0.6::DOUBLE + score * 0.4::DOUBLE, 6) AS hybrid_score, m AS collab_score, round(score, 6) AS content_score, n FROM c ORDER BY m * 0.6::DOUBLE + c.score * 0.4::DOUBLE DESC, treatment LIMIT 3""")(
    lambda t: rnd(RC.hybrid(t["interactions"])))
register("rc06_profiles", _I, f"""WITH {_EFF}, p(profile, sv, ag) AS (VALUES ('profile_0', '4', 'elderly'), ('profile_1', '2', 'young'), ('profile_2', '3', 'middle')),
o AS (SELECT treatment, score FROM e WHERE facet = 'overall'),
s AS (SELECT profile, o.treatment, (coalesce(a.score, o.score) + coalesce(b.score, o.score)) / 2 AS score FROM p CROSS JOIN o
      LEFT JOIN e a ON a.treatment = o.treatment AND a.facet = 'severity' AND a.value = sv LEFT JOIN e b ON b.treatment = o.treatment AND b.facet = 'age_group' AND b.value = ag),
r AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY score DESC, treatment)::INT AS rank FROM s) SELECT profile, treatment, round(score, 6) AS score, rank FROM r WHERE rank <= 3""")(
    lambda t: rnd(RC.score_profiles(t["interactions"])))

# --- networks
_E = ("referrals",)
_SYM = "y AS (SELECT DISTINCT src AS a, dst AS b FROM referrals WHERE src <> dst UNION SELECT dst, src FROM referrals WHERE src <> dst)"
register("nw01_collaboration_size", ("research_rows",), """
WITH p AS (SELECT count(*) AS m FROM research_rows a JOIN research_rows b ON a.row_ordinal < b.row_ordinal AND (a.source_category = b.source_category OR a.journal = b.journal)), n AS (SELECT count(*) AS nodes FROM research_rows)
SELECT nodes, m AS edges, round(2 * m / (nodes * (nodes - 1)), 9) AS density FROM p, n""")(
    lambda t: rnd(G.clique_edge_counts(t["research_rows"], "row_ordinal", "source_category", "journal"), 9))
_DEG = f"WITH {_SYM}, d AS (SELECT a AS node, count(*) AS degree FROM y GROUP BY 1), n AS (SELECT count(*) AS n FROM d) "
register("nw02a_degree_summary", _E, _DEG + """SELECT count(*) AS nodes, (sum(degree) / 2)::BIGINT AS edges, round(sum(degree) / (count(*) * (count(*) - 1)), 9) AS density,
       arg_max(node, (degree, -node)) AS most_central, round(max(degree) / (count(*) - 1), 9) AS max_degree_centrality FROM d""")(lambda t: rnd(G.degree_summary(t["referrals"]), 9))
register("nw02b_degree_centrality", _E, _DEG + "SELECT node, degree, round(degree / (n - 1), 9) AS centrality FROM d, n")(lambda t: rnd(G.degree_centrality(t["referrals"]), 9))
register("nw03_clustering", _E, f"""WITH {_SYM}, d AS (SELECT a AS node, count(*) AS g FROM y GROUP BY 1),
t AS (SELECT x.a AS node, count(*) AS c FROM y x JOIN y z ON x.b = z.a JOIN y w ON w.a = z.b AND w.b = x.a GROUP BY 1)
SELECT round(avg(if(g > 1, coalesce(c, 0) / (g * (g - 1)), 0)), 9) AS average_clustering, (sum(coalesce(c, 0)) / 6)::BIGINT AS triangles FROM d LEFT JOIN t USING (node)""")(
    lambda t: rnd(G.average_clustering(t["referrals"]), 9))
register("nw04_components", ("affiliations",), """WITH RECURSIVE s AS (SELECT DISTINCT provider_id AS a, facility_id AS b FROM affiliations), y AS (SELECT a, b FROM s UNION SELECT b, a FROM s),
r(node, low) AS (SELECT a, a FROM y UNION SELECT y.b, r.low FROM r JOIN y ON y.a = r.node WHERE r.low < y.b AND r.low = (SELECT min(a) FROM y)),
g AS (SELECT node, min(low) AS component FROM r GROUP BY 1) SELECT * FROM g""")(
    lambda t: G.connected_components(t["affiliations"].select(col("provider_id").alias("src"), col("facility_id").alias("dst"))))
_LP = [f"l0 AS (SELECT DISTINCT a AS node, a AS label FROM y)"] + [
    f"v{i} AS (SELECT a AS node, label, count(*) AS c FROM y JOIN l{i - 1} ON node = b GROUP BY ALL), l{i} AS (SELECT node, arg_max(label, (c, -label)) AS label FROM v{i} GROUP BY 1)" for i in range(1, 4)]
register("nw06a_communities", _E, f"WITH {_SYM}, {', '.join(_LP)} SELECT node, label AS community FROM l3")(lambda t: G.communities(t["referrals"], steps=3))
register("nw06c_communities_settled")(lambda t: rnd(G.modularity(t["referrals"], G.communities(t["referrals"])), 9))
register("nw06b_modularity", _E, f"""WITH {_SYM}, {', '.join(_LP)}, m2 AS (SELECT count(*) AS m FROM y),
k AS (SELECT u.label AS c, count(*) AS deg, count(*) FILTER (WHERE u.label = w.label) AS ins FROM y p JOIN l3 u ON u.node = p.a JOIN l3 w ON w.node = p.b GROUP BY 1)
SELECT count(*) AS communities, round(sum(ins / m - pow(deg / m, 2)), 9) AS modularity FROM k, m2""")(
    lambda t: rnd(G.modularity(t["referrals"], G.communities(t["referrals"], steps=3)), 9))
_NUM = ("l_quantity", "l_extendedprice", "l_discount", "charge", "l_linenumber")
_PAIRS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1:]]
register("nw07_correlation", (), "WITH li AS (SELECT *, l_extendedprice * (1 - l_discount) AS charge FROM lineitem), c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS src, '{b}' AS dst, corr({a}, {b}) AS weight FROM li" for a, b in _PAIRS) + ") SELECT src, dst, round(weight, 9) AS weight FROM c WHERE abs(weight) > 0.3")(
    lambda t: rnd(G.correlation_network(t["lineitem"].withColumn("charge", col("l_extendedprice") * (1 - col("l_discount"))), _NUM), 9))
register("nw08_outcome_network", ("study_rows",), """
WITH e AS (SELECT treatment[:30] AS src, CASE WHEN clinical_improvement IS NULL THEN 'unknown' WHEN lower(clinical_improvement) LIKE 'y%' THEN 'improved' ELSE 'no_improvement' END AS dst, count(*) AS weight
  FROM study_rows WHERE treatment IS NOT NULL GROUP BY ALL)
SELECT src, dst, weight, sum(weight) OVER (PARTITION BY src)::BIGINT AS total, round(weight / sum(weight) OVER (PARTITION BY src), 6) AS share FROM e""")(
    lambda t: rnd(G.outcome_network(t["study_rows"].where(col("treatment").isNotNull()).select(
        F.substring("treatment", 1, 30).alias("treatment"), F.when(col("clinical_improvement").isNull(), "unknown").when(
            F.startswith(F.lower("clinical_improvement"), lit("y")), "improved").otherwise("no_improvement").alias("outcome")), "treatment", "outcome")))
# Nations are linked when more lineitems than on average go between them (customer nation to supplier nation).
_TRADE = """
WITH w AS (SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
           WHERE c_nationkey <> s_nationkey GROUP BY ALL)
SELECT a AS src, b AS dst FROM w WHERE n > (SELECT avg(n) FROM w)
"""


def _trade(t):
    w = cut_lineage(
        t["orders"].select("o_orderkey", "o_custkey").join(t["customer"].select(col("c_custkey").alias("o_custkey"), col("c_nationkey").alias("a")), "o_custkey")
        .join(t["lineitem"].select(col("l_orderkey").alias("o_orderkey"), col("l_suppkey").alias("s")), "o_orderkey")
        .join(t["supplier"].select(col("s_suppkey").alias("s"), col("s_nationkey").alias("b")), "s").where(col("a") != col("b")).groupBy("a", "b").agg(F.count(lit(1)).alias("n")))
    mean = w.agg(F.avg("n").alias("m"))
    return w.join(F.broadcast(mean)).where(col("n") > col("m")).select(col("a").alias("src"), col("b").alias("dst"))


# Distances first, then only the shortest paths are walked.
_BETWEEN = """v AS (SELECT DISTINCT a FROM y), n AS (SELECT count(*) AS n FROM v),
g(s, node, d) AS (SELECT a, a, 0 FROM v UNION SELECT g.s, y.b, g.d + 1 FROM g JOIN y ON y.a = g.node WHERE g.d < (SELECT n FROM n)),
m AS (SELECT s, node, min(d) AS d FROM g GROUP BY ALL),
p(s, node, path) AS (SELECT a, a, [a] FROM v UNION ALL SELECT p.s, y.b, list_append(path, y.b) FROM p JOIN y ON y.a = p.node JOIN m ON m.s = p.s AND m.node = y.b AND m.d = len(path)),
c AS (SELECT s, node, count(*) AS k FROM p WHERE s <> node GROUP BY ALL), i AS (SELECT unnest(path[2:-2]) AS x, 1.0::DOUBLE / k AS f FROM p JOIN c USING (s, node) WHERE len(path) > 2)
SELECT v.a AS node, round(coalesce(sum(f), 0) / ((SELECT n FROM n) - 1) / ((SELECT n FROM n) - 2), 9) AS betweenness FROM v LEFT JOIN i ON i.x = v.a GROUP BY 1"""
register("nw05_betweenness", (), f"WITH RECURSIVE e AS ({_TRADE.strip()}), y AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), {_BETWEEN}")(
    lambda t: rnd(G.betweenness(_trade(t)), 9))

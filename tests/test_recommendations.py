"""Recommendations from meta-analysis, models, gaps and clusters."""

from cohortlens.operators import research as R
from cohortlens.plans.registry import Tables


def test_every_source_adds_its_recommendation(spark):
    rows = Tables(spark, "/root/testdata/sf0.001")["study_rows"]
    scores = spark.createDataFrame([("a", "accuracy", 0.8, False), ("b", "accuracy", 0.8764, True)], "model string, metric string, score double, is_best boolean")
    gaps = spark.createDataFrame([(f"t{i % 12}",) for i in range(30)], "source_table string")
    scan = spark.createDataFrame([(2, 9.0, False, None), (4, 5.0, True, 0.456)], "k int, cost double, chosen boolean, silhouette double")
    base = {r.category: r for r in R.recommendations(rows).collect()}
    got = {r.category: r for r in R.recommendations(rows, R.model_figures(spark, scores, gaps, scan=scan)).collect()}
    added = {c: (r.priority, r.recommendation, r.evidence) for c, r in got.items() if c not in base}
    assert added == {
        "Risk-Based Treatment": ("HIGH", "Use AI risk prediction models to stratify patients and personalize treatment intensity.",
                                 "ML model achieved 87.6% accuracy in predicting severe outcomes"),
        "Research Gap Closure": ("HIGH", "Address 30 identified research gaps through targeted funding.",
                                 "NLP analysis identified specific knowledge gaps across 10 research areas"),
        "Patient Subgroup Research": ("MEDIUM", "Focus research on 4 distinct patient phenotypes identified through ML clustering.",
                                      "Clustering analysis revealed 4 patient subgroups with silhouette score 0.46")}
    assert {c: tuple(base[c]) for c in base} == {c: tuple(got[c]) for c in base}


def test_sources_that_found_nothing_add_nothing(spark):
    rows = Tables(spark, "/root/testdata/sf0.001")["study_rows"]
    empty = R.model_figures(spark, gaps=spark.createDataFrame([], "source_table string"))
    assert sorted(map(tuple, R.recommendations(rows, empty).collect())) == sorted(map(tuple, R.recommendations(rows).collect()))
    assert R.recommendations(rows.limit(0), empty).count() <= 1

"""One-scan summaries against the functions that compute each part on its own."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlens.functions.ranking import exact_quantiles
from cohortlens.operators import research as R
from cohortlens.plans.registry import Tables


def _scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_profile_scores_equal_the_separate_ones(spark):
    rows = Tables(spark, "/root/testdata/sf0.001")["study_rows"]
    profile = R.study_profile(rows)
    got = {r.dimension: r.quality_score for r in R.dimension_scores(profile).collect()}
    want = {"sample_size": R.sample_adequacy(rows), "study_design": R.design_quality(rows), "reporting": R.reporting_quality(rows), "bias_risk": R.bias_quality(rows)}
    assert got == {k: pytest.approx(v.first()["quality_score"], abs=1e-9) for k, v in want.items()}
    # The scores read the written profile and none of the input files.
    assert all("/study-profile-" in f for f in R.dimension_scores(profile).inputFiles())
    assert _scans(R.dimension_scores(profile)) == 1
    assert all("documents.parquet" not in f for f in R.research_quality(rows).inputFiles())


def test_profile_of_an_empty_table(spark):
    rows = Tables(spark, "/root/testdata/sf0.001")["study_rows"].limit(0)
    assert R.study_profile(rows).count() == 0
    assert [r.quality_score for r in R.dimension_scores(R.study_profile(rows)).collect()] == [None] * 4
    assert R.research_quality(rows).first().sample_studies == 0


def test_weighted_quantiles(spark):
    rng = random.Random(2)
    data = [(float(rng.randrange(40)), rng.randrange(0, 6)) for _ in range(500)]
    df = spark.createDataFrame(data, "v double, w long")
    flat = df.where("w > 0").withColumn("_", F.explode(F.sequence(F.lit(1), F.col("w"))))
    probs = {"a": 0.1, "m": 0.5, "z": 0.93}
    assert exact_quantiles(df, "v", probs, weight="w", fit=10, buckets=4).first() == exact_quantiles(flat, "v", probs).first()

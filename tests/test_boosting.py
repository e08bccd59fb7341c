"""Boosted trees of counted bins against Spark ML's on single rows."""

import random

import numpy as np
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from cohortlens.operators import learning as L


def _rows(spark, n, seed=1):
    r = random.Random(seed)
    made = []
    for i in range(n):
        a, b = r.randrange(70), r.choice([0.0, 1.5, None, r.random()])
        made.append((i, r.randrange(3), a, b, 7.0, 0.1 * a * (b or 0) + r.randrange(4)))
    return spark.createDataFrame(made + made[:50], "id long, no int, a int, b double, c double, y double").repartition(3, "id")


def _both(spark, n, rounds=4):
    df, keys, features = _rows(spark, n), ("id", "no"), ["a", "b", "c"]
    train, test = L._grouped(df, keys, features, "y", 42)
    rows = L._train_rows(df, keys, features, "y", 42)
    alone = GBTRegressor(maxIter=rounds, seed=42).fit(rows).transform(test).select("label", "prediction", "n")
    order = lambda d: np.array(sorted(map(tuple, d.collect())))
    return order(L._boosted(rows, train, test, 42, rounds)), order(alone), rows


def test_bins_give_the_trees_of_single_rows(spark):
    for n in (25, 900, 14_000):  # the last is more than Spark ML's sample for candidates
        got, alone, _ = _both(spark, n)
        assert got.shape == alone.shape and np.allclose(got, alone, rtol=1e-9, atol=1e-9), n


def test_trees_learn_from_bins(spark, monkeypatch):
    seen, fit = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, d, *a: (seen.append((d.count(), d.agg(F.sum("n")).first()[0])), fit(self, d, *a))[1])
    df = spark.range(3000).select("id", F.lit(0).alias("no"), (F.col("id") % 6).alias("a"), (F.col("id") % 4).alias("b"), (F.col("id") % 9).alias("y"))
    L.stay_model(df, ("id", "no"), ["a", "b"], "y", rounds=3).collect()
    trained = L.split(df, ("id", "no"))[0].count()
    assert seen == [(12, float(trained))]

"""k-means of several k in shared passes against Spark ML, one k at a time."""

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator

from cohortlens.operators import learning as L


def _rows(spark, n=900):
    r = np.random.default_rng(7)
    at = r.normal(size=(n, 2)) + 6 * r.integers(0, 3, size=(n, 1)) * np.array([[1.0, -1.0]])
    at[: n // 3] = np.round(at[: n // 3])  # repeated points, and some that lie between two centers
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(at)], "id int, a double, b double").coalesce(1)


def test_shared_passes_give_spark_ml_models(spark, monkeypatch):
    df, ks, passes = _rows(spark), [2, 3, 4, 5], []
    real = L._assignments
    monkeypatch.setattr(L, "_assignments", lambda d, dims, centers: passes.append(len(centers)) or real(d, dims, centers))
    d, vectors = L._points(df, ("id",), ["a", "b"])
    found = L.kmeans_centers(d, vectors, 2, ks)
    alone = {k: KMeans(k=k, seed=42, maxIter=L.KMEANS_STEPS).fit(vectors.select("features")) for k in ks}
    for k in ks:
        assert np.allclose(found[k][0], alone[k].clusterCenters(), atol=1e-9)
        assert np.isclose(found[k][1], alone[k].summary.trainingCost)
    # One pass serves every k that has not settled: as many passes as the slowest k needs alone.
    assert passes[0] == len(ks) and len(passes) == max(m.summary.numIter for m in alone.values())
    labels = {r["id"]: r["cluster"] for r in L.kmeans_labels(df, ["id"], ["a", "b"], 3).collect()}
    assert labels == {r["id"]: r["prediction"] for r in alone[3].transform(vectors).collect()}


def test_scan_keeps_costs_and_silhouette(spark):
    df = _rows(spark)
    got = {r["k"]: r for r in L.kmeans_scan(df, ["a", "b"], range(2, 6)).collect()}
    d = L.scaled(df, ["a", "b"]).select("features")
    models = {k: KMeans(k=k, seed=42, maxIter=L.KMEANS_STEPS).fit(d) for k in got}
    best = L.elbow(sorted(got), [models[k].summary.trainingCost for k in sorted(got)])
    assert all(np.isclose(got[k]["cost"], models[k].summary.trainingCost) and got[k]["chosen"] == (k == best) for k in got)
    assert np.isclose(got[best]["silhouette"], ClusteringEvaluator().evaluate(models[best].transform(d)))


def _plain(x, c):
    """``count, sum of each component, cost`` by center, from single points; ties to the first center."""
    far = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    best = far.argmin(axis=1)
    parts = np.column_stack([np.ones(len(x)), x, far.min(axis=1)])
    return np.array([parts[best == j].sum(axis=0) for j in range(len(c))])


def test_cells_add_up_to_single_points(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(3000, 3)) * [1, 2, 0.1], np.round(r.normal(size=(500, 3))), np.full((200, 3), 7.5)])
    d = spark.createDataFrame([tuple(map(float, p)) for p in x], "x0 double, x1 double, x2 double").repartition(3)
    sets = {k: x[r.integers(0, len(x), k)] for k in (1, 2, 5)} | {3: np.array([[0.0, 0, 0], [0, 0, 0], [1, 0, 0]])}
    for most in (1, 40, L.CELLS):
        got = L._assignments(L._cells(d, 3, most), 3, sets)
        for k, c in sets.items():
            assert np.allclose(got[k], _plain(x, c), rtol=1e-9, atol=1e-7), (most, k)


def test_most_points_are_not_looked_at_one_by_one(spark):
    x = np.random.default_rng(5).normal(size=(4000, 2))
    cells = L._cells(spark.createDataFrame([tuple(map(float, p)) for p in x], "x0 double, x1 double"), 2)
    sure = L._owners(cells, np.array([[-1.0, 0.0], [1.0, 0.0]]))[1]
    assert cells.n.sum() == len(x) and cells.n[sure].sum() > 0.95 * len(x)


def test_points_without_width(spark):
    d = spark.createDataFrame([(1.0, 2.0)] * 5, "x0 double, x1 double")
    got = L._assignments(L._cells(d, 2), 2, {2: np.array([[1.0, 2.0], [0.0, 0.0]])})
    assert got[2].tolist() == [[5.0, 5.0, 10.0, 0.0], [0.0, 0.0, 0.0, 0.0]]

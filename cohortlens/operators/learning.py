"""Features, supervised models and clustering on Spark ML."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.extract import age_group, age_mean, first_decimal
from cohortlens.operators.graph import connected_components
from cohortlens.session import cut_lineage, stored

col, lit = F.col, F.lit

COMORBIDITY = ("comorbid", "diabetes", "hypertension", "cardiovascular", "obesity", "chronic", "disease")
CLINICAL = ("temperature", "oxygen", "pressure", "heart_rate", "respiratory", "saturation", "lab", "test")
MORTALITY = ("death", "mortality", "fatal")


def _named(df: DataFrame, words: Sequence[str]) -> list[str]:
    return [c for c in df.columns if any(w in c.lower() for w in words)]


# --- features

def age_features(df: DataFrame, column: str = "age") -> DataFrame:
    a = age_mean(col(column))
    return df.withColumn("age_numeric", a).withColumn("age_group", age_group(col("age_numeric"))).withColumn(
        "elderly", (col("age_numeric") >= 65).cast("int"))


def comorbidity_features(df: DataFrame) -> DataFrame:
    """``has_x`` for every column whose name holds a comorbidity word."""
    return df.withColumns({f"has_{c}": col(c).isNotNull().cast("int") for c in _named(df, COMORBIDITY)})


def clinical_features(df: DataFrame) -> DataFrame:
    """``x_numeric``: first number in every clinical column, aligned to its own row."""
    return df.withColumns({f"{c}_numeric": first_decimal(col(c).cast("string")) for c in _named(df, CLINICAL)})


def target_features(df: DataFrame) -> DataFrame:
    """``severe_outcome`` and ``mortality_risk`` as the largest value of the matching numeric columns, floor 0."""
    out = {}
    for name, words in (("severe_outcome", ("severe",)), ("mortality_risk", MORTALITY)):
        cols = _named(df, words)
        if cols:
            out[name] = F.greatest(lit(0), *[F.coalesce(col(c).cast("int"), lit(0)) for c in cols])
    return df.withColumns(out) if out else df


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    filled = df.withColumns({c: F.coalesce(col(c).cast("double"), lit(0.0)) for c in features})
    return VectorAssembler(inputCols=list(features), outputCol="raw").transform(filled)


def scaled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Vector column ``features`` with mean 0 and deviation 1."""
    d = assembled(df, features)
    return StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(d).transform(d)


def scaled_columns(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    d = scaled(df, features).select(*keys, vector_to_array("features").alias("_a"))
    return d.select(*keys, *[F.get("_a", lit(i)).alias(c) for i, c in enumerate(features)])


# --- models

def split(df: DataFrame, keys: Sequence[str], seed: int = 42, train_share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key, the same on any cluster layout."""
    h = F.pmod(F.xxhash64(*keys, lit(seed)), lit(10000))
    return df.where(h < int(train_share * 10000)), df.where(h >= int(train_share * 10000))


def _score_rows(spark, rows) -> DataFrame:
    return spark.createDataFrame(rows, "model string, metric string, score double")


def _grouped(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Train and test rows with ``features, label`` and their number ``n``: equal rows are one, whatever their key.

    Scaling is fitted on the rows themselves. Regression with weights and figures of predictions come out as from single rows.
    """
    model = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(assembled(df, features))
    plain = [f"_f{i}" for i in range(len(features))]
    rows = df.select(*keys, *[F.coalesce(col(c).cast("double"), lit(0.0)).alias(p) for c, p in zip(features, plain)], col(label).cast("double").alias("label"))

    def of(part: DataFrame) -> DataFrame:
        counted = stored(part.groupBy(*plain, "label").agg(F.count(lit(1)).cast("double").alias("n")), "rows")
        return model.transform(VectorAssembler(inputCols=plain, outputCol="raw").transform(counted)).select("features", "label", "n")

    train, test = split(rows, keys, seed)
    return of(train), of(test)


def _train_rows(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, seed: int) -> DataFrame:
    """Single train rows, for forests (a bootstrap by row) and the split candidates of boosted trees (from a sample of rows)."""
    d = scaled(df, features).withColumn("label", col(label).cast("double"))
    return split(d.select(*keys, "features", "label"), keys, seed)[0]


def _hits() -> Column:
    """Share of right predictions, in rows."""
    hit = (col("prediction") == col("label")).cast("int")
    return F.sum(hit * col("n")) / F.sum(F.when(hit.isNotNull(), col("n")))


def _split_candidates(trees: GBTRegressor, rows: DataFrame) -> list[list[float]]:
    """Thresholds by feature between which Spark ML's trees choose: from its own sample of the single rows."""
    sc = rows.sparkSession.sparkContext
    its = lambda c: getattr(c, "MODULE$")
    impl = sc._jvm.org.apache.spark.ml.tree.impl
    trees._transfer_params_to_java()
    single = its(getattr(sc._jvm.org.apache.spark.ml.util, "DatasetUtils$")).extractInstances(trees._java_obj, rows._jdf, its(getattr(sc._jvm.scala, "None$")))
    plan = sc._jvm.org.apache.spark.mllib.tree.configuration.Strategy.defaultStrategy("Regression")
    plan.setMaxBins(trees.getMaxBins())
    known = impl.DecisionTreeMetadata.buildMetadata(single, plan, 1, trees.getFeatureSubsetStrategy())
    found = its(getattr(impl, "RandomForest$")).findSplits(single, known, trees.getSeed())
    return [[x.threshold() for x in f] for f in found]


def _boosted(rows: DataFrame, train: DataFrame, test: DataFrame, seed: int, rounds: int) -> DataFrame:
    """``label, prediction, n`` of the ``test`` rows by boosted trees of the ``train`` rows, both counted; ``rows`` are the single ones.

    A tree knows a row by its bins alone, a bin lying between two split candidates, and squared loss knows rows by their number
    and mean label. So rows with equal bins are one weighted row, from which the trees come out as from single rows. Features
    have at most 32 bins; where few rows share all bins, there are as many as single ones.
    """
    borders = _split_candidates(GBTRegressor(seed=seed), rows)
    bins = [f"b{i}" for i in range(len(borders))]

    def binned(d: DataFrame) -> DataFrame:
        a = d.select("label", "n", vector_to_array("features").alias("_a"))
        # Counted from 1: Spark ML takes zeros as left out.
        return a.select("label", "n", *[sum(((F.get("_a", lit(i)) > lit(t)).cast("int") for t in ts), lit(1)).alias(b) for i, (b, ts) in enumerate(zip(bins, borders))])

    assembler = VectorAssembler(inputCols=bins, outputCol="features")
    learn = binned(train).groupBy(*bins).agg(F.sum("n").alias("n"), (F.sum(col("label") * col("n")) / F.sum("n")).alias("label"))
    learn = stored(learn, "bins")
    # So many bins that no row is left out of the sample for candidates, and each border of the bins is one.
    most = max(64, math.isqrt(learn.count()) + 1)
    model = GBTRegressor(maxIter=rounds, seed=seed, maxBins=most, weightCol="n").fit(assembler.transform(learn))
    return model.transform(assembler.transform(binned(test))).select("label", "prediction", "n")


def severe_outcome_models(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, seed: int = 42,
                          trees: int = 100, rounds: int = 100) -> DataFrame:
    """Scores of random forest, logistic regression (accuracy) and boosted trees (1 - MSE), best first."""
    train, test = _grouped(df, keys, features, label, seed)
    acc = lambda m: m.transform(test).agg(_hits()).first()[0]
    rows = cut_lineage(_train_rows(df, keys, features, label, seed))
    rf = acc(RandomForestClassifier(numTrees=trees, seed=seed).fit(rows))
    lr = acc(LogisticRegression(maxIter=100, weightCol="n").fit(train))
    gbt = _boosted(rows, train, test, seed, rounds)
    mse = gbt.agg(F.sum(col("n") * F.pow(col("prediction") - col("label"), lit(2))) / F.sum("n")).first()[0]
    rows = [("random_forest", "accuracy", float(rf)), ("logistic_regression", "accuracy", float(lr)), ("gradient_boosting", "one_minus_mse", 1 - float(mse))]
    out = _score_rows(df.sparkSession, rows)
    best = max(rows, key=lambda r: r[2])[0]
    return out.withColumn("is_best", col("model") == best).orderBy(col("score").desc())


def mortality_model(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, seed: int = 42, trees: int = 100) -> DataFrame:
    _, test = _grouped(df, keys, features, label, seed)
    pred = RandomForestClassifier(numTrees=trees, seed=seed).fit(_train_rows(df, keys, features, label, seed)).transform(test)
    return pred.agg(_hits().alias("accuracy"), F.coalesce(F.sum("n"), lit(0)).cast("long").alias("tested"))


def stay_model(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, seed: int = 42, rounds: int = 100) -> DataFrame:
    train, test = _grouped(df, keys, features, label, seed)
    pred = cut_lineage(_boosted(_train_rows(df, keys, features, label, seed), train, test, seed, rounds))
    ev = lambda m: float(RegressionEvaluator(metricName=m, weightCol="n").evaluate(pred))
    return _score_rows(df.sparkSession, [("length_of_stay", "mse", ev("mse")), ("length_of_stay", "r2", ev("r2"))])


def feature_importance(df: DataFrame, features: Sequence[str], label: str, seed: int = 42, trees: int = 100, top_n: int = 10) -> DataFrame:
    d = scaled(df, features).withColumn("label", col(label).cast("double"))
    imp = RandomForestClassifier(numTrees=trees, seed=seed).fit(d).featureImportances
    rows = [(c, float(imp[i])) for i, c in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(col("importance").desc()).limit(top_n)


def model_overview(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("score").alias("average_score"), F.max("score").alias("best_score"), F.min("score").alias("worst_score"),
                      F.stddev_pop("score").alias("score_std"))


# --- clustering

KMEANS_STEPS = 300
#: Cells of the grid over the points of k-means, whose sums the driver keeps.
CELLS = 1 << 16


def elbow(ks: Sequence[int], costs: Sequence[float]) -> int:
    """The k two places after the start of the sharpest bend of the cost curve; the middle k when that is outside."""
    if len(costs) < 3:
        return ks[0] if ks else 3
    first = [b - a for a, b in zip(costs, costs[1:])]
    second = [b - a for a, b in zip(first, first[1:])]
    i = max(range(len(second)), key=lambda j: second[j]) + 2
    return ks[i] if i < len(ks) else ks[len(ks) // 2]


def _points(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The scaled rows, written once: as columns ``x0, x1 …`` beside the keys, and with the vector ``features`` too."""
    x = [f"x{i}" for i in range(len(features))]
    d = scaled(df, features).select(*keys, vector_to_array("features").alias("_a")).select(
        *keys, *[F.get("_a", lit(i)).alias(c) for i, c in enumerate(x)])
    d = stored(d, "points", row_group=4 << 20)
    return d, VectorAssembler(inputCols=x, outputCol="features").transform(d)


class _Cells(NamedTuple):
    """A grid over points: the points ``x0, x1 …`` with their ``cell``, and for each cell that holds any its number, points, sum
    of components, sum of squares and box."""
    rows: DataFrame
    size: int
    at: np.ndarray
    n: np.ndarray
    total: np.ndarray
    norm: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def _cells(d: DataFrame, dims: int, most: int = CELLS) -> _Cells:
    """Points by cells of equal width, at most ``most`` of them whatever the number of points."""
    x = [f"x{i}" for i in range(dims)]
    side = max(1, int(most ** (1 / dims) + 1e-9))
    ends = d.agg(*[F.min(c) for c in x], *[F.max(c) for c in x]).first()
    cell = lit(0)
    for c, lo, hi in zip(x, ends[:dims], ends[dims:]):
        # No width (or none that is a number): one place for all.
        place = F.least(lit(side - 1), F.floor((col(c) - lit(lo)) / lit(hi - lo) * lit(side)).cast("int")) if lo is not None and hi > lo else lit(0)
        cell = cell * lit(side) + place
    rows = stored(d.select(*x, cell.alias("cell")), "cells", row_group=4 << 20)
    norm = sum((col(c) * col(c) for c in x), lit(0.0))
    t = rows.groupBy("cell").agg(F.count(lit(1)).cast("double"), *[F.sum(c) for c in x], F.sum(norm), *[F.min(c) for c in x], *[F.max(c) for c in x]).toArrow()
    of = [t.column(i).to_numpy() for i in range(t.num_columns)]
    some = lambda i: np.column_stack(of[i:i + dims])
    return _Cells(rows, side ** dims, of[0], of[1], some(2), of[2 + dims], some(3 + dims), some(3 + 2 * dims))


def _owners(cells: _Cells, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The center nearest to each cell's mean, and whether it is the nearest one, by a margin, to every point of the cell's box."""
    half, every = 0.5 * np.einsum("ij,ij->i", c, c), np.arange(len(cells.n))
    own = (half[:, None] - c @ (cells.total / cells.n[:, None]).T).argmin(axis=0)
    # Half the squared distance to another center less that to the own one is linear: its least value lies at a corner.
    lead = half[None, :] - half[own][:, None]
    for i in range(c.shape[1]):
        apart = c[own, i][:, None] - c[None, :, i]
        lead += np.minimum(apart * cells.lo[:, i, None], apart * cells.hi[:, i, None])
    lead[every, own] = np.inf
    margin = 1e-9 * (1 + np.abs(c).max() * max(np.abs(cells.lo).max(), np.abs(cells.hi).max()))
    return own, lead.min(axis=1) > margin


def _assignments(cells: _Cells, dims: int, centers: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For several sets of centers: for each its rows ``count, sum of each component, cost`` by center.

    A cell that lies with one center as a whole adds its sums; one pass looks at the points of the others.
    """
    out: dict[int, np.ndarray] = {}
    open_: dict[int, np.ndarray] = {}
    for k, c in centers.items():
        own, sure = _owners(cells, c)
        at = own[sure]
        n, total = cells.n[sure], cells.total[sure]
        cost = cells.norm[sure] - 2 * np.einsum("ij,ij->i", c[at], total) + n * np.einsum("ij,ij->i", c, c)[at]
        out[k] = np.column_stack([np.bincount(at, w, minlength=len(c)) for w in (n, *total.T, np.maximum(cost, 0))])
        if not sure.all():
            mask = np.zeros(cells.size, bool)
            mask[cells.at[~sure]] = True
            open_[k] = mask
    if not open_:
        return out
    packed = {k: np.packbits(m) for k, m in open_.items()}

    def summed(batches):
        look = {k: np.unpackbits(m).astype(bool) for k, m in packed.items()}
        got = {k: np.zeros((len(centers[k]), dims + 2)) for k in open_}
        for b in batches:
            cell, points = b.column(dims).to_numpy(), np.column_stack([b.column(i).to_numpy() for i in range(dims)])
            for k, m in look.items():
                c, x = centers[k], points[m[cell]]
                xt, norm = np.ascontiguousarray(x.T), np.einsum("ij,ij->i", x, x)
                # Half the squared distance, less the point's own part: a row for each center.
                far = c @ xt
                np.subtract(0.5 * np.einsum("ij,ij->i", c, c)[:, None], far, out=far)
                best = far.min(axis=0)
                mine = far == best
                if np.count_nonzero(mine) != len(x):  # ties go to the first center
                    mine = np.arange(len(c))[:, None] == far.argmin(axis=0)
                share = mine.astype(float)
                got[k][:, 0] += share.sum(axis=1)
                got[k][:, 1:-1] += share @ x
                got[k][:, -1] += share @ np.maximum(norm + 2 * best, 0)
        for k, g in got.items():
            yield pa.RecordBatch.from_pydict({"k": [k], "g": [g.ravel().tolist()]})

    # A byte for each cell: whether any set of centers has to look at its points.
    looked = F.substring(lit(bytearray(np.logical_or.reduce(list(open_.values())).tobytes())), col("cell") + 1, lit(1)) == lit(bytearray(b"\x01"))
    # A row for each task and set of centers.
    for r in cells.rows.where(looked).mapInArrow(summed, "k long, g array<double>").collect():
        out[r["k"]] = out[r["k"]] + np.array(r["g"]).reshape(-1, dims + 2)
    return out


def kmeans_centers(d: DataFrame, vectors: DataFrame, dims: int, ks: Sequence[int], seed: int = 42, tol: float = 1e-4) -> dict[int, tuple[np.ndarray, float]]:
    """Centers and cost of k-means for each k: Spark ML's starting centers, then Lloyd's steps of all k in shared passes over the
    points whose cell of a grid does not lie with one center as a whole.

    As in Spark ML, a k has settled when no center moves more than ``tol``; the cost is that of the last assignment.
    """
    vectors = vectors.select("features").persist()
    try:
        now = {k: np.array(KMeans(k=k, seed=seed, maxIter=0).fit(vectors).clusterCenters()) for k in ks}
    finally:
        vectors.unpersist()
    cost, left, cells = dict.fromkeys(ks, 0.0), set(ks), _cells(d, dims)
    for _ in range(KMEANS_STEPS):
        for k, g in _assignments(cells, dims, {k: now[k] for k in left}).items():
            n, moved = g[:, :1], now[k].copy()
            np.divide(g[:, 1:-1], n, out=moved, where=n > 0)
            if (((moved - now[k]) ** 2).sum(axis=1) <= tol * tol).all():
                left.discard(k)
            now[k], cost[k] = moved, float(g[:, -1].sum())
        if not left:
            break
    return {k: (now[k], cost[k]) for k in ks}


def _nearest(vectors: DataFrame, centers: np.ndarray) -> DataFrame:
    """``prediction``: the nearest center, ties to the smaller number."""
    far = lambda c: sum(((col(f"x{i}") - lit(float(v))) * (col(f"x{i}") - lit(float(v))) for i, v in enumerate(c)), lit(0.0))
    return vectors.withColumn("prediction", F.array_min(F.array(*[F.struct(far(c).alias("d"), lit(j).alias("j")) for j, c in enumerate(centers)]))["j"])


def kmeans_scan(df: DataFrame, features: Sequence[str], ks: Sequence[int] = range(2, 11), seed: int = 42) -> DataFrame:
    """Cost per k, with the elbow marked and the silhouette of the chosen k."""
    ks = list(ks)
    d, vectors = _points(df, (), features)
    found = kmeans_centers(d, vectors, len(features), ks, seed)
    costs = [found[k][1] for k in ks]
    best = elbow(ks, costs)
    sil = float(ClusteringEvaluator().evaluate(_nearest(vectors, found[best][0])))
    return df.sparkSession.createDataFrame(
        [(k, c, k == best, sil if k == best else None) for k, c in zip(ks, costs)], "k int, cost double, chosen boolean, silhouette double")


def chosen_k(df: DataFrame, features: Sequence[str], seed: int = 42) -> int:
    """The k at the elbow of ``kmeans_scan``."""
    return kmeans_scan(df, features, seed=seed).where("chosen").first()["k"]


def kmeans_labels(df: DataFrame, keys: Sequence[str], features: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    d, vectors = _points(df, keys, features)
    return _nearest(vectors, kmeans_centers(d, vectors, len(features), [k], seed)[k][0]).select(*keys, col("prediction").alias("cluster"))


def clustering_comparison(df: DataFrame, features: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """Silhouette of k-means and the divisive hierarchy for the same k, best marked."""
    d, vectors = _points(df, (), features)
    score = lambda rows: float(ClusteringEvaluator().evaluate(rows))
    centers = kmeans_centers(d, vectors, len(features), [k], seed)[k][0]
    divided = BisectingKMeans(k=k, seed=seed).fit(vectors).transform(vectors)
    rows = [("kmeans", score(_nearest(vectors, centers)), k), ("hierarchical", score(divided), k)]
    best = max(rows, key=lambda r: r[1])[0]
    return df.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows], "method string, silhouette double, n_clusters int, is_best boolean")


def hierarchical_labels(df: DataFrame, keys: Sequence[str], features: Sequence[str], k: int = 3, seed: int = 42) -> DataFrame:
    _, d = _points(df, keys, features)
    return BisectingKMeans(k=k, seed=seed).fit(d).transform(d).select(*keys, col("prediction").alias("cluster"))


def principal_axes(df: DataFrame, keys: Sequence[str], features: Sequence[str], k: int = 2) -> DataFrame:
    d = scaled(df, features)
    out = PCA(k=k, inputCol="features", outputCol="pca").fit(d).transform(d).select(*keys, vector_to_array("pca").alias("_a"))
    return out.select(*keys, *[F.get("_a", lit(i)).alias(f"pc{i + 1}") for i in range(k)])


# --- density clustering

def _box_distance(a: str, b: str, dims: int) -> tuple[Column, Column]:
    """Squared smallest and largest distance between the boxes ``lo/hi`` of two structs."""
    near, far = lit(0.0), lit(0.0)
    for i in range(dims):
        gap = F.greatest(lit(0.0), col(f"{a}_lo{i}") - col(f"{b}_hi{i}"), col(f"{b}_lo{i}") - col(f"{a}_hi{i}"))
        reach = F.greatest(F.abs(col(f"{a}_hi{i}") - col(f"{b}_lo{i}")), F.abs(col(f"{b}_hi{i}") - col(f"{a}_lo{i}")))
        near, far = near + gap * gap, far + reach * reach
    return near, far


def dbscan(df: DataFrame, keys: Sequence[str], features: Sequence[str], eps: float = 0.5, min_points: int = 3,
           max_levels: int = 60) -> DataFrame:
    """Exact DBSCAN labels ``keys, cluster, is_core`` for few dimensions; NULL cluster is noise.

    The grid side is ``eps / sqrt(d)``, so points of one cell are always neighbours: a cell with ``min_points`` points
    is all core and needs no distances. Only points of thinner cells look at neighbouring cells, and two core cells
    are linked by comparing bounding boxes that are halved until each cell pair is decided, so a crowded cell never
    forms all pairs. Clusters are connected components of cells. A border point near several clusters takes the
    smallest one.
    """
    d = len(features)
    side, eps2 = eps / math.sqrt(d), eps * eps
    x = [f"_x{i}" for i in range(d)]
    rows = df.select(*keys, *[col(f).cast("double").alias(x[i]) for i, f in enumerate(features)])
    cell = F.concat_ws(",", *[F.floor(col(c) / side).cast("string") for c in x])
    pts = rows.groupBy(*x).agg(F.count(lit(1)).alias("n")).withColumn("cell", cell).withColumns(
        {f"_g{i}": F.floor(col(c) / side) for i, c in enumerate(x)})
    sizes = pts.groupBy("cell").agg(F.sum("n").alias("cell_n"))
    pts = cut_lineage(pts.join(sizes, "cell"))

    r = math.ceil(math.sqrt(d))
    offsets = [o for o in itertools.product(range(-r, r + 1), repeat=d) if sum(max(0, abs(v) - 1) ** 2 for v in o) <= d]
    near_cells = F.explode(F.array(*[
        F.concat_ws(",", *[(col(f"_g{i}") + o[i]).cast("string") for i in range(d)]) for o in offsets]))
    thin = pts.where(col("cell_n") < min_points)
    dist2 = lit(0.0)
    for c in x:
        dist2 = dist2 + (col(c) - col(f"o{c}")) * (col(c) - col(f"o{c}"))
    others = lambda p: p.select(col("cell").alias("near"), *[col(c).alias(f"o{c}") for c in x], "n_other", *[c for c in p.columns if c.startswith("z_")])
    looked = thin.select("cell", *x, near_cells.alias("near")).join(others(pts.withColumnRenamed("n", "n_other")), "near").where(dist2 <= eps2)
    counted = looked.groupBy(*x).agg(F.sum("n_other").alias("around"))
    core = cut_lineage(
        pts.where(col("cell_n") >= min_points).select("cell", *x, "n", *[f"_g{i}" for i in range(d)]).unionByName(
            thin.join(counted, x).where(col("around") >= min_points).select("cell", *x, "n", *[f"_g{i}" for i in range(d)])))

    links = _cell_links(core, x, near_cells, eps2, side, max_levels)
    comp = connected_components(links.unionByName(core.select(col("cell").alias("src"), col("cell").alias("dst")).distinct()))
    ids = cut_lineage(core.join(comp.select(col("node").alias("cell"), "component"), "cell").select(*x, "cell", col("component").alias("z_c")))
    # Cluster names do not depend on cells: the smallest core point of the component, as text.
    first = ids.groupBy("z_c").agg(F.min(F.struct(*x)).alias("m"))
    named = ids.join(first, "z_c").select(*x, "cell", F.concat_ws("|", *[F.col(f"m.{c}").cast("string") for c in x]).alias("z_id"))
    border = thin.join(named.select(*x), x, "left_anti").select("cell", *x, near_cells.alias("near")).join(
        others(named.withColumn("n_other", lit(1))), "near").where(dist2 <= eps2).groupBy(*x).agg(F.min("z_id").alias("z_id"))
    labels = named.select(*x, "z_id", lit(True).alias("is_core")).unionByName(border.select(*x, "z_id", lit(False).alias("is_core")))
    return rows.join(labels, x, "left").select(*keys, col("z_id").alias("cluster"), F.coalesce("is_core", lit(False)).alias("is_core"))


def _cell_links(core: DataFrame, x: Sequence[str], near_cells: Column, eps2: float, side: float, max_levels: int) -> DataFrame:
    """Pairs of core cells with two core points within eps, decided on bounding boxes of halving size."""
    d = len(x)

    def boxes(level: int) -> DataFrame:
        width = side / (2 ** level)
        at = F.concat_ws(",", *[F.floor(col(c) / width).cast("string") for c in x])
        up = F.concat_ws(",", *[F.floor(col(c) / (width * 2)).cast("string") for c in x])
        return core.groupBy("cell", at.alias("box"), up.alias("parent")).agg(
            *[F.min(c).alias(f"lo{i}") for i, c in enumerate(x)], *[F.max(c).alias(f"hi{i}") for i, c in enumerate(x)])

    def side_of(b: DataFrame, p: str) -> DataFrame:
        return b.select(*[col(c).alias(f"{p}_{c}") for c in b.columns])

    near, far = _box_distance("a", "b", d)
    cells = core.select("cell", *[f"_g{i}" for i in range(d)]).distinct()
    b0 = boxes(0)
    start = cells.select(col("cell").alias("a_cell"), near_cells.alias("b_cell")).where(col("a_cell") < col("b_cell"))
    pairs = start.join(side_of(b0, "a"), "a_cell").join(side_of(b0, "b"), "b_cell")
    linked = None
    for level in range(1, max_levels + 1):
        judged = pairs.select("a_cell", "b_cell", "a_box", "b_box", near.alias("near2"), far.alias("far2")).where(col("near2") <= eps2)
        judged = cut_lineage(judged)
        sure = judged.where(col("far2") <= eps2).select("a_cell", "b_cell").distinct()
        linked = sure if linked is None else linked.unionByName(sure)
        open_ = judged.join(sure, ["a_cell", "b_cell"], "left_anti")
        if open_.isEmpty():
            break
        b = boxes(level)
        pairs = (
            open_.select("a_cell", "b_cell", col("a_box").alias("a_parent"), col("b_box").alias("b_parent"))
            .join(side_of(b, "a"), ["a_cell", "a_parent"]).join(side_of(b, "b"), ["b_cell", "b_parent"]))
    else:
        raise RuntimeError(f"cell pairs are still open after {max_levels} halvings")
    return linked.select(col("a_cell").alias("src"), col("b_cell").alias("dst"))


def cluster_counts(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count_distinct("cluster").alias("clusters"), F.count_if(col("cluster").isNull()).alias("noise_points"),
                      F.count_if("is_core").alias("core_points"), F.count(lit(1)).alias("points"))

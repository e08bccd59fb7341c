"""Distributed algorithms against brute force on small data."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.functions.ranking import exact_quantiles, numbered, prefix_sums, rolling
from cohortlens.operators import graph as G
from cohortlens.operators import joins as J
from cohortlens.operators import learning as L
from cohortlens.operators import monitoring as O
from cohortlens.operators import recommend as RC
from cohortlens.operators import survival as SV
from cohortlens.operators import text as T
from cohortlens.streaming import jobs

col = F.col


def test_quantiles_with_a_hot_value(spark):
    rng = random.Random(1)
    data = [("a", 5.0)] * 400 + [("a", rng.random() * 10) for _ in range(600)] + [("b", float(i)) for i in range(7)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r["g"]: r for r in exact_quantiles(df, "v", {"q1": 0.25, "m": 0.5, "p95": 0.95}, ["g"], buckets=16).collect()}
    for g in "ab":
        vals = np.array([v for k, v in data if k == g])
        for n, p in (("q1", 0.25), ("m", 0.5), ("p95", 0.95)):
            assert got[g][n] == pytest.approx(np.quantile(vals, p))


def test_numbered_and_rolling_across_blocks(spark):
    rng = random.Random(2)
    data = [(i, "hot" if i % 3 else "cold", rng.random()) for i in range(500)]
    df = spark.createDataFrame(data, "i long, k string, v double")
    pos = numbered(df, ["k"], [col("i")], F.floor(col("i") / 37))
    out = {r.i: r for r in rolling(pos, ["k"], "pos", 10, {"m": F.avg("v")}, block=16).collect()}
    assert len(out) == 500
    for k in ("hot", "cold"):
        rows = [r for r in data if r[1] == k]
        for p, (i, _, _) in enumerate(rows):
            assert out[i].pos == p
            assert out[i].m == pytest.approx(np.mean([r[2] for r in rows[max(0, p - 9):p + 1]]))
    run = {r.i: r.s for r in prefix_sums(df, ["k"], [col("i")], F.floor(col("i") / 41), {"s": col("v")}).collect()}
    for k in ("hot", "cold"):
        total = 0.0
        for i, kk, v in data:
            if kk == k:
                total += v
                assert run[i] == pytest.approx(total)


def _components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_components_chain_star_and_islands(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 40)] + [(200, 200)] + [
        (rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(35)]
    got = {r.node: r.component for r in G.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == _components(edges)


def _brute_betweenness(edges):
    adj = {}
    for a, b in edges:
        if a != b:
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
    score = dict.fromkeys(adj, 0.0)
    for s in adj:
        dist, sigma, order, pred = {s: 0}, {s: 1.0}, [s], {s: []}
        for v in order:
            for w in adj[v]:
                if w not in dist:
                    dist[w], sigma[w], pred[w] = dist[v] + 1, 0.0, []
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    pred[w].append(v)
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in pred[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    n = len(adj)
    return {k: v / ((n - 1) * (n - 2)) for k, v in score.items()}


def test_betweenness_and_clustering(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(20), rng.randrange(20)) for _ in range(40)]
    df = spark.createDataFrame(edges, "src long, dst long")
    want = _brute_betweenness(edges)
    got = {r.node: r.betweenness for r in G.betweenness(df).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    und = {(min(a, b), max(a, b)) for a, b in edges if a != b}
    tri = sum(1 for a, b, c in itertools.combinations(range(20), 3) if {(a, b), (a, c), (b, c)} <= und)
    assert G.average_clustering(df).first()["triangles"] == tri
    assert sum(r.degree for r in G.degrees(df).collect()) == 2 * len(und)


def test_betweenness_in_batches(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(18), rng.randrange(18)) for _ in range(34)]
    df = spark.createDataFrame(edges, "src long, dst long")
    want = _brute_betweenness(edges)
    n = len(want)
    ranked, batches = G.source_batches(spark.createDataFrame([(x,) for x in want], "node long"), n, 7 * n + 3)
    assert batches == -(-n // 7) and max(r["count"] for r in ranked.groupBy("batch").count().collect()) * n <= 7 * n + 3
    got = {r.node: r.betweenness for r in G.betweenness(df, max_state=7 * n + 3).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert G.betweenness(df.limit(0)).count() == 0


def _brute_dbscan(pts, eps, m):
    n = len(pts)
    near = [[j for j in range(n) if sum((a - b) ** 2 for a, b in zip(pts[i], pts[j])) <= eps * eps] for i in range(n)]
    core = [len(x) >= m for x in near]
    comp = _components([(i, j) for i in range(n) if core[i] for j in near[i] if core[j]])
    return core, comp, near


@pytest.mark.parametrize("dims,seed", [(2, 5), (3, 6), (1, 7)])
def test_dbscan_matches_brute_force(spark, dims, seed):
    rng = random.Random(seed)
    pts = [tuple(rng.gauss(c, 0.35) for _ in range(dims)) for c in (0, 2.2, 4.0) for _ in range(45)] + [
        tuple(rng.uniform(-3, 8) for _ in range(dims)) for _ in range(40)] + [(1.0,) * dims] * 30
    names = [f"f{i}" for i in range(dims)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id long, " + ", ".join(f"{n} double" for n in names))
    got = {r.id: (r.cluster, r.is_core) for r in L.dbscan(df, ["id"], names, 0.5, 3).collect()}
    core, comp, near = _brute_dbscan(pts, 0.5, 3)
    assert [got[i][1] for i in range(len(pts))] == core
    seen = {}
    for i in range(len(pts)):
        if core[i]:
            assert seen.setdefault(comp[i], got[i][0]) == got[i][0]
        elif any(core[j] for j in near[i]):
            assert got[i][0] in {got[j][0] for j in near[i] if core[j]}
        else:
            assert got[i][0] is None
    assert len(set(seen.values())) == len(seen)


def test_similar_names_is_exact(spark):
    names = ["Ann Smith1", "Ann Smith12", "Ann  Smith1", "Bob Jones", "Bob Jonas", "bob jones", "Roberta Johnson", "Robert Johnson", "X"]
    df = spark.createDataFrame([(n,) for n in names], "name string")

    def grams(s):
        s = "  " + s.lower() + " "
        return {s[i:i + 3] for i in range(len(s) - 2)}

    for t in (0.5, 0.8):
        want = {(a, b) for a in names for b in names if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) > t}
        assert {(r.n1, r.n2) for r in J.similar_names(df, df, "name", t).collect()} == want


def test_interval_overlap_counts(spark):
    rng = random.Random(8)
    d0 = dt.date(2024, 1, 1)
    rows = [(f"k{i % 3}", i, d0 + dt.timedelta(days=rng.randrange(100)), None if i % 5 == 0 else rng.randrange(40)) for i in range(60)]
    rows = [(k, i, s, None if n is None else s + dt.timedelta(days=n)) for k, i, s, n in rows]
    df = spark.createDataFrame(rows, "k string, i long, s date, e date")
    got = {r.i: r.overlaps for r in J.overlapping_intervals(df, "k", "i", "s", "e").collect()}
    for k, i, s, _ in rows:
        assert got[i] == sum(1 for k2, i2, s2, e2 in rows if k2 == k and (s2, i2) < (s, i) and (e2 or dt.date.max) >= s)


def test_nearest_patients_exact(spark):
    rng = random.Random(9)
    items = ["a", "b", "c", "d"]
    data = [(p, rng.choice(items), int(rng.random() < 0.6)) for p in range(80) for _ in range(6)]
    df = spark.createDataFrame(data, "patient_id long, treatment string, outcome int")
    vec = {}
    for p in range(80):
        v = np.array([np.mean([o for q, t, o in data if q == p and t == it] or [0]) for it in items])
        if v.any():
            vec[p] = v / np.linalg.norm(v)
    want = {}
    for p in vec:
        want[p] = sorted(((-round(float(vec[p] @ vec[q]), 9), q) for q in vec if q != p))[:5]
    got = {}
    for r in RC.nearest_patients(df, None, 5, cell_rows=12, block_rows=7).collect():
        got.setdefault(r.patient_id, []).append((-r.similarity, r.neighbour))
    assert {p: sorted(v) for p, v in got.items()} == {p: sorted(v) for p, v in want.items()}


def test_nearest_patients_takes_every_treatment(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "rare", 1), (3, "rare", 1), (3, None, 1), (4, "a", 0)], "patient_id long, treatment string, outcome int")
    got = {(r.patient_id, r.rank): (r.neighbour, r.similarity) for r in RC.nearest_patients(df, k=1).collect()}
    assert got == {(1, 1): (2, 0.0), (2, 1): (3, 1.0), (3, 1): (2, 1.0)}
    assert RC.nearest_patients(df.limit(0)).count() == 0


def test_nearest_patients_visits_do_not_grow_with_the_directions(spark):
    rng = np.random.default_rng(3)
    per = []
    for n in (1000, 4000, 16000):
        u = np.abs(rng.normal(size=(n, 3)))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        df = spark.createDataFrame(pd.DataFrame({"vid": np.arange(n), "u": list(u), "ids": [[i] for i in range(n)]}), "vid long, u array<double>, ids array<long>")
        members, levels = RC.cells(df, 128)
        assert levels[-1].agg(F.max("n")).first()[0] <= 128
        per.append(RC.visits(members, levels, RC._own_cell(members, 5, 9), 5).count() / n)
    assert per[2] <= 1.3 * per[0] + 0.5, per


def test_cells_end_on_values_that_quantiles_do_not_split(spark):
    u = [[0.0, 1.0]] + [[1.0, i * 1e-6] for i in range(300)]  # nearly all equal to the maximum of the widest component
    df = spark.createDataFrame([(i, v, [i]) for i, v in enumerate(u)], "vid long, u array<double>, ids array<long>")
    members, levels = RC.cells(df, 20)
    assert members.count() == 301 and levels[-1].agg(F.max("n")).first()[0] <= 20


def _survival(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, g = rng.gauss(0, 1), rng.choice("AB")
        t = max(1, int(rng.expovariate(0.05 * math.exp(0.7 * x + (0.5 if g == "A" else 0)))))
        rows.append((i, t, int(rng.random() < 0.7), x, 1 if g == "A" else 0, g))
    return rows


def test_cox_matches_dense_newton(spark):
    rows = _survival(10)
    df = spark.createDataFrame(rows, "i long, t int, e int, x double, a int, g string")
    got = {r.covariate: r for r in SV.cox_fit(df, "t", "e", ["x", "a"]).collect()}
    t, e = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    x = np.array([[r[3], r[4]] for r in rows], dtype=float)
    b = np.zeros(2)
    for _ in range(30):
        w = np.exp(x @ b)
        g, h = np.zeros(2), np.zeros((2, 2))
        for i in np.nonzero(e)[0]:
            at = t >= t[i]
            m = (w[at, None] * x[at]).sum(0) / w[at].sum()
            g += x[i] - m
            h += (w[at, None, None] * x[at][:, :, None] * x[at][:, None, :]).sum(0) / w[at].sum() - np.outer(m, m)
        b = b + np.linalg.solve(h, g)
    assert got["x"].coefficient == pytest.approx(b[0], abs=1e-6) and got["a"].coefficient == pytest.approx(b[1], abs=1e-6)
    assert got["x"].std_error == pytest.approx(math.sqrt(np.linalg.inv(h)[0, 0]), rel=1e-4)
    risk = np.round(x @ b, 9)
    num = den = 0.0
    for i in range(len(rows)):
        for j in range(len(rows)):
            if e[i] and (t[j] > t[i] or (t[j] == t[i] and not e[j])):
                den += 1
                num += 1.0 if risk[i] > risk[j] else 0.5 if risk[i] == risk[j] else 0.0
    assert got["x"].concordance == pytest.approx(num / den, abs=1e-3)


def test_concordance_counts_pairs_exactly(spark):
    rng = random.Random(11)
    rows = [(float(rng.randrange(1, 30)), 1, int(rng.random() < 0.6), float(rng.randrange(12))) for _ in range(150)]
    df = spark.createDataFrame(rows, "t double, n long, d long, risk double")
    num = den = 0.0
    for ti, _, ei, ri in rows:
        for tj, _, ej, rj in rows:
            if ei and (tj > ti or (tj == ti and not ej)):
                den += 1
                num += 1.0 if ri > rj else 0.5 if ri == rj else 0.0
    assert SV.concordance(df, "risk").first()[0] == pytest.approx(num / den, abs=1e-12)


def test_km_is_monotone_and_logrank_tail(spark):
    df = spark.createDataFrame(_survival(12), "i long, t int, e int, x double, a int, g string")
    s = [r.survival for r in SV.km_curve(df, "t", "e").orderBy("t").collect()]
    assert all(a >= b - 1e-12 for a, b in zip(s, s[1:])) and s[0] <= 1
    assert SV.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert SV.chi2_tail(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-9)
    assert SV.chi2_tail(7.814727903251179, 3) == pytest.approx(0.05, abs=1e-9)
    assert SV.chi2_tail(11.070497693516351, 5) == pytest.approx(0.05, abs=1e-9)
    row = SV.logrank(df, "t", "e", "g").first()
    assert row.test == "A_vs_B" and 0 <= row.p_value <= 1


def test_cooldown_batch_equals_sequential(spark):
    rng = random.Random(13)
    t0 = dt.datetime(2024, 1, 1)
    hits = [(f"r{i % 2}", t0 + dt.timedelta(seconds=rng.randrange(200_000)), 15 if i % 2 else 40) for i in range(800)]
    want = set()
    for rule in ("r0", "r1"):
        last = None
        for _, ts, cool in sorted(h for h in hits if h[0] == rule):
            if last is None or ts >= last + dt.timedelta(minutes=cool):
                want.add((rule, ts))
                last = ts
    df = spark.createDataFrame(hits, "rule string, ts timestamp, cooldown_minutes int")
    for block in (7, 100, 100_000):
        assert {(r.rule, r.ts) for r in O.cooldown_emissions(df, block=block).collect()} == want


def test_streams_over_several_batches(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    src = str(tmp_path / "in")
    rows = [("r", t0 + dt.timedelta(minutes=m), 10) for m in range(0, 90, 4)]
    for i in range(0, len(rows), 6):
        spark.createDataFrame(rows[i:i + 6], "rule string, ts timestamp, cooldown_minutes int").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("rule string, ts timestamp, cooldown_minutes int").option("maxFilesPerTrigger", 1).parquet(src)
    got = jobs.run_closed(stream, str(tmp_path / "out"))
    assert got.select("batch_id").distinct().count() > 1
    batch = O.cooldown_emissions(spark.read.parquet(src))
    assert {r.ts for r in got.collect()} == {r.ts for r in batch.collect()}


def test_escalation_and_rule_operators(spark):
    df = spark.createDataFrame([(m,) for m in (0, 4, 5, 15, 20, 49, 50, 109, 110)], "m int")
    assert [r[0] for r in df.select(O.escalation_level(col("m"))).collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4]
    assert [r[0] for r in df.select(O.escalation_level(col("m"), wait_first=False)).collect()] == [1, 1, 1, 2, 2, 3, 3, 4, 4]
    ops = spark.createDataFrame([("==", 1.0005), ("!=", 1.0005), ("==", 1.002), ("?", 5.0)], "op string, v double")
    assert [r[0] for r in ops.select(O.compare(col("v"), col("op"), F.lit(1.0))).collect()] == [True, False, False, False]


def test_gap_context_and_topics(spark):
    text = "x" * 80 + " The evidence is LIMITED here " + "y" * 120
    df = spark.createDataFrame([(1, text), (2, "limited")], "id long, text string")
    got = {r.id: r.context for r in T.research_gaps(df, "text", ["id"]).collect()}
    at = text.lower().find("limited")
    assert got == {1: text[at - 50:at + 100], 2: "limited"}

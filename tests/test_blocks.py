"""Work on hot keys is dealt out in blocks of bounded rows, and results do not depend on the blocks."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import ranking as R
from cohortlens.operators import monitoring as O
from cohortlens.operators import windows as W

col = F.col


def test_cuts_are_equi_depth_within_an_hour(spark):
    """All rows of the hot key lie within one hour."""
    df = spark.range(400_000).select(
        F.when(col("id") % 10 == 0, F.concat(F.lit("cold"), col("id") % 1000)).otherwise("hot").alias("k"),
        (F.lit(1_700_000_000) + F.pmod(F.xxhash64("id"), F.lit(3600))).alias("ts"), "id")
    assert R.splitters(df.where("k <> 'hot'"), ["k"], [col("ts"), col("id")], 5000) is None
    cuts = R.splitters(df, ["k"], [col("ts"), col("id")], 5000)
    assert [r._s0 for r in cuts.collect()] == ["hot"]
    sizes = R.in_blocks(df, ["k"], [col("ts"), col("id")], cuts).groupBy("k", "_bucket").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")).collect()
    hot = sorted((r._bucket, r.n, r.lo, r.hi) for r in sizes if r.k == "hot")
    assert len(hot) > 40 and max(n for _, n, _, _ in hot) < 2.2 * 5000
    assert all(a[3] <= b[2] for a, b in zip(hot, hot[1:]))
    assert {r._bucket for r in sizes if r.k != "hot"} == {-1}


@pytest.mark.parametrize("block", [40, 100_000])
def test_positions_sums_and_trailing_rows(spark, block):
    rng = random.Random(3)
    data = [(i, rng.choice(["hot"] * 8 + ["cold", None]), rng.randrange(50), rng.random()) for i in range(3000)]
    df = spark.createDataFrame(data, "i long, k string, t int, v double").repartition(5)
    order = [col("t"), col("i")]
    pos = {r.i: r.pos for r in R.numbered(df, ["k"], order, block=block).collect()}
    run = {r.i: r.s for r in R.prefix_sums(df, ["k"], order, None, {"s": col("v")}, block=block).collect()}
    last = {r.i: (r.pos, r.m) for r in R.trailing(df, ["k"], order, 10, {"m": F.avg("v")}, block=block).collect()}
    assert len(pos) == len(run) == len(last) == 3000
    for k in ("hot", "cold", None):
        rows = sorted((t, i, v) for i, kk, t, v in data if kk == k)
        for p, (_, i, _) in enumerate(rows):
            assert pos[i] == p == last[i][0]
            assert run[i] == pytest.approx(sum(r[2] for r in rows[:p + 1]))
            assert last[i][1] == pytest.approx(np.mean([r[2] for r in rows[max(0, p - 9):p + 1]]))


@pytest.mark.parametrize("times", [1, 4, 16])
def test_quantiles_by_selection_fit_their_bound(spark, times, monkeypatch):
    n, fit, seen = 2000 * times, 300, []
    df = spark.range(n).select(F.when(col("id") % 4 == 0, None).otherwise(F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1000).alias("v"),
                               F.when(col("id") % 3 == 0, "a").when(col("id") % 3 == 1, None).otherwise("b").alias("g"))
    keep = R.stored
    monkeypatch.setattr(R, "stored", lambda d, name: seen.append((name, out := keep(d, name))) or out)
    probs = {"q1": 0.25, "m": 0.5, "p95": 0.95}
    got = {r.g: r for r in R.exact_quantiles(df, "v", probs, ["g"], buckets=8, fit=fit).collect()}
    values = [x for name, x in seen if name == "quantile-values"]
    assert values[-1].groupBy("_g", "_b").count().agg(F.max("count")).first()[0] <= fit
    rows = [(r.g, r.v) for r in df.where("v is not null").collect()]
    for g in ("a", "b", None):
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile([v for h, v in rows if h == g], p))
    whole = R.exact_quantiles(df, "v", probs, buckets=4, fit=5).first()
    assert [whole[c] for c in probs] == pytest.approx(list(np.quantile([v for _, v in rows], list(probs.values()))))


def test_quantiles_of_little(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (None,)], "v double")
    assert R.exact_quantiles(df, "v", {"m": 0.5}, buckets=4, fit=2).first().m == 1.0
    assert [r.m for r in R.exact_quantiles(df.where("v is null"), "v", {"m": 0.5}).collect()] == [None]
    assert R.exact_quantiles(df.where("v is null").withColumn("g", F.lit("x")), "v", {"m": 0.5}, ["g"]).collect() == []


def test_last_calls_and_runs_of_a_hot_key(spark):
    rng = random.Random(9)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "hot", t0 + dt.timedelta(seconds=rng.randrange(3600)), rng.random() * 9, rng.random() < 0.3) for i in range(2500)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp, d double, e boolean")
    cols = lambda x: sorted(tuple(r) for r in x.withColumns({c: F.round(c, 9) for c in ("failure_rate", "slow_rate", "mean_duration")}).collect())
    assert cols(W.last_calls(df, "k", "ts", "id", "d", "e", n=7, block=60)) == cols(W.last_calls(df, "k", "ts", "id", "d", "e", n=7))
    runs = lambda block: sorted(tuple(r) for r in O.sustained(df, "k", "ts", "id", col("d") > 1, 0.05, block).collect())
    assert runs(60) == runs(100_000) != []
    grown = lambda block: sorted(tuple(r) for r in O.counter_increase(df, "k", "ts", "id", "d", block=block).withColumn("increase", F.round("increase", 6)).collect())
    assert grown(60) == grown(100_000) != []


def test_cooldown_of_one_rule_in_blocks(spark):
    t0 = 1_700_000_000_000_000
    us = sorted({t0 + F_ * 1_000 for F_ in random.Random(1).sample(range(10**7), 60_000)})
    want, last = [], None
    for t in us:
        if last is None or t >= last + 60_000_000:
            want.append(t)
            last = t
    df = spark.createDataFrame([(t,) for t in us], "us long").select(
        F.when(col("us") % 2 >= 0, None).cast("string").alias("rule"), F.timestamp_micros("us").alias("ts"), F.lit(1).alias("cooldown_minutes"))
    for block in (1000, 10**6):
        got = O.cooldown_emissions(df, block=block).select(F.unix_micros("ts").alias("us")).collect()
        assert sorted(r.us for r in got) == want

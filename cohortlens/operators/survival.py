"""Survival analysis. Records are reduced to counts per time (and covariate pattern) before anything is ordered."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import AFTSurvivalRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.extract import first_integer
from cohortlens.functions.ranking import numbered, prefix_sums
from cohortlens.session import cut_lineage

col, lit = F.col, F.lit
Z95 = 1.959963984540054
COMORBIDITY_WORDS = ("diabetes", "hypertension", "cardiovascular", "obesity", "chronic")


def survival_records(rows: DataFrame, cells: Sequence[str], key: str, duration: str, event: str,
                     outcome: str = "clinical_improvement") -> DataFrame:
    """Duration, event, age, comorbidity count and severity read from the text cells of a study row.

    ``duration`` and ``event`` are input columns; the text can only raise the event to 1.
    """
    arr = F.filter(F.array(*[F.lower(col(c).cast("string")) for c in cells]), lambda x: x.isNotNull())
    ages = [first_integer(col(c).cast("string")) for c in cells if "age" in c.lower()]
    age = F.coalesce(*ages, lit(50)) if ages else lit(50)
    any_word = lambda x: F.rlike(x, lit("|".join(COMORBIDITY_WORDS)))
    per_cell = lambda a, x: a + F.when(F.contains(x, lit("severe")), 2.0).when(F.contains(x, lit("critical")), 3.0).when(
        F.contains(x, lit("mild")), -1.0).otherwise(0.0)
    severity = F.aggregate(arr, lit(3.0), per_cell)
    dead = F.contains(F.lower(F.coalesce(col(outcome), lit(""))), lit("severe")) | F.contains(F.concat_ws(" ", arr), lit("mortality"))
    return rows.where(col(duration) > 0).select(
        key, col(duration).alias("duration"), F.when(dead, 1).otherwise(col(event)).alias("event"),
        F.least(lit(100), F.greatest(lit(0), age)).cast("int").alias("age"),
        F.least(lit(5), F.size(F.filter(arr, any_word))).alias("comorbidities"),
        F.least(lit(10.0), F.greatest(lit(1.0), severity)).alias("severity_score"))


def _bucket(width: float) -> Column:
    return F.floor(col("t") / width)


def km_curve(df: DataFrame, duration: str, event: str, group: str | None = None, bucket_width: float = 30.0) -> DataFrame:
    """Kaplan-Meier estimate per distinct time with log-log Greenwood limits."""
    keys = [group] if group else []
    counts = df.groupBy(*keys, col(duration).cast("double").alias("t")).agg(
        F.count(lit(1)).alias("n"), F.sum(col(event).cast("bigint")).alias("events"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_all"))
    gone = prefix_sums(counts, keys, [col("t")], _bucket(bucket_width), {"_upto": col("n")})
    risk = (gone.join(totals, keys) if keys else gone.join(F.broadcast(totals))).withColumn("at_risk", col("_all") - col("_upto") + col("n"))
    d, n = col("events"), col("at_risk")
    steps = prefix_sums(risk.select(*keys, "t", "at_risk", "events"), keys, [col("t")], _bucket(bucket_width), {
        "_log": F.when(d < n, F.log(1 - d / n)).otherwise(0.0),
        "_gw": F.when(d < n, d / (n * (n - d))).otherwise(0.0),
        "_dead": (d == n).cast("int")})
    s = F.when(col("_dead") > 0, 0.0).otherwise(F.exp("_log"))
    half = lit(Z95) * F.sqrt("_gw") / F.abs(F.log("survival"))
    mid = F.log(-F.log("survival"))
    open_ = (col("survival") > 0) & (col("survival") < 1)
    return steps.withColumn("survival", s).select(
        *keys, "t", "at_risk", "events", "survival",
        F.when(open_, F.exp(-F.exp(mid + half))).otherwise(col("survival")).alias("lower"),
        F.when(open_, F.exp(-F.exp(mid - half))).otherwise(col("survival")).alias("upper"))


def km_summary(df: DataFrame, duration: str, event: str, group: str | None = None, at: Sequence[int] = (7, 14, 30)) -> DataFrame:
    """Median survival (first time with S <= 0.5) and the survival at the given times."""
    curve = km_curve(df, duration, event, group)
    keys = [group] if group else []
    return curve.groupBy(*keys).agg(
        F.min(F.when(col("survival") <= 0.5, col("t"))).alias("median"),
        *[F.coalesce(F.min(F.when(col("t") <= x, col("survival"))), lit(1.0)).alias(f"s_{x}") for x in at])


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution for integer degrees of freedom, by the recurrence on the density."""
    if x <= 0:
        return 1.0
    if df % 2:
        tail, term, k = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2), 1
    else:
        tail, term, k = math.exp(-x / 2), x / 2 * math.exp(-x / 2), 2
    while k < df:
        tail += term
        k += 2
        term *= x / k
    return tail


def risk_table(df: DataFrame, duration: str, event: str, group: str, bucket_width: float = 30.0) -> DataFrame:
    """``t, g, n, d``: at-risk and event counts of every group at every distinct time, one row each."""
    per = df.where(col(group).isNotNull()).groupBy(col(duration).cast("double").alias("t"), col(group).alias("g")).agg(
        F.count(lit(1)).alias("c"), F.sum(col(event).cast("bigint")).alias("d"))
    # As many rows as times and groups make: the counts that the tests below are about.
    grid = per.select("t").distinct().crossJoin(per.select("g").distinct()).join(per, ["t", "g"], "left").select(
        "t", "g", F.coalesce("c", lit(0)).alias("c"), F.coalesce("d", lit(0)).alias("d"))
    up = prefix_sums(grid, ["g"], [col("t")], _bucket(bucket_width), {"u": col("c")})
    return up.join(per.groupBy("g").agg(F.sum("c").alias("a")), "g").select("t", "g", (col("a") - col("u") + col("c")).alias("n"), "d")


def logrank(df: DataFrame, duration: str, event: str, group: str) -> DataFrame:
    """Pairwise and overall log-rank tests for any number of groups. Spark sums observed minus expected and the
    covariances per pair of groups; the driver handles k*k rows of numbers for k groups."""
    risk = cut_lineage(risk_table(df, duration, event, group))
    total = risk.groupBy("t").agg(F.sum("n").alias("all_n"), F.sum("d").alias("all_d")).where(col("all_d") > 0)
    x = risk.join(total, "t").select("t", "all_n", "all_d", col("g").alias("a"), col("n").alias("na"), col("d").alias("da"))
    y = risk.select("t", col("g").alias("b"), col("n").alias("nb"), col("d").alias("db"))
    spread = lambda n, d: F.when(n > 1, d * (n - d) / (n - 1)).otherwise(0.0)
    share = lambda m, n: F.when(n > 0, m / n).otherwise(0.0)
    n, d = col("na") + col("nb"), col("da") + col("db")
    pa, all_a, all_b = share(col("na"), n), share(col("na"), col("all_n")), share(col("nb"), col("all_n"))
    same = F.when(col("a") == col("b"), 1.0).otherwise(0.0)
    rows = x.join(y, "t").groupBy("a", "b").agg(
        F.sum(col("da") - d * pa).alias("o"), F.sum(spread(n, d) * pa * (1 - pa)).alias("v"),
        F.sum(col("da") - col("all_d") * all_a).alias("all_o"), F.sum(spread(col("all_n"), col("all_d")) * all_a * (same - all_b)).alias("all_v")).collect()
    at = {(r["a"], r["b"]): r for r in rows}
    groups = sorted({r["a"] for r in rows})
    out = []
    for i, a in enumerate(groups):
        for b in groups[i + 1:]:
            o, v = at[a, b]["o"], at[a, b]["v"]
            out.append((f"{a}_vs_{b}", o * o / v if v > 0 else 0.0, 1))
    if len(groups) > 2:
        use = groups[:-1]
        z = np.array([at[a, a]["all_o"] for a in use])
        v = np.array([[at[a, b]["all_v"] for b in use] for a in use])
        out.append(("multivariate", float(z @ np.linalg.pinv(v) @ z), len(use)))
    tests = [(name, stat, p, p < 0.05) for name, stat, k in out for p in [chi2_tail(stat, k)]]
    return df.sparkSession.createDataFrame(tests, "test string, statistic double, p_value double, significant boolean")


def _patterns(df: DataFrame, duration: str, event: str, covariates: Sequence[str]) -> DataFrame:
    """Counts per (time, covariate pattern): the Newton steps and the concordance read these, not the records."""
    return df.groupBy(col(duration).cast("double").alias("t"), *[col(c).cast("double").alias(c) for c in covariates]).agg(
        F.count(lit(1)).alias("n"), F.sum(col(event).cast("bigint")).alias("d"))


def cox_fit(df: DataFrame, duration: str, event: str, covariates: Sequence[str], max_iter: int = 25, tol: float = 1e-9,
            bucket_width: float = 30.0) -> DataFrame:
    """Cox regression with Breslow ties: coefficient, hazard ratio, limits, p, and the model's concordance on each row.

    Each Newton step sums risk-weighted moments per time, turns them into risk sets by a running sum from the
    latest time, and returns one row (gradient and Hessian).
    """
    covs = list(covariates)
    k = len(covs)
    data = cut_lineage(_patterns(df, duration, event, covs))
    means = data.agg(*[(F.sum(col(c) * col("n")) / F.sum("n")).alias(c) for c in covs]).first()
    x = [col(c) - float(means[c]) for c in covs]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    beta = np.zeros(k)
    loglik = None
    for _ in range(max_iter):
        eta = sum((x[i] * float(beta[i]) for i in range(1, k)), x[0] * float(beta[0]))
        w = col("n") * F.exp(eta)
        per = data.groupBy("t").agg(
            F.sum("d").alias("d"), F.sum(col("d") * eta).alias("de"), *[F.sum(col("d") * x[i]).alias(f"dx{i}") for i in range(k)],
            F.sum(w).alias("w"), *[F.sum(w * x[i]).alias(f"w{i}") for i in range(k)],
            *[F.sum(w * x[i] * x[j]).alias(f"w{i}_{j}") for i, j in pairs])
        names = ["w", *[f"w{i}" for i in range(k)], *[f"w{i}_{j}" for i, j in pairs]]
        back = prefix_sums(per, [], [-col("t")], F.floor(-col("t") / bucket_width), {f"r_{m}": col(m) for m in names})
        m = lambda i: col(f"r_w{i}") / col("r_w")
        row = back.where(col("d") > 0).agg(
            F.sum(col("de") - col("d") * F.log("r_w")).alias("ll"),
            *[F.sum(col(f"dx{i}") - col("d") * m(i)).alias(f"g{i}") for i in range(k)],
            *[F.sum(col("d") * (col(f"r_w{i}_{j}") / col("r_w") - m(i) * m(j))).alias(f"h{i}_{j}") for i, j in pairs]).first()
        g = np.array([row[f"g{i}"] for i in range(k)])
        h = np.zeros((k, k))
        for i, j in pairs:
            h[i, j] = h[j, i] = row[f"h{i}_{j}"]
        step = np.linalg.solve(h, g)
        done = loglik is not None and abs(row["ll"] - loglik) < tol * (abs(loglik) + 1) and np.max(np.abs(step)) < 1e-7
        loglik = row["ll"]
        if done:
            break
        beta = beta + step
    else:
        raise RuntimeError(f"no convergence in {max_iter} steps")
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    eta = sum((col(covs[i]) * float(beta[i]) for i in range(1, k)), col(covs[0]) * float(beta[0]))
    c_index = concordance(data.withColumn("risk", F.round(eta, 10)), "risk").first()[0]
    out = []
    for i, c in enumerate(covs):
        b, s = float(beta[i]), float(se[i])
        p = math.erfc(abs(b / s) / math.sqrt(2))
        out.append((c, b, math.exp(b), math.exp(b - Z95 * s), math.exp(b + Z95 * s), s, p, p < 0.05, float(loglik), float(c_index)))
    return df.sparkSession.createDataFrame(out, (
        "covariate string, coefficient double, hazard_ratio double, lower double, upper double, std_error double, p_value double, "
        "significant boolean, log_likelihood double, concordance double"))


def concordance(data: DataFrame, risk: str, bucket_width: float = 30.0) -> DataFrame:
    """Concordance index of ``t, n, d, risk`` counts: among comparable pairs the share where the earlier event has the
    higher risk, equal risks counting half.

    Pairs are counted, not formed. Risks become ranks, and the records with a smaller rank are the disjoint union of
    one block per set bit of the rank, so each record joins about log2(ranks) running sums over time.
    """
    d = data.groupBy("t", risk).agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    lv = d.select(risk).distinct()
    span = lv.agg(F.min(risk).alias("lo"), F.max(risk).alias("hi"), F.count(lit(1)).alias("m")).first()
    width = max((span["hi"] - span["lo"]) / 256, 1e-12)
    ranks = numbered(lv, [], [col(risk)], F.floor((col(risk) - span["lo"]) / width), "rk")
    rows = cut_lineage(d.join(ranks, risk).select("t", "rk", "n", "d"))
    bits = max(1, int(span["m"]).bit_length())
    # Level ``bits`` stands for equal ranks; a level below it for the blocks of ranks that differ from a set bit on.
    part = rows.withColumn("b", F.explode(F.sequence(lit(0), lit(bits))))
    equal, block = col("b") == bits, F.expr("shiftright(rk, b)")
    none = lit(0).cast("bigint")
    have = part.select("b", F.when(equal, col("rk")).otherwise(block).alias("k"), "t", col("n").alias("w"),
                       (col("n") - col("d")).alias("cens"), none.alias("q"))
    ask = part.where((col("d") > 0) & (equal | (block % 2 == 1))).select(
        "b", F.when(equal, col("rk")).otherwise(block - 1).alias("k"), "t", none.alias("w"), none.alias("cens"), col("d").alias("q"))
    both = have.unionByName(ask).groupBy("b", "k", "t").agg(F.sum("w").alias("w"), F.sum("cens").alias("cens"), F.sum("q").alias("q"))
    # Partners outlive the event: later times, and records censored at the same time.
    run = prefix_sums(both, ["b", "k"], [-col("t")], F.floor(-col("t") / bucket_width), {"later": col("w")})
    pairs = col("q") * (col("later") - col("w") + col("cens"))
    won = run.agg(F.sum(F.when(col("b") < bits, pairs).otherwise(0)).alias("lower"), F.sum(F.when(col("b") == bits, pairs).otherwise(0)).alias("equal"))
    base = d.groupBy("t").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    total = prefix_sums(base, [], [-col("t")], F.floor(-col("t") / bucket_width), {"later": col("n")}).agg(
        F.sum(col("d") * (col("later") - col("d"))).alias("all_pairs"))
    return won.join(F.broadcast(total)).select(((col("lower") + col("equal") * 0.5) / col("all_pairs")).alias("concordance"))


def weibull_aft(df: DataFrame, duration: str, event: str, covariates: Sequence[str]) -> DataFrame:
    """Weibull accelerated failure time model: coefficients, scale, log-likelihood and AIC."""
    covs = list(covariates)
    d = VectorAssembler(inputCols=covs, outputCol="features").transform(
        df.select(col(duration).cast("double").alias("label"), col(event).cast("double").alias("censor"), *[col(c).cast("double").alias(c) for c in covs]))
    model = AFTSurvivalRegression(censorCol="censor", labelCol="label", featuresCol="features").fit(d)
    b0, sigma = float(model.intercept), float(model.scale)
    coef = [float(v) for v in model.coefficients]
    mu = sum((col(c) * v for c, v in zip(covs, coef)), lit(b0))
    z = (F.log("label") - mu) / sigma
    ll = d.agg(F.sum(col("censor") * (z - math.log(sigma) - F.log("label")) - F.exp(z)).alias("ll")).first()["ll"]
    aic = 2 * (len(covs) + 2) - 2 * ll
    rows = [("intercept", b0), ("scale", sigma), *zip(covs, coef)]
    return df.sparkSession.createDataFrame(
        [(n, v, float(ll), float(aic)) for n, v in rows], "term string, value double, log_likelihood double, aic double")

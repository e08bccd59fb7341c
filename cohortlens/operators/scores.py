"""Six-dimension table quality scores. Each dimension contributes counters to one aggregate over the table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.ranking import exact_quantiles

col, lit = F.col, F.lit

# Formats, weights, grades and limits of the scores.
PHONE_START = r"^(?:^\d{3}-\d{3}-\d{4}|\(\d{3}\)\s\d{3}-\d{4}|\d{10}$)"
NAME_FORMAT = r"^[A-Za-z\s\.\,\-\']+$"
EMAIL_FORMAT = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
NPI_FORMAT = r"^\d{10}$"
STATE_FORMAT = r"^[A-Z]{2}$"
PHONE_FORMAT = r"^(\d{3}-\d{3}-\d{4}|\(\d{3}\) ?\d{3}-\d{4}|\d{10})$"
DEFAULT_KEYS = ("provider_id", "npi_number", "email")
WEIGHTS = {"completeness": 0.25, "consistency": 0.20, "accuracy": 0.25, "timeliness": 0.10, "uniqueness": 0.15,
           "validity": 0.05}
GRADES = (("A", 95.0), ("B", 85.0), ("C", 75.0), ("D", 65.0))
GOOD = 85.0
# Dimension, limit, priority, recommendation, action.
ADVICE = (
    ("completeness", 90.0, "HIGH", "Focus on data collection processes to reduce missing values",
     "Implement required field validation and data entry training"),
    ("consistency", 85.0, "MEDIUM", "Standardize data formats and validation rules",
     "Implement data transformation and normalization procedures"),
    ("accuracy", 90.0, "HIGH", "Strengthen data validation and verification processes",
     "Implement real-time validation rules and periodic data audits"),
    ("timeliness", 80.0, "MEDIUM", "Improve data refresh frequency and update processes",
     "Implement automated data refresh schedules and monitoring"),
    ("uniqueness", 95.0, "HIGH", "Address duplicate records and improve deduplication",
     "Implement advanced matching algorithms and duplicate resolution workflows"),
    ("validity", 85.0, "MEDIUM", "Enhance business rule validation and cross-field checks",
     "Review and update business rules, implement cross-validation logic"),
)
# Limits of the threshold checks.
THRESHOLDS = {"completeness": 95.0, "consistency": 90.0, "accuracy": 95.0, "timeliness_days": 30.0, "uniqueness": 99.0}


class Dimension:
    """Counters to aggregate, and the score computed from them."""

    def __init__(self, counters: dict[str, Column], score: Column):
        self.counters, self.score = counters, score


def _n() -> Column:
    return col("_rows")


def _guard_empty(score: Column, empty: float) -> Column:
    return F.bround(F.when(_n() == 0, lit(empty)).otherwise(score), 2)


def _chain(steps: list[tuple[str, Column, Column]], prefix: str) -> tuple[dict[str, Column], Column]:
    """Start at all rows; each step keeps ``int(n * ok / seen)`` rows. A step that saw nothing is skipped."""
    counters: dict[str, Column] = {}
    n = _n().cast("double")
    for i, (_, ok, seen) in enumerate(steps):
        o, s = f"_{prefix}{i}_ok", f"_{prefix}{i}_seen"
        counters[o], counters[s] = F.count_if(ok & seen), F.count_if(seen)
        n = F.when(col(s) > 0, F.floor(n * (col(o) / col(s))).cast("double")).otherwise(n)
    return counters, n


def _completeness(df: DataFrame, cols: Sequence[str] | None) -> Dimension:
    wanted = list(cols or df.columns)
    filled = [F.count_if(F.rlike(col(c).cast("string"), lit(r"\S"))) for c in wanted if c in df.columns]
    total = sum(filled[1:], filled[0]) if filled else F.count_if(lit(False))
    return Dimension({"_filled": total}, _guard_empty(col("_filled") / (_n() * len(wanted)) * 100, 0.0))


def _consistency(df: DataFrame, rules: Mapping[str, Any]) -> Dimension:
    steps: list[tuple[str, Column, Column]] = []
    has = set(df.columns)
    if "phone_format" in rules and "phone_number" in has:
        c = col("phone_number")
        steps.append(("phone", F.rlike(c, lit(PHONE_START)), c.isNotNull()))
    if "name_format" in rules and "full_name" in has:
        c = col("full_name")
        steps.append(("name", F.rlike(c, lit(NAME_FORMAT)), c.isNotNull()))
    tail: list[tuple[str, Column, Column]] = []
    for name, allowed in (rules.get("categorical_consistency") or {}).items():
        if name in has:
            tail.append((name, col(name).isin(list(allowed)), col(name).isNotNull()))
    counters, n = _chain(steps, "cons")
    if "date_format" in rules:
        # Typed date columns always parse; a text column with any unreadable value costs a tenth of the rows.
        for f in df.schema.fields:
            if "date" in f.name.lower() and isinstance(f.dataType, T.StringType):
                bad = f"_cons_bad_{f.name}"
                counters[bad] = F.count_if(col(f.name).isNotNull() & col(f.name).try_cast("timestamp").isNull())
                n = F.when(col(bad) > 0, F.floor(n * 0.9).cast("double")).otherwise(n)
    for i, (_, ok, seen) in enumerate(tail):
        o, s = f"_cat{i}_ok", f"_cat{i}_seen"
        counters[o], counters[s] = F.count_if(ok & seen), F.count_if(seen)
        n = F.when(col(s) > 0, F.floor(n * (col(o) / col(s))).cast("double")).otherwise(n)
    return Dimension(counters, _guard_empty(n / _n() * 100, 100.0))


def _accuracy(df: DataFrame, asof: dt.date) -> Dimension:
    checks = {
        "email": lambda c: F.rlike(c, lit(EMAIL_FORMAT)),
        "npi_number": lambda c: F.rlike(c, lit(NPI_FORMAT)),
        "birth_year": lambda c: (c >= 1920) & (c <= asof.year - 18),
        "license_state": lambda c: F.rlike(c, lit(STATE_FORMAT)),
    }
    steps = [(k, f(col(k)), col(k).isNotNull()) for k, f in checks.items() if k in df.columns]
    counters, n = _chain(steps, "acc")
    return Dimension(counters, _guard_empty(n / _n() * 100, 100.0))


def _age_score(age: Column, limit: int) -> Column:
    return F.when(age <= limit, 100.0 - age / limit * 20).otherwise(
        F.greatest(lit(0.0), 100.0 - age / limit * 50))


def _age_days(name: str, asof: dt.date) -> Column:
    now = F.unix_timestamp(lit(dt.datetime.combine(asof, dt.time())))
    return F.floor((now - F.unix_timestamp(col(name).cast("timestamp"))) / 86400)


def _timeliness(df: DataFrame, name: str, limit: int, asof: dt.date) -> Dimension:
    if name not in df.columns:
        return Dimension({}, lit(100.0))
    score = F.when(_n() == 0, lit(100.0)).when(col("_age").isNull(), lit(50.0)).otherwise(_age_score(col("_age"), limit))
    return Dimension({"_age": F.avg(_age_days(name, asof))}, F.bround(score, 2))


def _uniqueness(df: DataFrame, keys: Sequence[str] | None) -> Dimension:
    present = [k for k in (keys or DEFAULT_KEYS) if k in df.columns]
    counters: dict[str, Column] = {}
    ratios, used = lit(0.0), lit(0)
    for i, k in enumerate(present):
        d, s = f"_u{i}_distinct", f"_u{i}_seen"
        counters[d], counters[s] = F.count_distinct(col(k)), F.count(col(k))
        ratios = ratios + F.when(col(s) > 0, col(d) / col(s) * 100).otherwise(0.0)
        used = used + (col(s) > 0).cast("int")
    if not present:
        # A whole-row hash stands in for the row; a map column would not be comparable anyway.
        whole = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
        counters["_distinct_rows"] = F.count_distinct(whole)
        return Dimension(counters, _guard_empty(col("_distinct_rows") / _n() * 100, 100.0))
    return Dimension(counters, _guard_empty(F.when(used > 0, ratios / used), 100.0))


def _validity(df: DataFrame, rules: Mapping[str, Any]) -> Dimension:
    has = set(df.columns)
    steps: list[tuple[str, Column, Column]] = []
    for combo in rules.get("required_combinations") or ():
        if all(c in has for c in combo):
            ok = lit(True)
            for c in combo:
                ok = ok & col(c).isNotNull()
            steps.append(("combo", ok, lit(True)))
    for name, (lo, hi) in (rules.get("value_ranges") or {}).items():
        if name in has:
            steps.append((name, (col(name) >= lo) & (col(name) <= hi), col(name).isNotNull()))
    if "cross_field_rules" in rules and {"birth_year", "graduation_year"} <= has:
        gap = col("graduation_year") - col("birth_year")
        steps.append(("graduation", gap >= 22, gap.isNotNull()))
    counters, n = _chain(steps, "val")
    return Dimension(counters, _guard_empty(n / _n() * 100, 100.0))


def _score_row(df: DataFrame, dims: Mapping[str, Dimension]) -> DataFrame:
    aggs = [F.count(lit(1)).alias("_rows")]
    for d in dims.values():
        aggs += [c.alias(n) for n, c in d.counters.items()]
    # Distinct values are first counted where the rows lie: dealt out by their content, no task holds those of a whole split.
    return df.repartition(F.xxhash64(*[c for c in df.columns if df.schema[c].dataType.typeName() != "map"] or [lit(0)])).agg(*aggs).select(*[d.score.alias(n) for n, d in dims.items()])


def completeness(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return _score_row(df, {"completeness": _completeness(df, cols)})


def consistency(df: DataFrame, rules: Mapping[str, Any] | None = None) -> DataFrame:
    return _score_row(df, {"consistency": _consistency(df, rules or {})})


def accuracy(df: DataFrame, asof: dt.date) -> DataFrame:
    return _score_row(df, {"accuracy": _accuracy(df, asof)})


def timeliness(df: DataFrame, column: str = "last_updated", max_age_days: int = 90, asof: dt.date | None = None) -> DataFrame:
    return _score_row(df, {"timeliness": _timeliness(df, column, max_age_days, asof or dt.date.today())})


def uniqueness(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    return _score_row(df, {"uniqueness": _uniqueness(df, keys)})


def validity(df: DataFrame, rules: Mapping[str, Any] | None = None) -> DataFrame:
    return _score_row(df, {"validity": _validity(df, rules or {})})


def grade(score: Column) -> Column:
    out = None
    for g, limit in GRADES:
        out = F.when(score >= limit, g) if out is None else out.when(score >= limit, g)
    return out.otherwise("F")


def quality_metrics(df: DataFrame, asof: dt.date, required_columns: Sequence[str] | None = None,
                    consistency_rules: Mapping[str, Any] | None = None, timeliness_column: str = "last_updated",
                    max_age_days: int = 90, key_columns: Sequence[str] | None = None,
                    validity_rules: Mapping[str, Any] | None = None,
                    weights: Mapping[str, float] | None = None) -> DataFrame:
    """All six scores, the weighted overall score and the grade, from one pass over the table."""
    w = dict(weights or WEIGHTS)
    row = _score_row(df, {
        "completeness": _completeness(df, required_columns),
        "consistency": _consistency(df, consistency_rules or {}),
        "accuracy": _accuracy(df, asof),
        "timeliness": _timeliness(df, timeliness_column, max_age_days, asof),
        "uniqueness": _uniqueness(df, key_columns),
        "validity": _validity(df, validity_rules or {}),
    })
    overall = lit(0.0)
    for name in WEIGHTS:
        overall = overall + col(name) * w[name]
    return row.withColumn("overall_score", F.bround(overall, 2)).withColumn("grade", grade(col("overall_score")))


def quality_report(metrics: DataFrame) -> DataFrame:
    """One row per dimension with its score, limit, and advice where the score is under the limit."""
    rows = metrics.unpivot(["overall_score", "grade"], list(WEIGHTS), "dimension", "score")
    advice = metrics.sparkSession.createDataFrame(
        list(ADVICE), "dimension string, advice_limit double, priority string, recommendation string, action string")
    under = col("score") < col("advice_limit")
    return rows.join(F.broadcast(advice), "dimension").select(
        "dimension", "score", "overall_score", "grade", (col("overall_score") >= GOOD).alias("meets_threshold"),
        under.alias("needs_action"),
        *[F.when(under, col(c)).alias(c) for c in ("priority", "recommendation", "action")])


def kpi_scores(df: DataFrame) -> DataFrame:
    """Completeness, name consistency and NPI accuracy with their bands, from one aggregate."""
    norm = F.upper(F.trim("full_name"))
    row = df.agg(
        (F.avg(col("full_name").isNotNull().cast("int")) * 100).alias("COMPLETENESS"),
        ((1 - F.count_distinct(norm) / F.count(norm)) * 100).alias("CONSISTENCY"),
        (F.avg(F.rlike("npi_number", lit(r"^[0-9]{10}\z")).cast("int")) * 100).alias("ACCURACY"),
    )
    s = col("score")
    band = F.when(s >= 95, "EXCELLENT").when(s >= 85, "GOOD").when(s >= 70, "FAIR").otherwise("POOR")
    long = row.unpivot([], ["COMPLETENESS", "CONSISTENCY", "ACCURACY"], "dimension", "score")
    return long.select("dimension", F.round(s, 2).alias("score_percentage"), band.alias("quality_grade"))


def check_thresholds(df: DataFrame, asof: dt.date, column: str = "last_updated",
                     limits: Mapping[str, float] | None = None, **kwargs: Any) -> DataFrame:
    """Score per dimension against the agreed minimum (timeliness: mean age in days against a maximum)."""
    lim = dict(limits or THRESHOLDS)
    dims = {
        "completeness": _completeness(df, kwargs.get("required_columns")),
        "consistency": _consistency(df, kwargs.get("consistency_rules") or {}),
        "accuracy": _accuracy(df, asof),
        "timeliness_days": Dimension({"_age": F.avg(_age_days(column, asof))}, F.bround("_age", 2)),
        "uniqueness": _uniqueness(df, kwargs.get("key_columns")),
    }
    long = _score_row(df, dims).unpivot([], list(dims), "dimension", "score")
    limit = F.element_at(F.create_map(*[x for k, v in lim.items() for x in (lit(k), lit(v))]), col("dimension"))
    passes = F.when(col("dimension") == "timeliness_days", col("score") <= limit).otherwise(col("score") >= limit)
    return long.select("dimension", "score", limit.alias("limit_value"), passes.alias("meets_sla"))


def valid_email(c: Column) -> Column:
    return F.coalesce(F.rlike(c, lit(EMAIL_FORMAT)), lit(False))


def valid_phone(c: Column) -> Column:
    return F.coalesce(F.rlike(c, lit(PHONE_FORMAT)), lit(False))


def outlier_flag(df: DataFrame, value: str, factor: float = 1.5, out: str = "is_outlier") -> DataFrame:
    """Rows outside ``[q1 - f*iqr, q3 + f*iqr]`` are flagged. The quartiles are one row, so the keyless join is free."""
    q = exact_quantiles(df, value, {"_q1": 0.25, "_q3": 0.75})
    reach = (col("_q3") - col("_q1")) * factor
    flag = (col(value) < col("_q1") - reach) | (col(value) > col("_q3") + reach)
    return df.join(F.broadcast(q)).withColumn(out, F.coalesce(flag, lit(False))).drop("_q1", "_q3")


def freshness(df: DataFrame, columns: Sequence[str], asof: dt.date, max_age_days: int = 90) -> DataFrame:
    """Mean of the timeliness scores of several date columns."""
    row = df.agg(*[F.avg(_age_days(c, asof)).alias(f"_a{i}") for i, c in enumerate(columns)])
    total = lit(0.0)
    for i in range(len(columns)):
        a = col(f"_a{i}")
        total = total + F.when(a.isNull(), 50.0).otherwise(_age_score(a, max_age_days))
    return row.select(F.bround(total / len(columns), 2).alias("freshness"))


def quality_trend(metrics: DataFrame) -> DataFrame:
    """Score of each measurement of a table beside the one before it. One row per table and day, so windows stay small."""
    w = Window.partitionBy("table_name").orderBy("measurement_date")
    prev = F.lag("overall_score").over(w)
    change = col("overall_score") - prev
    return metrics.select(
        "table_name", "measurement_date", "overall_score", prev.alias("previous_score"),
        F.round(change, 2).alias("change"),
        F.when(change.isNull(), "FIRST").when(change > 0, "UP").when(change < 0, "DOWN").otherwise("FLAT").alias("trend"))

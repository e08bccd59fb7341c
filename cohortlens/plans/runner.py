"""Running rules into one violations table, with settings, summaries and reuse of saved results."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.rules import RULES
from cohortlens.plans import fused
from cohortlens.session import stored

col, lit = F.col, F.lit
Tables = Mapping[str, DataFrame]
Rule = Callable[..., DataFrame]

LONG_COLUMNS = fused.LONG_COLUMNS
# Rule settings (enabled, severity, confidence threshold). Rules not named are enabled and MEDIUM.
SETTINGS = (
    ("provider_name_inconsistency", True, "HIGH", 75.0),
    ("npi_validation", True, "CRITICAL", None),
    ("affiliation_anomaly", True, "MEDIUM", None),
    ("temporal_consistency", True, "HIGH", None),
    ("cross_reference_integrity", True, "CRITICAL", None),
)
# Minutes a saved result stays valid, by rule; results above MAX_SAVED_ROWS are not saved.
TIME_TO_LIVE = {"validation_summary": 5, "provider_name_inconsistency": 60, "npi_validation": 120, "affiliation_anomaly": 30,
                "temporal_consistency": 240, "cross_reference_integrity": 60, "contact_validation": 15}
MAX_SAVED_ROWS = 50_000


def settings_table(spark: SparkSession, rows: Sequence[tuple] = SETTINGS) -> DataFrame:
    return spark.createDataFrame(list(rows), "rule_name string, enabled boolean, rule_severity string, confidence_threshold double")


def to_long(df: DataFrame) -> DataFrame:
    """A rule's rows in the common schema; columns outside of it go to ``details`` as JSON."""
    has = set(df.columns)
    pick = lambda n: col(n).cast("string") if n in has else lit(None).cast("string")
    rest = [c for c in df.columns if c not in LONG_COLUMNS]
    entity = F.coalesce(pick("entity_id"), pick("provider_id"), pick("facility_id"))
    provider = pick("provider_id")
    facility = pick("facility_id")
    if "entity_type" in has:
        kind = col("entity_type")
        provider = F.when(kind.isin("affiliation_missing_provider", "provider_no_affiliations"), pick("entity_id"))
        facility = F.when(kind.isin("affiliation_missing_facility", "facility_no_providers"), pick("entity_id"))
    return df.select(
        "rule_name", entity.alias("entity_id"), provider.alias("provider_id"), facility.alias("facility_id"), "issue_description",
        "severity", (F.to_json(F.struct(*rest)) if rest else lit(None).cast("string")).alias("details"))


def error_row(spark: SparkSession, rule: str, message: str) -> DataFrame:
    return spark.createDataFrame(
        [(rule, None, None, None, message, "ERROR", None)],
        "rule_name string, entity_id string, provider_id string, facility_id string, issue_description string, severity string, details string")


def run_rules(tables: Tables, asof: dt.date, variant: str = "standard", only: Sequence[str] | None = None,
              rules: Mapping[str, Rule] = RULES, disabled: Sequence[str] = (), limits: bool = True) -> DataFrame:
    """One lazy table with the violations of all (or the named) rules, in no order.

    ``limits=False`` lifts the row limits of the rules. A disabled rule gives no rows. A rule that cannot be planned gives one ERROR row and the others go on.
    Several standard rules that look at the same rows are planned as one pass over them (``fused``).
    """
    spark = next(iter(tables.values())).sparkSession
    wanted = {n: r for n, r in rules.items() if n not in disabled and (only is None or n in only)}
    out, done = (fused.passes(tables, asof, {n for n, r in wanted.items() if r is RULES.get(n)}, limits) if variant == "standard" else (None, set()))
    for name, rule in wanted.items():
        if name in done:
            continue
        try:
            part = to_long(rule(tables, variant=variant, asof=asof, ordered=False, **({} if limits else {"limit": None})))
        except (AnalysisException, KeyError) as e:  # the failing rule is reported as a row
            part = error_row(spark, name, f"{type(e).__name__}: {e}")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else error_row(spark, "none", "").limit(0)


def run_rules_to(tables: Tables, path: str, asof: dt.date, variant: str = "standard", rules: Mapping[str, Rule] = RULES) -> DataFrame:
    """Write each rule's violations to its own folder; a rule that fails while running is replaced by an ERROR row."""
    spark = next(iter(tables.values())).sparkSession
    for name in rules:
        target = f"{path}/rule={name}"
        try:
            run_rules(tables, asof, variant, [name], rules).write.mode("overwrite").parquet(target)
        except PySparkException as e:
            error_row(spark, name, f"{type(e).__name__}: {e}").write.mode("overwrite").parquet(target)
    return spark.read.parquet(path).drop("rule")


RUN = "rule_name string, success boolean, violation_count long, execution_time double"


def run_rules_timed(tables: Tables, path: str, asof: dt.date, variant: str = "standard", rules: Mapping[str, Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """Run rule by rule and write each result. Returns the violations read back, without the rows that report a failed rule,
    and one row per rule: whether it went through, its rows, and the seconds from planning to the end of writing."""
    spark = next(iter(tables.values())).sparkSession
    runs = []
    for name in rules:
        target = f"{path}/rule={name}"
        start = time.monotonic()
        try:
            run_rules(tables, asof, variant, [name], rules).write.mode("overwrite").parquet(target)
        except PySparkException as e:
            error_row(spark, name, f"{type(e).__name__}: {e}").write.mode("overwrite").parquet(target)
        took = time.monotonic() - start
        n, errors = spark.read.parquet(target).agg(F.count(lit(1)), F.count_if(col("severity") == "ERROR")).first()
        runs.append((name, errors == 0, n - errors, took))
    schema = ", ".join(f"{c} string" for c in LONG_COLUMNS)
    found = spark.read.schema(schema).parquet(*[f"{path}/rule={n}" for n in rules])
    return found.where(F.coalesce(col("severity") != "ERROR", lit(True))), spark.createDataFrame(runs, RUN)


def apply_settings(violations: DataFrame, settings: DataFrame) -> DataFrame:
    """Keep enabled rules and add the rule severity (default MEDIUM). Settings hold one row per rule."""
    return violations.join(settings, "rule_name", "left").where(F.coalesce("enabled", lit(True))).withColumn(
        "rule_severity", F.coalesce("rule_severity", lit("MEDIUM"))).drop("enabled")


def rule_summary(violations: DataFrame) -> DataFrame:
    """Per rule: totals, severity distribution, distinct ids, and the first five violations as samples. The violations are
    written once and read from there, so the rules behind them run once."""
    violations = stored(violations.drop("details"), "violations")
    # Counted per id first: one hot rule then reduces on many keys.
    per_id = violations.groupBy("rule_name", "entity_id", "provider_id", "facility_id", "severity").agg(F.count(lit(1)).alias("n"))
    sev = lambda s: F.sum(F.when(col("severity") == s, col("n")).otherwise(0)).alias(s.lower())
    base = per_id.groupBy("rule_name").agg(
        F.sum("n").alias("total_violations"), *[sev(s) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "ERROR")],
        F.count_distinct("entity_id").alias("distinct_entities"), F.count_distinct("provider_id").alias("distinct_providers"),
        F.count_distinct("facility_id").alias("distinct_facilities"))
    from pyspark.sql import Window

    w = Window.partitionBy("rule_name").orderBy("entity_id", "issue_description")
    top = violations.withColumn("_r", F.row_number().over(w)).where(col("_r") <= 5)
    samples = top.groupBy("rule_name").agg(F.concat_ws(", ", F.array_sort(F.collect_list("entity_id"))).alias("samples"))
    return base.join(samples, "rule_name", "left")


def run_summary(violations: DataFrame) -> DataFrame:
    """Totals by severity over all rules, with the number of rules concerned."""
    per = violations.groupBy("severity", "rule_name").agg(F.count(lit(1)).alias("n"))
    return per.groupBy("severity").agg(F.sum("n").alias("violations"), F.count(lit(1)).alias("rules"))


def critical_count(violations: DataFrame) -> DataFrame:
    return violations.agg(F.count_if(col("severity") == "CRITICAL").alias("critical"), F.count(lit(1)).alias("total"))


def newest_valid(saved: DataFrame, now: dt.datetime, max_rows: int = MAX_SAVED_ROWS) -> DataFrame:
    """Newest unexpired saved result per fingerprint; a combined ``max_by``, so nothing is sorted."""
    ok = saved.where((col("expires_at") > lit(now)) & (col("row_count") <= max_rows))
    rest = [c for c in saved.columns if c not in ("fingerprint", "saved_at")]
    picked = ok.groupBy("fingerprint").agg(F.max("saved_at").alias("saved_at"), F.max_by(F.struct(*rest), F.struct("saved_at", *rest)).alias("s"))
    return picked.select("fingerprint", "saved_at", "s.*")


def hit_statistics(lookups: DataFrame) -> DataFrame:
    """Hit rate over a lookup log with a boolean ``cache_hit``."""
    return lookups.agg(
        F.count(lit(1)).alias("lookups"), F.count_if("cache_hit").alias("hits"), F.count_if(~col("cache_hit")).alias("misses"),
        (F.avg(col("cache_hit").cast("int")) * 100).alias("hit_rate"))

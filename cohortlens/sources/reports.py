"""Exports of violations and research reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import research as R

col, lit = F.col, F.lit


def export_rows(violations: DataFrame, summary: DataFrame, check_time: dt.datetime) -> DataFrame:
    """Flat export: every violation with its own severity and the severity and execution time of its rule."""
    s = summary.select("rule_name", col("rule_severity"), col("execution_time"))
    return violations.join(s, "rule_name", "left").withColumnRenamed("rule_name", "validation_rule").withColumn(
        "check_timestamp", lit(check_time))


def export_documents(violations: DataFrame, runs: DataFrame, settings: DataFrame, check_time: dt.datetime, part_rows: int = 10_000) -> DataFrame:
    """One document per rule: its settings, how its run went, and its violations nested as ``violations``.

    ``runs`` holds ``rule_name, success, violation_count, execution_time``; every rule of it gets a document, with an empty
    list if it found nothing. A rule with more than ``part_rows`` violations is dealt by hash to several documents
    (``part`` of ``parts``, about ``part_rows`` each), all with the rule's full count, so no value holds a whole large rule.
    """
    parts = F.greatest(F.ceil(col("violation_count") / part_rows), lit(1)).cast("int")
    heads = runs.join(settings, "rule_name", "left").select(
        "rule_name", F.coalesce("rule_severity", lit("MEDIUM")).alias("severity"), F.coalesce("enabled", lit(True)).alias("enabled"), "success",
        "violation_count", "execution_time", lit(check_time).alias("execution_timestamp"), parts.alias("parts"))
    cells = [c for c in violations.columns if c != "rule_name"]
    dealt = violations.join(heads.select("rule_name", "parts"), "rule_name").select(
        "rule_name", F.pmod(F.xxhash64(*cells), col("parts")).cast("int").alias("part"), F.struct(*cells).alias("v"))
    nested = dealt.groupBy("rule_name", "part").agg(F.collect_list("v").alias("violations"))
    slots = heads.withColumn("part", F.explode(F.sequence(lit(0), col("parts") - 1)))
    empty = F.array().cast(nested.schema["violations"].dataType)
    return slots.join(nested, ["rule_name", "part"], "left").withColumn("violations", F.coalesce("violations", empty))


def export_violations(violations: DataFrame, path: str, fmt: str = "csv") -> None:
    """Rows of :func:`export_rows` as CSV or Parquet, documents of :func:`export_documents` as JSON lines."""
    if fmt == "csv":
        violations.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
    elif fmt == "json":
        violations.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    elif fmt == "parquet":
        violations.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def research_report(rows: DataFrame) -> DataFrame:
    """``section, document`` rows of the research report: category summaries and key findings as JSON."""
    cats = R.category_summary(rows)
    finds = R.key_findings(rows)
    as_json = lambda d, n: d.select(lit(n).alias("section"), F.to_json(F.struct(*d.columns)).alias("document"))
    return as_json(cats, "category_summary").unionByName(as_json(finds, "key_finding"))


def export_report(rows: DataFrame, path: str) -> None:
    research_report(rows).write.mode("overwrite").partitionBy("section").json(path)

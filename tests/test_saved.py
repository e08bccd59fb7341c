"""Saved rule results and exports with documents per rule."""

import datetime as dt

from pyspark.sql import functions as F

from cohortlens.plans import runner as RN
from cohortlens.plans import saved as SV
from cohortlens.sources import reports as RP

NOW = dt.datetime(2025, 1, 1, 12)
ASOF = dt.date(2025, 1, 1)


def _rules(calls):
    def few(tables, variant, asof, ordered, limit=None):
        calls.append("few")
        return tables["t"].where("v < 5").select(F.lit("few").alias("rule_name"), F.col("id").alias("entity_id"), F.lit("small").alias("issue_description"),
                                                 F.lit("LOW").alias("severity"), "v")

    def many(tables, variant, asof, ordered, limit=None):
        calls.append("many")
        return tables["t"].select(F.lit("many").alias("rule_name"), F.col("id").alias("entity_id"), F.lit("any").alias("issue_description"),
                                  F.lit("HIGH").alias("severity"))

    def broken(tables, variant, asof, ordered, limit=None):
        calls.append("broken")
        return tables["t"].select("no_such_column")

    return {"few": few, "many": many, "broken": broken}


def _run(spark, tmp_path, calls, now=NOW, settings=(), asof=ASOF):
    tables = {"t": spark.read.parquet(str(tmp_path / "t"))}
    return SV.run_rules_saved(tables, {"t": str(tmp_path / "t")}, str(tmp_path / "store"), asof, now, rules=_rules(calls), settings=settings, max_rows=20)


def _flags(df):
    return {(r.rule_name, r.from_saved): r["count"] for r in df.groupBy("rule_name", "from_saved").count().collect()}


def test_saved_results_are_read_back_until_something_changes(spark, tmp_path):
    data = spark.range(40).select(F.col("id").cast("string").alias("id"), F.col("id").alias("v"))
    data.write.parquet(str(tmp_path / "t"))
    calls = []
    first = _run(spark, tmp_path, calls)
    assert _flags(first) == {("few", False): 5, ("many", False): 40, ("broken", False): 1} and calls == ["few", "many", "broken"]
    calls.clear()
    second = _run(spark, tmp_path, calls, NOW + dt.timedelta(minutes=59))
    # Too many rows and failed rules are not saved; what is read back scans the store only.
    assert _flags(second) == {("few", True): 5, ("many", False): 40, ("broken", False): 1} and calls == ["many", "broken"]
    assert all("/store/rows/" in f for f in second.inputFiles())
    rows = lambda df: sorted(map(tuple, df.where("rule_name <> 'broken'").drop("from_saved").collect()), key=str)
    assert rows(second) == rows(first)
    only = lambda df: _flags(df.where("rule_name = 'few'"))
    assert only(_run(spark, tmp_path, calls, NOW + dt.timedelta(minutes=60))) == {("few", False): 5}  # past its time
    assert only(_run(spark, tmp_path, calls, settings=[("few", True, "HIGH", 80.0)])) == {("few", False): 5}
    assert only(_run(spark, tmp_path, calls, settings=[("few", False, "HIGH", 80.0)])) == {}
    assert only(_run(spark, tmp_path, calls, asof=dt.date(2025, 1, 2))) == {("few", False): 5}
    data.limit(3).write.mode("append").parquet(str(tmp_path / "t"))
    assert sum(only(_run(spark, tmp_path, calls)).values()) > 5  # another input file: run again
    stats = RN.hit_statistics(SV.lookups(spark, str(tmp_path / "store"))).first()
    assert (stats.hits, stats.lookups) == (1, 20)
    kept = SV.entries(spark, str(tmp_path / "store")).where(F.col("expires_at") > F.lit(NOW + dt.timedelta(minutes=61))).count()
    assert SV.drop_expired(spark, str(tmp_path / "store"), NOW + dt.timedelta(minutes=61)) > 0
    assert kept == SV.entries(spark, str(tmp_path / "store")).count() == 1
    assert only(_run(spark, tmp_path, calls, NOW + dt.timedelta(minutes=61))) != {}


def test_export_documents_hold_every_violation_once(spark, tmp_path):
    data = spark.range(40).select(F.col("id").cast("string").alias("id"), F.col("id").alias("v"))
    rules = _rules([])
    none = {"none": lambda tables, **k: rules["few"](tables, **k).where("1 = 0")}
    found, runs = RN.run_rules_timed({"t": data}, str(tmp_path / "runs"), ASOF, rules={**rules, **none})
    assert {(r.rule_name, r.success, r.violation_count) for r in runs.collect()} == {("few", True, 5), ("many", True, 40), ("broken", False, 0), ("none", True, 0)}
    assert runs.where("execution_time <= 0").count() == 0
    docs = RP.export_documents(found, runs, RN.settings_table(spark, [("few", True, "CRITICAL", None)]), NOW, part_rows=12)
    RP.export_violations(docs, str(tmp_path / "json"), "json")
    back = spark.read.json(str(tmp_path / "json"))
    assert {(r.rule_name, r.severity, r.parts): r.n for r in back.groupBy("rule_name", "severity", "parts").agg(F.count(F.lit(1)).alias("n")).collect()} == {
        ("few", "CRITICAL", 1): 1, ("many", "MEDIUM", 4): 4, ("broken", "MEDIUM", 1): 1, ("none", "MEDIUM", 1): 1}
    ids = back.select("rule_name", F.explode("violations.entity_id").alias("id"))
    assert sorted((r.rule_name, int(r.id)) for r in ids.collect()) == [("few", i) for i in range(5)] + [("many", i) for i in range(40)]

"""Headline timings. Prints one JSON line.

The domain tables are first written to Parquet (the rules' input is at rest, as it is for the reference numbers); that
step is reported as ``setup_sec`` and not part of the metric. Every query then reads its files and writes all rows to
the no-op sink: ``cold`` is the first run in the session, ``queries`` the median of three runs after it. Nothing is
cached or reused between runs. The rules run on as many records as the published numbers were taken on (``RECORDS``:
all providers and facilities, and affiliations chosen by a hash up to that count, if there are so many); ``whole`` has
the optimized rules on the whole tables. ``ten_fold`` repeats the optimized rules on ten copies of those records with distinct
ids, NPIs and e-mails (warm, median of two), to show how the times move with the data.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from cohortlens.fixtures import ASOF  # noqa: E402
from cohortlens.operators import joins as J  # noqa: E402
from cohortlens.operators import master as M  # noqa: E402
from cohortlens.operators import research as R  # noqa: E402
from cohortlens.operators import rules as VR  # noqa: E402
from cohortlens.operators import scores as DQ  # noqa: E402
from cohortlens.operators import survival as SV  # noqa: E402
from cohortlens.operators import windows as W  # noqa: E402
from cohortlens.plans import runner as RN  # noqa: E402
from cohortlens.plans.registry import Tables  # noqa: E402
from cohortlens.session import local_session, scratch_path  # noqa: E402

#: Records of the published single-node numbers.
RECORDS = 125_531
DOMAIN = ("providers", "facilities", "affiliations", "activities", "study_rows", "survival", "call_log")


def ten_fold(t: dict, home: str) -> dict:
    """Ten copies of the rule tables; ids, NPIs and e-mails differ by copy, so duplicates stay as frequent as before."""
    def copies(name: str, ids: list[str], shift: dict[str, str]):
        d = t[name].withColumn("rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: x.cast("string"))))
        d = d.withColumns({c: F.concat(F.col(c), F.lit("_"), F.col("rep")) for c in ids})
        d = d.withColumns({c: F.expr(e) for c, e in shift.items()}).drop("rep")
        d.write.mode("overwrite").parquet(f"{home}/x10-{name}")
        return d.sparkSession.read.parquet(f"{home}/x10-{name}")

    return {
        "providers": copies("providers", ["provider_id"], {"npi_number": "concat(rep, substr(npi_number, 2))", "email": "concat(rep, email)"}),
        "facilities": copies("facilities", ["facility_id"], {}),
        "affiliations": copies("affiliations", ["provider_id", "facility_id"], {}),
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    home = scratch_path(spark, "bench")
    t0 = time.time()
    src = Tables(spark, folder)
    for n in DOMAIN:
        src[n].write.mode("overwrite").parquet(f"{home}/{n}")
    setup = time.time() - t0
    t = {n: spark.read.parquet(f"{home}/{n}") for n in DOMAIN}

    whole = dict(t)
    room = max(0, RECORDS - t["providers"].count() - t["facilities"].count())
    t["affiliations"].orderBy(F.xxhash64("provider_id", "facility_id"), "provider_id", "facility_id").limit(room).write.parquet(f"{home}/affiliations-at-baseline")
    t["affiliations"] = spark.read.parquet(f"{home}/affiliations-at-baseline")

    rule = lambda name, variant: (lambda: VR.RULES[name](t, variant=variant, asof=ASOF))
    queries = {}
    for name in VR.RULES:
        queries[f"{name}"] = rule(name, "optimized")
        queries[f"{name}_standard"] = rule(name, "standard")
    queries.update({
        "all_rules": lambda: RN.run_rules(t, ASOF),
        "quality_metrics": lambda: DQ.quality_metrics(t["providers"], ASOF),
        "activity_summary": lambda: J.provider_activity_summary(t),
        "activity_spikes": lambda: M.activity_spikes(t["activities"]),
        "last_calls": lambda: W.last_calls(t["call_log"], "query_name", "ts", "event_id", "execution_time", "error"),
        "category_summary": lambda: R.category_summary(t["study_rows"]),
        "research_quality": lambda: R.research_quality(t["study_rows"]),
        "kaplan_meier": lambda: SV.km_curve(t["survival"], "duration", "event", "treatment_group"),
    })
    run = lambda q: q().write.format("noop").mode("overwrite").save()
    cold, warm = {}, {}
    run(queries["validation_summary"])  # session start-up
    for name, q in queries.items():
        s = time.time()
        run(q)
        cold[name] = round(time.time() - s, 3)
    for name, q in queries.items():
        times = []
        for _ in range(3):
            s = time.time()
            run(q)
            times.append(time.time() - s)
        warm[name] = round(statistics.median(times), 3)
    rules = [warm[n] for n in VR.RULES]
    all_of_it = {}
    for name in VR.RULES:
        s = time.time()
        run(lambda: VR.RULES[name](whole, variant="optimized", asof=ASOF))
        all_of_it[name] = round(time.time() - s, 3)
    all_of_it["total"] = round(sum(all_of_it.values()), 3)
    all_of_it["records"] = sum(whole[n].count() for n in ("providers", "facilities", "affiliations"))
    big = ten_fold(t, home)
    more = {}
    for name in VR.RULES:
        times = []
        for _ in range(3):
            s = time.time()
            run(lambda: VR.RULES[name](big, variant="optimized", asof=ASOF))
            times.append(time.time() - s)
        more[name] = round(statistics.median(times[1:]), 3)
    more["total"] = round(sum(more.values()), 3)
    more["records"] = sum(big[n].count() for n in big)
    print(json.dumps({
        "metric": "seven optimized rules, warm median, total", "value": round(sum(rules), 3), "unit": "sec", "queries": warm, "cold": cold, "whole": all_of_it, "ten_fold": more,
        "setup_sec": round(setup, 2), "rows": {n: t[n].count() for n in DOMAIN}, "sf": folder.rstrip("/").split("sf")[-1], "cpus": cpus,
        "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()

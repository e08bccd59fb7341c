"""Streams over several batches in any order, and tables that are rewritten only where changes touch them."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from cohortlens.operators import monitoring as O
from cohortlens.operators.master import apply_changes
from cohortlens.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def _files(spark, path, parts):
    for rows in parts:
        spark.createDataFrame(rows, jobs.CLOSING_KIND).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(jobs.CLOSING_KIND).option("maxFilesPerTrigger", 1).parquet(path)


def test_shuffled_hits_give_the_batch_answer(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"r{i % 3}", T0 + dt.timedelta(seconds=rng.randrange(20_000)), 10 + i % 3) for i in range(240)]
    stream = _files(spark, str(tmp_path / "in"), [rows[i:i + 60] for i in range(0, 240, 60)])
    got = jobs.run_closed(stream, str(tmp_path / "out"), delay="12 hours")
    want = O.cooldown_emissions(spark.createDataFrame(rows, jobs.CLOSING_KIND))
    assert sorted(tuple(r) for r in got.select("rule", "ts").collect()) == sorted(tuple(r) for r in want.collect())
    assert got.where("late").isEmpty()


def test_late_hits_are_counted(spark, tmp_path):
    at = lambda *minutes: [("r", T0 + dt.timedelta(minutes=m), 10) for m in minutes]
    stream = _files(spark, str(tmp_path / "in"), [at(0, 100), at(5, 60, 95, 130), at(140)])
    got = jobs.run_closed(stream, str(tmp_path / "out"), delay="20 minutes").select("ts", "late").collect()
    assert sorted(r.ts for r in got if not r.late) == [r[1] for r in at(0, 95, 130, 140)]
    assert sorted(r.ts for r in got if r.late) == [r[1] for r in at(5, 60)]  # come after minute 100 was seen


def test_batches_rewrite_the_buckets_they_touch(spark, tmp_path):
    start = spark.range(400).select(F.format_string("k%03d", "id").alias("id"), F.lit("a").alias("name"), F.lit("m").alias("email"))
    log = [(f"k{k:03d}", n, op, f"e{n}") for n, (k, op) in enumerate([(7, "UPDATE"), (7, "UPDATE"), (8, "DELETE"), (900, "INSERT"), (7, "DELETE"), (900, "UPDATE"), (9, "UPDATE")])]
    table = jobs.BucketedTable(spark, f"{tmp_path}/t", start.schema, "id", 32)
    table.start(start)
    rows = start
    for n, part in enumerate((log[:3], log[3:5], log[5:])):
        changes = spark.createDataFrame(part, "record_id string, n int, operation_type string, email string")
        touched = table.apply(n, changes, "id", ["n"], ["email"])
        assert table.apply(n, changes, "id", ["n"], ["email"]) == touched  # a replay
        assert 1 <= len(touched) <= len({r[0] for r in part})
        written = [d for d in os.listdir(f"{tmp_path}/t/data/version={n + 1}") if d.startswith("bucket=")]
        assert {int(d[7:]) for d in written} <= set(touched)
        rows = spark.createDataFrame(apply_changes(rows, changes, "id", ["n"], ["email"]).collect(), table.schema)
        assert sorted(map(str, table.read(n + 1).collect())) == sorted(map(str, rows.collect()))
        table.drop_before(n)
        assert sorted(map(str, table.read(n + 1).collect())) == sorted(map(str, rows.collect()))
    assert not os.path.exists(f"{tmp_path}/t/manifest/state=1")

"""Saved rule results: written once, read back while rule, arguments and input files are the same and the time allows.

A store is a folder that all executors share:

* ``rows/<rule>-<id>``: the violations of one run of one rule, as Parquet;
* ``entries``: one row per saved result (fingerprint, times, row count, folder), appended;
* ``lookups``: one row per look-up, appended, for :func:`runner.hit_statistics`.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.rules import RULES
from cohortlens.plans import runner as RN

col, lit = F.col, F.lit

ENTRY = "rule_name string, fingerprint string, saved_at timestamp, expires_at timestamp, row_count long, folder string"
LOOKUP = "rule_name string, fingerprint string, looked_at timestamp, cache_hit boolean"


def files_digest(spark: SparkSession, inputs: Mapping[str, str]) -> str:
    """Digest of the names, sizes and modification times of the files below the ``inputs`` (name -> path).

    Files are listed by Spark and reduced to one row per input; their contents are not read.
    """
    seen = []
    for name in sorted(inputs):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(inputs[name]).select("path", "modificationTime", "length")
        seen.append((name, inputs[name], *files.agg(F.count(lit(1)), F.sum("length"), F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)"))).first()))
    return hashlib.sha256(json.dumps(seen, default=str).encode()).hexdigest()


def rule_fingerprint(rule: str, digest: str, asof: dt.date, variant: str, limits: bool, settings: Sequence[tuple]) -> str:
    """What a saved result depends on: the rule, its arguments, its row of the settings, and the input files."""
    own = [list(s) for s in settings if s[0] == rule]
    return hashlib.sha256(json.dumps([rule, digest, asof.isoformat(), variant, limits, own]).encode()).hexdigest()


def _folder_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def entries(spark: SparkSession, store: str) -> DataFrame:
    path = f"{store}/entries"
    return spark.read.schema(ENTRY).parquet(path) if _folder_exists(spark, path) else spark.createDataFrame([], ENTRY)


def lookups(spark: SparkSession, store: str) -> DataFrame:
    path = f"{store}/lookups"
    return spark.read.schema(LOOKUP).parquet(path) if _folder_exists(spark, path) else spark.createDataFrame([], LOOKUP)


def run_rules_saved(tables: RN.Tables, inputs: Mapping[str, str], store: str, asof: dt.date, now: dt.datetime, variant: str = "standard",
                    only: Sequence[str] | None = None, rules: Mapping[str, RN.Rule] = RULES, limits: bool = True,
                    settings: Sequence[tuple] = RN.SETTINGS, max_rows: int = RN.MAX_SAVED_ROWS) -> DataFrame:
    """Violations of the rules with ``from_saved``: read from the store where a valid result exists, else run, written and entered.

    ``inputs`` names the files or folders behind ``tables``: a file added, changed or taken away gives another fingerprint.
    Rules that the settings disable give no rows. A result is valid for the rule's time to live (``runner.TIME_TO_LIVE``)
    after ``now`` of its run. Results of more than ``max_rows`` rows and results with an ERROR row are returned, but not
    entered, so the next run computes them again.
    """
    spark = next(iter(tables.values())).sparkSession
    digest = files_digest(spark, inputs)
    off = {s[0] for s in settings if not s[1]}
    names = [n for n in rules if n not in off and (only is None or n in only)]
    prints = {n: rule_fingerprint(n, digest, asof, variant, limits, settings) for n in names}
    known = entries(spark, store).where(col("fingerprint").isin(list(prints.values())))
    valid = {r["fingerprint"]: r["folder"] for r in RN.newest_valid(known, now, max_rows).collect()}  # one row per rule
    out, made = None, []
    for name in names:
        hit = prints[name] in valid
        if hit:
            folder = valid[prints[name]]
        else:
            folder = f"{store}/rows/{name}-{uuid.uuid4().hex}"
            plan = RN.run_rules(tables, asof, variant, [name], rules, limits=limits)
            plan.write.parquet(folder)
        part = spark.read.schema(_LONG).parquet(folder)
        if not hit:
            n, errors = part.agg(F.count(lit(1)), F.count_if(col("severity") == "ERROR")).first()
            if n <= max_rows and not errors:
                ttl = dt.timedelta(minutes=RN.TIME_TO_LIVE.get(name, 60))
                made.append((name, prints[name], now, now + ttl, n, folder))
        part = part.withColumn("from_saved", lit(hit))
        out = part if out is None else out.unionByName(part)
    if made:
        spark.createDataFrame(made, ENTRY).coalesce(1).write.mode("append").parquet(f"{store}/entries")
    if names:
        spark.createDataFrame([(n, prints[n], now, prints[n] in valid) for n in names], LOOKUP).coalesce(1).write.mode("append").parquet(f"{store}/lookups")
    return out if out is not None else spark.createDataFrame([], _LONG + ", from_saved boolean")


_LONG = ", ".join(f"{c} string" for c in RN.LONG_COLUMNS)


def drop_expired(spark: SparkSession, store: str, now: dt.datetime) -> int:
    """Delete the rows of results that are past their time, and of results never entered; returns the number of folders deleted.

    Entries that are left are written anew as one file. Not to be run while rules write to the store.
    """
    if not _folder_exists(spark, f"{store}/rows"):
        return 0
    keep = entries(spark, store).where(col("expires_at") > lit(now)).collect()  # one row per saved result
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(store).getFileSystem(spark._jsc.hadoopConfiguration())
    used = {r["folder"].rstrip("/").rsplit("/", 1)[1] for r in keep}
    spark.createDataFrame(keep, ENTRY).coalesce(1).write.mode("overwrite").parquet(f"{store}/entries")
    dropped = 0
    for f in files.listStatus(path(f"{store}/rows")):
        if f.getPath().getName() not in used:
            files.delete(f.getPath(), True)
            dropped += 1
    return dropped

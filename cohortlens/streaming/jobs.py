"""Structured Streaming forms of the event-time questions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cohortlens.operators.master import apply_changes
from cohortlens.operators.monitoring import evaluate_rules, recent_call_stats

col, lit = F.col, F.lit


def events_stream(spark: SparkSession, folder: str, name: str = "events", files_per_batch: int = 1000) -> DataFrame:
    """A Parquet folder as a stream. ``ts`` becomes a timestamp, which watermarks require."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return raw.withColumn("ts", col("ts").cast("timestamp"))


def call_log_stream(events: DataFrame) -> DataFrame:
    """The ``call_log`` view over a stream of events."""
    return events.select("event_id", "ts", col("event_type").alias("query_name"), (col("value") / 25.0).alias("execution_time"),
                         (col("event_type") == "error").alias("error"), (col("user_id") % 2 == 0).alias("cache_hit"))


def call_stats(calls: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Trailing statistics; rows later than ``delay`` behind the newest event are dropped."""
    return recent_call_stats(calls.withWatermark("ts", delay))


def threshold_alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Stateless: every metric row of the stream is compared with the static rules."""
    return evaluate_rules(metrics, rules)


#: Rule of the row that closes a bounded stream.
CLOSING, CLOSING_KIND = "~closing", "rule string, ts timestamp, cooldown_minutes int"


def closing_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream that has nothing until :func:`close` puts a hit far in the future into it. A stream that ends needs that: its
    watermark then moves beyond all other rows, so that the hits still held back are released."""
    spark.createDataFrame([], CLOSING_KIND).write.mode("overwrite").parquet(folder)
    return spark.readStream.schema(CLOSING_KIND).parquet(folder)


def close(spark: SparkSession, folder: str) -> None:
    spark.sql(f"SELECT '{CLOSING}' AS rule, TIMESTAMP '2200-01-01' AS ts, 1 AS cooldown_minutes").write.mode("append").parquet(folder)


def with_cooldown(hits: DataFrame, rule: str = "rule", delay: str = "10 minutes") -> DataFrame:
    """Alerts ``rule, ts, late`` of a stream of rule hits (``ts``, ``cooldown_minutes``) that pass the cooldown.

    Hits may come in any order: a rule's state holds those that the watermark has not passed, its timer releases them in the
    order of time, and the cooldown then counts from the last emitted one, as in the batch form. A hit that
    the watermark has passed when it comes (more than ``delay`` behind the newest of earlier batches) is no alert: it comes out
    marked ``late``, to be counted. A state without held hits ends when its cooldown has.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Whole milliseconds; rows at the watermark itself are late already.
        passed = state.getCurrentWatermarkMs() * 1000 + 999
        held, last, cool = state.get if state.exists else ([], None, 0)
        held, late = [int(x) for x in held], []
        for b in batches:
            if len(b):
                held.extend(b["us"][b["us"] > passed].tolist())
                late.extend(b["us"][b["us"] <= passed].tolist())
                cool = int(b["cool"].iloc[0])
        keep, wait = [], []
        for us in sorted(set(held)):
            if us > passed:
                wait.append(us)
            elif last is None or us >= last + cool:
                keep.append(us)
                last = us
        if not wait and (last is None or last + cool <= passed):
            if state.exists:
                state.remove()
        else:
            state.update((wait, last, cool))
            state.setTimeoutTimestamp((wait[0] if wait else last + cool) // 1000 + 1)
        if keep or late:
            yield pd.DataFrame({"rule": [key[0]] * len(keep + late), "us": keep + late, "late": [False] * len(keep) + [True] * len(late)})

    d = hits.withWatermark("ts", delay).select(
        col(rule).alias("rule"), "ts", F.unix_micros("ts").alias("us"), (col("cooldown_minutes").cast("bigint") * 60_000_000).alias("cool"))
    out = d.groupBy("rule").applyInPandasWithState(
        step, "rule string, us bigint, late boolean", "held array<bigint>, last bigint, cool bigint", "append", GroupStateTimeout.EventTimeTimeout)
    return out.where(~col("rule").eqNullSafe(CLOSING)).select("rule", F.timestamp_micros("us").alias("ts"), "late")


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process all available input once into a Parquet folder and return the folder's rows with their batch number."""
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        # Overwriting the batch's own folder makes a replayed batch harmless.
        batch.write.mode("overwrite").parquet(f"{path}/data/batch_id={batch_id}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    if q.lastProgress is None:  # no input, so no batch was written
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/data")


def run_closed(hits: DataFrame, path: str, delay: str = "10 minutes") -> DataFrame:
    """:func:`with_cooldown` for a bounded stream of rule hits: its input is processed, then the stream is closed."""
    spark, end = hits.sparkSession, f"{path}/closing"
    both = hits.select("rule", "ts", "cooldown_minutes").unionByName(closing_stream(spark, end))
    out = with_cooldown(both, delay=delay)
    run_available(out, path)
    close(spark, end)
    return run_available(out, path)


def latest_update(rows: DataFrame, *keys: str) -> DataFrame:
    """The newest version of each key of an update-mode result."""
    rest = [c for c in rows.columns if c not in keys and c != "batch_id"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_s")).select(*keys, "_s.*")


class BucketedTable:
    """A keyed table in ``buckets`` folders by the hash of its key, each with versions; a manifest names the versions of a state.

    State ``n + 1`` rewrites the buckets that the changes of batch ``n`` touch and shares the others with state ``n``. Writing a
    state again replaces its own folders only, so a batch that is replayed is harmless. A state's manifest, of one number
    a bucket, is all that the driver reads.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 64):
        # Inserted records need not have every column.
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), lit(self.buckets)).cast("int")

    def manifest(self, state: int) -> dict[int, int]:
        rows = self.spark.read.schema("bucket int, version int").parquet(f"{self.path}/manifest/state={state}").collect()
        return {r["bucket"]: r["version"] for r in rows}

    def _read(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, state: int) -> DataFrame:
        return self._read(self.manifest(state))

    def _write(self, rows: DataFrame, state: int, before: dict[int, int], touched: list[int]) -> None:
        folder = f"{self.path}/data/version={state}"
        rows.select(*self.schema.names, self.bucket().alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        made = {r["bucket"] for r in self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(folder).select("bucket").distinct().collect()}
        versions = {b: v for b, v in before.items() if b not in touched} | {b: state for b in made}
        self.spark.createDataFrame(sorted(versions.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/state={state}")

    def start(self, rows: DataFrame) -> None:
        self._write(rows, 0, {}, [])

    def apply(self, state: int, changes: DataFrame, key: str, order: list[str], values: list[str]) -> list[int]:
        """State ``state + 1``: ``changes`` (of records ``record_id``) applied to the buckets that they touch, which are returned."""
        versions = self.manifest(state)
        touched = sorted(r[0] for r in changes.select(F.pmod(F.xxhash64(col("record_id").cast(self.schema[key].dataType)), lit(self.buckets)).cast("int")).distinct().collect())
        current = self._read({b: v for b, v in versions.items() if b in touched})
        self._write(apply_changes(current, changes, key, order, values), state + 1, versions, touched)
        return touched

    def drop_before(self, state: int) -> None:
        """Drops folders that ``state`` and later ones don't use."""
        used = set(self.manifest(state).items())
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for old in range(state):
            folder = path(f"{self.path}/data/version={old}")
            if files.exists(folder):
                for f in files.listStatus(folder):
                    name = f.getPath().getName()
                    if name.startswith("bucket=") and (int(name[7:]), old) not in used:
                        files.delete(f.getPath(), True)
            files.delete(path(f"{self.path}/manifest/state={old}"), True)


def apply_change_stream(changes: DataFrame, path: str, start: DataFrame, key: str, order: list[str], values: list[str], checkpoint: str,
                        buckets: int = 64) -> DataFrame:
    """Apply a stream of changes batch by batch and return the table after the last batch.

    A batch reads and rewrites the buckets of the keys that it changes (:class:`BucketedTable`); batch ``n`` makes state
    ``n + 1`` from state ``n``, and what states before ``n`` alone used is dropped.
    """
    table = BucketedTable(changes.sparkSession, path, start.schema, key, buckets)
    table.start(start)
    done = [0]

    def step(batch: DataFrame, batch_id: int) -> None:
        table.apply(batch_id, batch, key, order, values)
        table.drop_before(batch_id)
        done[0] = batch_id + 1

    q = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return table.read(done[0])

"""Session helpers: a local test session and the checkpoint folder used by iterative jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "cohortlens", cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benches on one machine. On a cluster use the session you were given."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def own_folder(master: str, warehouse: str) -> str:
    """Checkpoint folder of a session that names none."""
    local_path = ":" not in warehouse or warehouse.startswith("file:")
    if local_path and not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{warehouse.rstrip('/')}/_checkpoints"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for ``DataFrame.checkpoint()`` and for tables that a job writes and reads again.

    The cluster names a shared folder in ``spark.checkpoint.dir``; a session that names none gets a fresh folder under
    its warehouse folder. A folder set on the context before stays. On a cluster without that setting, a warehouse on the
    driver's own disk is an error, because executors could not read what is written there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(named or own_folder(sc.master, spark.conf.get("spark.sql.warehouse.dir")))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder, for tables that a job writes and reads again."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and go on from the files.

    ``row_group`` bytes, if given, let the files be read in finer splits.
    """
    path = scratch_path(df.sparkSession, name)
    (df.write.option("parquet.block.size", row_group) if row_group else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

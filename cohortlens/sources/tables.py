"""Reading category folders, authors and domain tables; writing and reconciling tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from cohortlens.functions.extract import title_case
from cohortlens.operators.research import CATEGORIES, DIAGNOSTICS, PATIENTS, RISK, THERAPEUTICS

col, lit = F.col, F.lit
TEXT_WORDS = ("title", "abstract", "conclusion", "finding", "note", "description")
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy", "yyyy/M/d")
PROVENANCE = ("source_category", "source_table", "row_ordinal")


# ``category/table.csv``, or ``category/table.csv/part-…`` as Spark itself writes a table.
CSV_PATH = r"^.*?/([^/]+)/([^/]+)\.csv(?:/part-[^/]+)?$"


def _path_part(i: int, path: str = "path") -> Column:
    return F.url_decode(F.regexp_extract(path, CSV_PATH, i))


def list_files(spark: SparkSession, base: str) -> DataFrame:
    """``category, table, path`` of the CSV files below ``base``; only file names are read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(base)
        .select("path"))
    return files.select(_path_part(1).alias("category"), _path_part(2).alias("table"), "path")


def input_inventory(spark: SparkSession, base: str, expected: Sequence[str] = tuple(CATEGORIES), needed: int = 4) -> DataFrame:
    """Files per expected category, whether it was found, and whether enough categories exist for an analysis."""
    found = list_files(spark, base).select("category", "table").distinct().groupBy("category").agg(F.count(lit(1)).alias("files"))
    want = spark.createDataFrame([(c,) for c in expected], "category string")
    rows = want.join(found, "category", "left").select(
        "category", F.coalesce("files", lit(0)).alias("files"), col("files").isNotNull().alias("found"))
    usable = rows.agg((F.count_if("found") >= needed).alias("usable"))
    return rows.join(F.broadcast(usable))


_PLACE = ("file_place_path", "file_place_start", "file_place_id")  # names that no data column should have


def with_place(raw: DataFrame) -> DataFrame:
    """A file scan with where each row stands: file, start of its block, and an id that rises within the block."""
    return raw.select("*", col("_metadata.file_path").alias("file_place_path"), col("_metadata.file_block_start").alias("file_place_start"),
                      F.monotonically_increasing_id().alias("file_place_id"))


def with_ordinal(placed: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """0-based row number per ``keys`` in the order of (file, place in file), the same for any split size.

    A block is read by one task in order, so the place in a block is the distance to the block's first id. Only blocks
    (one row each, a row per file or per ``maxPartitionBytes``) are numbered by a window; rows add their block's start.
    """
    block = [*keys, "file_place_path", "file_place_start"]
    stats = placed.groupBy(*block).agg(F.min("file_place_id").alias("_first"), F.count(lit(1)).alias("_n"))
    w = Window.partitionBy(*(keys or [lit(0)])).orderBy("file_place_path", "file_place_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = stats.select(*block, (F.coalesce(F.sum("_n").over(w), lit(0)) - col("_first")).alias("file_place_shift"))
    return placed.join(starts, block).withColumn(out, col("file_place_id") + col("file_place_shift")).drop(*_PLACE, "file_place_shift")


def _heads(spark: SparkSession, base: str) -> DataFrame:
    """``path, head``: the first line of every CSV file. Only blocks at offset 0 keep a row, one per file after the combine."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(base)
    # Spark writes ``table.csv`` as a folder whose parts end in ``.csv`` as well.
    first = lines.select(col("_metadata.file_path").alias("path"), col("_metadata.file_block_start").alias("at"),
                         F.monotonically_increasing_id().alias("i"), "value").where((col("at") == 0) & (F.trim("value") != ""))
    return first.groupBy("path").agg(F.min_by("value", "i").alias("head"))


def read_category_tables(spark: SparkSession, base: str, multi_line: bool = True) -> DataFrame:
    """Every CSV under the category folders as one long table with provenance columns.

    Files with the same header line are one scan, and the scans are united by column name; the driver gets one row for each
    header, with its file names. A file without a header or one that cannot be read is skipped. ``row_ordinal`` counts the
    rows of a table from 0 in file order. ``multi_line`` keeps line breaks inside quoted cells; switch it off to let big
    files split.
    """
    found = _heads(spark, base).where(_path_part(1).isin(*CATEGORIES))
    scans = found.groupBy("head").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("head").collect()
    out: DataFrame | None = None
    for _, paths in scans:
        try:
            raw = spark.read.csv(paths, header=True, multiLine=multi_line, escape='"', mode="PERMISSIVE")
        except AnalysisException:
            continue
        if not raw.columns:
            continue
        # Cells are addressed by position, so a header may hold any name.
        part = with_place(raw).toDF(*[c.strip() for c in raw.columns], *_PLACE).withColumns({
            "source_category": _path_part(1, "file_place_path"), "source_table": _path_part(2, "file_place_path")})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], "source_category string, source_table string, row_ordinal bigint")
    data = [c for c in out.columns if c not in (*PROVENANCE, *_PLACE)]
    return with_ordinal(out, ["source_category", "source_table"], "row_ordinal").select(*[col(f"`{c.replace('`', '``')}`") for c in data], *PROVENANCE)


def table_columns(spark: SparkSession, base: str) -> DataFrame:
    """``source_category, source_table, column_name`` of every file."""
    return _heads(spark, base).select(_path_part(1).alias("source_category"), _path_part(2).alias("source_table"), F.explode(F.transform(
        F.split("head", ","), lambda x: F.trim(F.translate(x, '"', "")))).alias("column_name")).distinct()


def parse_date(c: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, lit(f)) for f in DATE_FORMATS])


def standardize(df: DataFrame) -> DataFrame:
    """Drop empty rows, tidy column names, parse text columns whose name contains ``date`` (unreadable -> NULL)."""
    data = [c for c in df.columns if c not in PROVENANCE]
    kept = df.dropna("all", subset=data) if data else df
    named = kept.toDF(*[c.strip().replace(" ", "_").lower() for c in kept.columns])
    dates = [f.name for f in named.schema.fields if "date" in f.name and isinstance(f.dataType, T.StringType)]
    return named.withColumns({c: parse_date(col(c)) for c in dates}) if dates else named


def unify(rows: DataFrame, kind: str) -> DataFrame:
    """One of the four united data sets: ``patients``, ``risk``, ``therapeutics``, ``diagnostics``."""
    c = col("source_category")
    if kind == "patients":
        return standardize(rows.where(c.isin(PATIENTS, THERAPEUTICS)))
    if kind == "risk":
        return standardize(rows.where(c == RISK).withColumn("risk_factor_type", title_case(col("source_table"))))
    if kind == "therapeutics":
        # The table name replaces any study type column.
        return standardize(rows.where(c == THERAPEUTICS).withColumn("study_type", col("source_table")))
    if kind == "diagnostics":
        return standardize(rows.where(c == DIAGNOSTICS).withColumn("diagnostic_type", col("source_table")))
    raise ValueError(f"unknown kind {kind}")


def extract_texts(rows: DataFrame, extra_words: Sequence[str] = (), min_length: int = 50) -> DataFrame:
    """Long rows of the text columns, longer than ``min_length``."""
    words = (*TEXT_WORDS, *extra_words)
    cols = [c for c in rows.columns if any(w in c.lower() for w in words) and c not in PROVENANCE]
    long = rows.select(*PROVENANCE, *[col(c).cast("string").alias(c) for c in cols]).unpivot(
        list(PROVENANCE), cols, "text_type", "text")
    return long.where(F.length("text") > min_length)


def extract_dates(rows: DataFrame, date: str = "study_date") -> DataFrame:
    return rows.where(col(date).isNotNull()).groupBy(col(date).alias("date"), "source_category").agg(
        F.count(lit(1)).alias("study_count"))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows, the same for the same seed on any cluster: a top-n over a hash of the key."""
    return df.orderBy(F.md5(F.concat_ws(":", col(key).cast("string"), lit(str(seed)))), key).limit(n)


def read_authors(spark: SparkSession, path: str, n: int | None = None, seed: int = 42, multi_line: bool = False) -> DataFrame:
    """Author CSV as ``row_no, author_id, full_name, authors``; absent columns become NULL. ``row_no`` counts from 0 in file order."""
    raw = spark.read.csv(path, header=True, escape='"', multiLine=multi_line)
    low = {c.strip().lower(): c for c in raw.columns}
    pick = lambda *names: next((col(f"`{low[x]}`") for x in names if x in low), lit(None).cast("string"))
    named = with_place(raw).select(pick("author_id", "id").alias("author_id"), pick("full_name", "name").alias("full_name"),
                                   pick("authors", "author").alias("authors"), *_PLACE)
    df = with_ordinal(named, [], "row_no").select("row_no", "author_id", "full_name", "authors")
    return df if n is None else sample_rows(df, "row_no", n, seed)


def explore(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The first rows by ``key``."""
    return df.orderBy(key).limit(n)


def append_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def append_quality_metrics(df: DataFrame, path: str) -> None:
    append_table(df, path, ("measurement_date",))


def append_violations(df: DataFrame, path: str) -> None:
    append_table(df, path, ("violation_date",))


def row_digest(df: DataFrame) -> Column:
    """Order-free digest of a table: the sum of row hashes over all columns."""
    return F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))


def copy_and_reconcile(src: DataFrame, path: str) -> DataFrame:
    """Copy a table and compare row count and digest before and after."""
    src.write.mode("overwrite").parquet(path)
    dst = src.sparkSession.read.schema(src.schema).parquet(path)
    side = lambda d, n: d.select(*src.columns).agg(F.count(lit(1)).alias(f"{n}_rows"), row_digest(src).alias(f"{n}_digest"))
    both = side(src, "source").join(F.broadcast(side(dst, "target")))
    return both.select(
        "source_rows", "target_rows", ((col("source_rows") == col("target_rows")) & col("source_digest").eqNullSafe(
            col("target_digest"))).alias("matches"))


def load_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table and the distinct specialties and licence states."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(lit(1)).alias("n")).select(lit(name).alias("item"), "n")
        out = part if out is None else out.unionByName(part)
    d = tables["providers"].agg(
        F.count_distinct("specialty_primary").alias("distinct_specialties"), F.count_distinct("license_state").alias("distinct_states"))
    return out.unionByName(d.unpivot([], ["distinct_specialties", "distinct_states"], "item", "n"))


def table_overview(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and distinct rows per table, with the total and the largest table on every row."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(lit(1)).alias("row_count"), F.count_distinct(F.struct(*df.columns)).alias("distinct_rows")).select(
            lit(name).alias("table_name"), "row_count", "distinct_rows")
        out = part if out is None else out.unionByName(part)
    total = out.agg(F.sum("row_count").alias("total_rows"), F.max_by("table_name", F.struct("row_count", "table_name")).alias("largest_table"))
    return out.join(F.broadcast(total))

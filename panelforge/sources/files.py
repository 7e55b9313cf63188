"""Sources and sinks.

All readers return lazy DataFrames; all writers are plain DataFrameWriter
calls, so a cluster writes them in parallel, one file per task.
"""
from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..conf import RunConfig
from ..functions.prefix import join_groups
from ..session import cut_lineage

IMPORTANCE_SCHEMA = T.StructType([T.StructField("feature", T.StringType()),
                                  T.StructField("importance", T.DoubleType())])


# -- S1 ---------------------------------------------------------------------
def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan; a missing path is an error, not an empty frame."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            raise FileNotFoundError(f"table not found: {path}") from e
        raise
    return df.select(*columns) if columns else df


# -- S2 ---------------------------------------------------------------------
def read_wide(spark: SparkSession, path: str, sample_rows: int = 0, key: str = "HHIDPN",
              fmt: str = "parquet") -> DataFrame:
    """Wide file, optionally limited to the first ``sample_rows`` subjects.

    "First" is by key (file order is not stable in a distributed scan); the
    plan is a TakeOrderedAndProject, i.e. a per-task top-n then one merge.
    0 means all rows.
    """
    reader = spark.read.option("header", "true").option("inferSchema", "true") if fmt == "csv" \
        else spark.read
    df = reader.format(fmt).load(path)
    if sample_rows and sample_rows > 0:
        df = df.orderBy(key).limit(sample_rows)
    return df


# -- S3 ---------------------------------------------------------------------
def table_size(spark: SparkSession, path: str, sample_rows: int = 0) -> DataFrame:
    """Rows in the file (footer count), rows a sample would use and its share."""
    n = F.count(F.lit(1))
    used = n if not sample_rows else F.least(n, F.lit(sample_rows).cast("long"))
    return (read_table(spark, path).agg(n.alias("total_rows"), used.alias("used_rows"))
            .withColumn("pct_used", F.round(F.try_divide(F.col("used_rows") * 100.0,
                                                         F.col("total_rows")), 2)))


# -- S4 ---------------------------------------------------------------------
def read_importances(spark: SparkSession, path: str) -> DataFrame:
    """Importance CSV with a ``feature`` and an ``importance`` column."""
    df = spark.read.option("header", "true").csv(path)
    missing = {"feature", "importance"} - set(df.columns)
    if missing:
        raise ValueError(f"importances file lacks columns {sorted(missing)}: {df.columns}")
    return df.select(F.col("feature"), F.col("importance").cast("double"),
                     *[c for c in df.columns if c not in ("feature", "importance")])


# -- S5 ---------------------------------------------------------------------
def read_runs(spark: SparkSession, path: str, schema: T.StructType, skip: str = r"(^|/)summary\.json$",
              glob: str | None = "*.json", multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nested run records, one per JSON file by default, as (records, rejects).

    Files whose path matches ``skip`` are left out.  Records that don't parse go
    to ``rejects`` (path, reason), where ``reason`` holds the text.  The files
    are parsed once, with the given schema (no inference pass).
    """
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    reader = (spark.read.schema(full).option("multiLine", str(multiline).lower()).option("mode", "PERMISSIVE")
              .option("recursiveFileLookup", "true"))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.json(path).withColumn("_file", F.col("_metadata.file_path"))
    df = cut_lineage(df.filter(~F.col("_file").rlike(skip)), "run-records")
    return (df.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record"),
            df.filter(F.col("_corrupt_record").isNotNull()).select(
                F.col("_file").alias("path"), F.col("_corrupt_record").alias("reason")))


# -- S6 ---------------------------------------------------------------------
def read_feature_list(spark: SparkSession, path: str) -> DataFrame:
    """One feature per line; surrounding blanks trimmed, empty lines dropped."""
    return (spark.read.text(path).select(F.trim("value").alias("feature"),
                                         F.col("_metadata.file_path").alias("_path"))
            .filter(F.col("feature") != "").drop("_path"))


# -- S7 ---------------------------------------------------------------------
# <experiment>/<run>/(metrics|params)/<key>, also as Hive-style folders
# (experiment=../run_id=../kind=../key=../part-*) written by partitionBy.
TRACKING_PATH = (r"(?:[^/=]+=)?([^/]+)/(?:[^/=]+=)?([^/]+)/(?:kind=)?(metrics|params)/"
                 r"(?:key=)?([^/]+?)(?:/part-[^/]*)?$")
TRACKING_NAMES = ["experiment", "run_id", "kind", "key"]
# folder of packed logs: lines of many logs in few files, each with the path of its log
PACKED = "packed-logs"
PACKED_LINE = "log string, line string"


def read_tracking(spark: SparkSession, root: str) -> DataFrame:
    """File-per-metric tracking tree to a tidy table.

    Layout ``<experiment>/<run>/metrics/<key>`` with lines ``ts value step``
    and ``<experiment>/<run>/params/<key>`` holding the value; logs that were
    packed (``pack_tracking``) are read from their folder alike.  Output:
    (experiment, run_id, kind, key, ts, value, step, text).  Parts of a metric
    line that are missing or don't parse are NULL.
    """
    raw = (spark.read.option("recursiveFileLookup", "true").text(root)
           .select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path")))
    packed = F.col("path").rlike(f"/{PACKED}/part-[^/]*$")
    raw = raw.withColumn("said", F.when(packed, F.from_json("line", PACKED_LINE))).select(
        F.when(packed, F.col("said.line")).otherwise(F.col("line")).alias("line"),
        F.when(packed, F.col("said.log")).otherwise(F.col("path")).alias("path"))
    parts = [F.regexp_extract("path", TRACKING_PATH, i) for i in range(1, 5)]
    tok = F.split(F.trim("line"), r"\s+")
    is_metric = parts[2] == "metrics"
    return (raw.filter(F.trim("line") != "")
            .select(parts[0].alias("experiment"), parts[1].alias("run_id"),
                    parts[2].alias("kind"), parts[3].alias("key"),
                    F.when(is_metric, F.timestamp_millis(F.get(tok, 0).try_cast("long"))).alias("ts"),
                    F.when(is_metric, F.get(tok, 1).try_cast("double")).alias("value"),
                    F.when(is_metric, F.get(tok, 2).try_cast("long")).alias("step"),
                    F.when(~is_metric, F.col("line")).alias("text"))
            .filter(F.col("kind") != ""))


def pack_tracking(logs: DataFrame, root: str) -> str:
    """Append the lines of ``logs`` (experiment, run_id, kind, key, value) to the packed logs of ``root``: a file
    a task, however many runs and keys there are.  A NULL or empty name is written as in the tree."""
    names = [F.when(F.col(c) != "", F.replace(F.col(c), F.lit("/"), F.lit("%2F"))).otherwise("__HIVE_DEFAULT_PARTITION__")
             for c in TRACKING_NAMES]
    path = F.concat_ws("/", *[F.concat(F.lit(f"{c}="), n) for c, n in zip(TRACKING_NAMES, names)])
    lines = logs.select(path.alias("log"), F.explode(F.split("value", "\r\n|\r|\n")).alias("line"))
    lines.select(F.to_json(F.struct("log", "line"))).write.mode("append").text(f"{root}/{PACKED}")
    return root


def tracking_runs(tidy: DataFrame, metric_keys: list[str] | None = None) -> DataFrame:
    """One row per run: last logged value of each metric as a column."""
    metrics = (tidy.filter(F.col("kind") == "metrics")
               .groupBy("experiment", "run_id", "key")
               .agg(F.max_by("value", F.struct("ts", "step")).alias("value")))
    return metrics.groupBy("experiment", "run_id").pivot("key", metric_keys).agg(F.first("value"))


# -- S8 ---------------------------------------------------------------------
def discover(spark: SparkSession, pattern: str, by: str = "mtime", group_regex: str | None = None,
             skip: str | None = None, prefer: list[str] | None = None) -> DataFrame:
    """Pick one file per group: the newest (``by="mtime"``) or largest (``by="size"``).

    Lists files with the binary-file source without reading their content.
    ``group_regex``'s first group names the group; otherwise one group.  Paths
    that match ``skip`` are left out; paths that match an earlier pattern of
    ``prefer`` go before all others.
    """
    files = (spark.read.format("binaryFile").load(pattern)
             .select("path", "modificationTime", "length"))
    if skip:
        files = files.filter(~F.col("path").rlike(skip))
    first = F.lit(0)
    for rank, p in enumerate(reversed(prefer or []), 1):
        first = F.when(F.col("path").rlike(p), rank).otherwise(first)
    order = F.col("modificationTime") if by == "mtime" else F.col("length")
    grp = (F.regexp_extract("path", group_regex, 1) if group_regex else F.lit("all")).alias("grp")
    return (files.groupBy(grp)
            .agg(F.max_by("path", F.struct(first.alias("first"), order.alias("order"), F.col("path"))).alias("path"),
                 F.count(F.lit(1)).alias("n_files")))


# -- S9 - S11 ---------------------------------------------------------------
def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).option("header", "true").csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).json(path)
    return path


# -- S12 --------------------------------------------------------------------
RUN_LOG_SCHEMA = "experiment string, run_id string, kind string, key string, " \
                 "value double, text string, logged_at timestamp"
#: what a commit replaces: all records of one kind of a run
RUN_LOG_UNIT = ["experiment", "run_id", "kind"]


def commit_records(records: DataFrame, root: str, unit: list[str]) -> str:
    """Write ``records`` once, in a folder of their own, then commit what they hold: one row for each distinct
    ``unit``.  Records without a commit, of an attempt that died, are never read; a later commit of
    a unit replaces the earlier one.  Attempts never touch each other's files, so writers need no lock."""
    spark = records.sparkSession
    attempt = uuid.uuid4().hex
    records.write.parquet(f"{root}/attempts/attempt={attempt}")
    held = spark.read.schema(records.schema).parquet(f"{root}/attempts/attempt={attempt}")
    commits = held.select(*unit).distinct().withColumns({"attempt": F.lit(attempt), "committed_at": F.lit(time.time_ns())})
    commits.write.parquet(f"{root}/commits/attempt={attempt}_")
    return root


def read_committed(spark: SparkSession, root: str, schema: str, unit: list[str]) -> DataFrame:
    """The records of the last commit of each unit; no rows if nothing was committed."""
    kinds = spark.createDataFrame([], schema)
    marks = T.StructType([kinds.schema[c] for c in unit] + [T.StructField("attempt", T.StringType()), T.StructField("committed_at", T.LongType())])
    try:
        commits = spark.read.schema(marks).parquet(f"{root}/commits/attempt=*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return kinds
        raise
    last = commits.groupBy(*unit).agg(F.max_by("attempt", F.struct("committed_at", "attempt")).alias("_attempt"))
    records = spark.read.schema(kinds.schema).parquet(f"{root}/attempts/attempt=*").withColumn(
        "_attempt", F.regexp_extract(F.col("_metadata.file_path"), r"/attempt=([0-9a-f]+)/", 1))
    return join_groups(records, last, [*unit, "_attempt"]).drop("_attempt")


def log_run(records: DataFrame, root: str) -> str:
    """Commit tidy run records (see ``RUN_LOG_SCHEMA``).  Logging a run again replaces its records
    of the kinds that are logged, so a run that is retried reads back once."""
    cols = [c.split()[0] for c in RUN_LOG_SCHEMA.split(", ")]
    return commit_records(records.select(*cols), root, RUN_LOG_UNIT)


def read_run_log(spark: SparkSession, root: str) -> DataFrame:
    return read_committed(spark, root, RUN_LOG_SCHEMA, RUN_LOG_UNIT)


# -- E7 ---------------------------------------------------------------------
def read_run_config(spark: SparkSession, path: str) -> RunConfig:
    """A run's configuration from a YAML or JSON file, read through Spark's file systems: ``target_suffix``,
    ``model`` (``type``, ``params``), ``feature_columns``, ``sample_fraction``, ``sample_rows``, ``weighting``."""
    files = spark.read.text(path, wholetext=True).collect()
    if len(files) != 1:
        raise ValueError(f"{path} must be one file, not {len(files)}")
    try:
        said = json.loads(files[0]["value"])
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path} is no JSON, and there is no YAML reader") from e
        said = yaml.safe_load(files[0]["value"])
    if not isinstance(said, dict):
        raise ValueError(f"{path} holds no mapping")
    return RunConfig.from_mapping(said)

"""Queries: sources and sinks.

File-based sources first write their input with Spark into a fresh folder
under the shared checkpoint folder, then read it back.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.prefix import join_groups
from ..session import cut_lineage, scratch_path
from ..sources import files as IO
from . import fixtures as fx
from .q_panel import oracle, rnd
from .q_runs import rsql
from .registry import query


@query("scan_parquet", "SELECT * FROM customer")
def q_scan_parquet(spark, sf):
    return IO.read_table(spark, f"{sf}/customer.parquet")


@query("scan_limited", "SELECT * FROM customer ORDER BY c_custkey LIMIT 100")
def q_scan_limited(spark, sf):
    return IO.read_wide(spark, f"{sf}/customer.parquet", sample_rows=100, key="c_custkey")


@query("source_coverage", """
    SELECT count(*) AS total_rows, least(count(*), 1000) AS used_rows,
           round(100.0 * least(count(*), 1000) / count(*), 2)::DOUBLE AS pct_used FROM orders""")
def q_source_coverage(spark, sf):
    return IO.table_size(spark, f"{sf}/orders.parquet", sample_rows=1000)


@query("sink_roundtrip", oracle(["model"], "SELECT * FROM model"))
def q_sink_roundtrip(spark, sf):
    path = IO.write_table(fx.model(spark, sf), scratch_path(spark, "model"), partition_by=["wave"])
    return IO.read_table(spark, path)


@query("scan_importances", oracle(["importances"], "SELECT * FROM importances"))
def q_scan_importances(spark, sf):
    path = IO.write_csv(fx.importances(spark, sf), scratch_path(spark, "importances"))
    return IO.read_importances(spark, path)


@query("feature_manifest", oracle(["importances"],
                                  "SELECT feature, 'feature' AS role, 'importances' AS source FROM importances"))
def q_feature_manifest(spark, sf):
    from ..operators.columns import manifest
    path = IO.write_csv(manifest(fx.importances(spark, sf), "feature", "importances"),
                        scratch_path(spark, "manifest"))
    return spark.read.option("header", "true").csv(path)


@query("scan_feature_list", oracle(["importances"], "SELECT feature FROM importances"))
def q_scan_feature_list(spark, sf):
    imp = fx.importances(spark, sf)
    lines = imp.select(F.concat(F.lit("  "), F.col("feature"), F.lit(" ")).alias("value"))
    blanks = imp.select("grp").distinct().select(F.lit("   ").alias("value"))
    path = scratch_path(spark, "features")
    lines.unionByName(blanks).write.text(path)
    return IO.read_feature_list(spark, path)


def _run_summary(spark, sf):
    from ..operators.runs import aggregate_metrics
    return aggregate_metrics(fx.runs(spark, sf))


_REC_COLS = ["mean_roc_auc", "mean_pr_auc", "mean_f2_score", "std_roc_auc", "training_time_sec"]


@query("scan_run_records", rsql("""
    SELECT run_id AS experiment_name, family, dropout, optimizer, loss, use_smote, mean_roc_auc, mean_pr_auc,
           mean_f2_score, std_roc_auc, training_time_sec, 1 AS n_rejects FROM rs""", _REC_COLS))
def q_scan_run_records(spark, sf):
    """The newest run of each experiment has a file of its own, the others' records are lines of shared files."""
    from ..operators.runs import latest_run
    s = cut_lineage(_run_summary(spark, sf), "summary")
    newest = latest_run(s).select("experiment", "run_id", F.lit(True).alias("_newest"))
    rec = join_groups(s, newest, ["experiment", "run_id"], "left").select(
        F.col("run_id").alias("experiment_name"), F.col("run_id").alias("_run"), "_newest",
        F.struct(F.col("family").alias("type"), F.col("family").alias("name")).alias("architecture"),
        F.struct("dropout").alias("regularization"), F.struct("optimizer").alias("optimization"),
        F.struct("loss", "use_smote").alias("imbalance"),
        F.struct("mean_roc_auc", "mean_pr_auc", "mean_f2_score", "std_roc_auc").alias("aggregate_metrics"),
        "training_time_sec")
    root = scratch_path(spark, "runs_json")
    rec.filter("_newest").drop("_newest").write.partitionBy("_run").json(f"{root}/records")
    lines = f"{root}-lines"
    rec.filter("_newest IS NULL").drop("_run", "_newest").write.json(lines)
    s.agg(F.count(F.lit(1)).alias("n_runs")).write.json(f"{root}/summary")
    spark.createDataFrame([("{not json",)], "value string").write.text(f"{root}/broken")
    schema = rec.drop("_run", "_newest").schema
    good, bad = IO.read_runs(spark, root, schema, skip=r"/summary/", glob=None)
    more, worse = IO.read_runs(spark, lines, schema, skip=r"/summary/", glob=None, multiline=False)
    good, bad = good.unionByName(more), bad.unionByName(worse)
    flat = good.select("experiment_name", F.col("architecture.name").alias("family"), "regularization.dropout",
                       "optimization.optimizer", "imbalance.loss", "imbalance.use_smote", "aggregate_metrics.*", "training_time_sec")
    return rnd(flat.crossJoin(bad.agg(F.count("path").alias("n_rejects"))), _REC_COLS)   # one row of rejects


def _tracking(spark, sf):
    """The newest run of each experiment logs to a tree of its own files, the others' logs are packed."""
    from ..operators.runs import latest_run
    r = cut_lineage(fx.runs(spark, sf), "runs")
    newest = latest_run(r).select("experiment", "run_id", F.lit(True).alias("newest"))
    ms = F.unix_millis(F.col("start_time").cast("timestamp"))
    metrics = r.select("experiment", "run_id", F.lit("metrics").alias("kind"),
                       F.concat(F.col("task"), F.lit("_roc_auc")).alias("key"),
                       F.concat_ws(" ", ms.cast("string"), F.col("roc").cast("string"), F.lit("0")).alias("value"))
    params = r.select("experiment", "run_id", F.lit("params").alias("kind"), F.lit("dropout").alias("key"),
                      F.col("dropout").cast("string").alias("value")).distinct()
    root = scratch_path(spark, "tracking")
    logs = cut_lineage(join_groups(metrics.unionByName(params), newest, ["experiment", "run_id"], "left"), "logs")
    logs.filter("newest").drop("newest").write.partitionBy("experiment", "run_id", "kind", "key").text(root)
    IO.pack_tracking(logs.filter("newest IS NULL"), root)
    return IO.read_tracking(spark, root)


@query("scan_tracking", oracle(["runs"], """
    SELECT experiment, run_id, 'metrics' AS kind, task || '_roc_auc' AS key, epoch_us(start_time) // 1000 AS ts_ms,
           roc AS value, CAST(0 AS BIGINT) AS step, NULL AS text FROM runs
    UNION ALL
    SELECT DISTINCT experiment, run_id, 'params', 'dropout', CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE),
           CAST(NULL AS BIGINT), CAST(dropout AS VARCHAR) FROM runs"""))
def q_scan_tracking(spark, sf):
    t = _tracking(spark, sf)
    return t.withColumn("ts_ms", F.unix_millis("ts")).drop("ts")


_EVENT_KEYS = ["CLICK", "ERROR", "PURCHASE", "SIGNUP", "VIEW"]


@query("tracking_runs", oracle(["runs"], "SELECT experiment, run_id, " + ", ".join(
    f"max(CASE WHEN task = '{k}' THEN roc END) AS {k}_roc_auc" for k in _EVENT_KEYS) + " FROM runs GROUP BY 1, 2"))
def q_tracking_runs(spark, sf):
    return IO.tracking_runs(_tracking(spark, sf), [f"{k}_roc_auc" for k in _EVENT_KEYS])


@query("tracking_best_run", rsql("""
    SELECT experiment, arg_min(run_id, {'m': -best, 'r': run_id}) AS run_id, max(best) AS best FROM (
      SELECT experiment, run_id, max(roc) AS best FROM runs GROUP BY 1, 2) q GROUP BY 1"""))
def q_tracking_best_run(spark, sf):
    """Run lookup from the tracking files: pivot, then the best run of each experiment."""
    from ..operators.runs import best_run
    wide = IO.tracking_runs(_tracking(spark, sf), [f"{k}_roc_auc" for k in _EVENT_KEYS])
    best = F.greatest(*[F.col(f"{k}_roc_auc") for k in _EVENT_KEYS])
    return best_run(wide.withColumn("best", best).withColumn("error", F.lit(None).cast("string")), "best")


def _generations(spark, sf):
    """One importance file a group in each of four generations, the newest written last."""
    root = scratch_path(spark, "imp_by_grp")
    imp = fx.importances(spark, sf).repartition("grp")
    for name, pad in (("config", 0), ("old", 200), ("new", 0), ("multi_new", 400)):
        (imp.withColumn("generation", F.lit(name)).withColumn("pad", F.repeat(F.lit("x"), pad))
         .write.mode("append").partitionBy("grp", "generation").option("header", "true").csv(root))
    return f"{root}/*/*/*.csv"


_GEN = r"generation=([^/]+)/"


def _discovered(found):
    return found.select(F.url_decode("grp").alias("grp"), F.regexp_extract("path", _GEN, 1).alias("generation"), "n_files")


def _discover_sql(generation, n):
    return f"SELECT DISTINCT p_brand AS grp, '{generation}' AS generation, {n} AS n_files FROM part"


@query("discover_latest", _discover_sql("new", 3))
def q_discover_latest(spark, sf):
    return _discovered(IO.discover(spark, _generations(spark, sf), "mtime", r"grp=([^/]+)/", skip=r"generation=multi_"))


@query("discover_largest", _discover_sql("multi_new", 4))
def q_discover_largest(spark, sf):
    return _discovered(IO.discover(spark, _generations(spark, sf), "size", r"grp=([^/]+)/"))


@query("discover_config_first", _discover_sql("config", 4))
def q_discover_config_first(spark, sf):
    return _discovered(IO.discover(spark, _generations(spark, sf), "size", r"grp=([^/]+)/", prefer=["generation=config/", "generation=new/"]))


@query("sink_json_roundtrip", oracle(["runs"], "SELECT run_id, task, roc, pr, f2 FROM runs"))
def q_sink_json_roundtrip(spark, sf):
    r = fx.runs(spark, sf)
    nested = r.groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(F.struct("task", F.struct("roc", "pr", "f2")))).alias("per_task"))
    path = IO.write_json(nested, scratch_path(spark, "nested"))
    back = spark.read.schema(nested.schema).json(path)
    return back.select("run_id", F.explode("per_task").alias("task", "m")).select("run_id", "task", "m.*")


@query("run_log_append", oracle(["runs"], """
    SELECT experiment, run_id, 'metrics' AS kind, task || '_roc_auc' AS key, roc AS value, NULL AS text FROM runs
    UNION ALL SELECT DISTINCT experiment, run_id, 'params', 'loss', CAST(NULL AS DOUBLE), loss FROM runs"""))
def q_run_log_append(spark, sf):
    r = fx.runs(spark, sf)
    now = F.current_timestamp()
    params = r.select("experiment", "run_id", F.lit("params").alias("kind"), F.lit("loss").alias("key"),
                      F.lit(None).cast("double").alias("value"), F.col("loss").alias("text"),
                      now.alias("logged_at")).distinct()
    metrics = r.select("experiment", "run_id", F.lit("metrics").alias("kind"),
                       F.concat(F.col("task"), F.lit("_roc_auc")).alias("key"), F.col("roc").alias("value"),
                       F.lit(None).cast("string").alias("text"), now.alias("logged_at"))
    root = scratch_path(spark, "run_log")
    IO.log_run(params, root)
    IO.log_run(metrics, root)
    return IO.read_run_log(spark, root).drop("logged_at")


@query("run_log_retried", oracle(["runs"], """
    SELECT experiment, run_id, 'metrics' AS kind, task || '_roc_auc' AS key, roc AS value, NULL AS text FROM runs"""))
def q_run_log_retried(spark, sf):
    """Every run logged twice, half of them a third time, and an attempt that died before its commit: each reads back once."""
    metrics = fx.runs(spark, sf).select("experiment", "run_id", F.lit("metrics").alias("kind"), F.concat(F.col("task"), F.lit("_roc_auc")).alias("key"),
                                        F.col("roc").alias("value"), F.lit(None).cast("string").alias("text"), F.current_timestamp().alias("logged_at"))
    root = scratch_path(spark, "run_log")
    IO.log_run(metrics.withColumn("value", F.col("value") - 1), root)
    IO.log_run(metrics, root)
    IO.log_run(metrics.filter(F.pmod(F.xxhash64("run_id"), F.lit(2)) == 0), root)
    metrics.withColumn("value", F.lit(-1.0)).write.parquet(f"{root}/attempts/attempt=0")
    return IO.read_run_log(spark, root).drop("logged_at")

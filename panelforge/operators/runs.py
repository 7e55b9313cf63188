"""Experiment-run analytics.

Input is the long run table: one row per (run, task) with metrics, run
attributes (experiment, start_time, family, parameters, time, error).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUN_ATTRS = ["run_id", "experiment", "start_time", "family", "dropout", "optimizer", "loss",
             "use_smote", "error"]
PARAMS = ["dropout", "optimizer", "loss", "use_smote"]


def aggregate_metrics(runs: DataFrame, attrs: list[str] = RUN_ATTRS) -> DataFrame:
    """Per run: mean ROC / PR / F2 over its tasks, population std of ROC,
    total time and task count."""
    present = [a for a in attrs if a in runs.columns]
    return runs.groupBy(*present).agg(
        F.avg("roc").alias("mean_roc_auc"), F.avg("pr").alias("mean_pr_auc"),
        F.avg("f2").alias("mean_f2_score"), F.stddev_pop("roc").alias("std_roc_auc"),
        F.sum("time_sec").alias("training_time_sec"), F.count(F.lit(1)).alias("n_tasks"))


def successful(summary: DataFrame) -> DataFrame:
    return summary.filter(F.col("error").isNull()) if "error" in summary.columns else summary


def runs_by_family(summary: DataFrame, by: str = "family") -> DataFrame:
    """Mean / sample std / max of the three run-level metrics, mean time."""
    aggs = []
    for m in ("mean_roc_auc", "mean_pr_auc", "mean_f2_score"):
        aggs += [F.round(F.avg(m), 4).alias(f"{m}_mean"), F.round(F.stddev_samp(m), 4).alias(f"{m}_std"),
                 F.round(F.max(m), 4).alias(f"{m}_max")]
    aggs.append(F.round(F.avg("training_time_sec"), 4).alias("training_time_sec_mean"))
    return successful(summary).groupBy(by).agg(*aggs)


def param_impact(summary: DataFrame, params: list[str] = PARAMS,
                 metric: str = "mean_roc_auc") -> DataFrame:
    """Per parameter and value: mean, sample std and count of ``metric``;
    parameters with a single value are left out."""
    present = [p for p in params if p in summary.columns]
    body = ", ".join(f"'{p}', CAST(`{p}` AS STRING)" for p in present)
    long = successful(summary).selectExpr(f"`{metric}` AS _m",
                                          f"stack({len(present)}, {body}) AS (param, value)")
    g = long.groupBy("param", "value").agg(
        F.avg("_m").alias("mean"), F.stddev_samp("_m").alias("std"), F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("param")
    return (g.withColumn("_k", F.count(F.lit(1)).over(w)).filter(F.col("_k") > 1).drop("_k"))


def per_task_best(runs: DataFrame) -> DataFrame:
    """Per task over successful runs: best run by ROC (ties: smallest run
    id), its ROC, the mean and population std of ROC."""
    ok = successful(runs)
    return ok.groupBy("task").agg(
        F.min_by("run_id", F.struct(-F.col("roc"), F.col("run_id"))).alias("best_run"),
        F.max("roc").alias("best_roc_auc"), F.avg("roc").alias("mean_roc_auc"),
        F.stddev_pop("roc").alias("std_roc_auc"), F.count(F.lit(1)).alias("n_runs"))


def latest_run(summary: DataFrame, by: str = "experiment", time: str = "start_time") -> DataFrame:
    """The newest run of each group (ties: largest run id)."""
    return summary.groupBy(by).agg(
        F.max_by("run_id", F.struct(F.col(time), F.col("run_id"))).alias("run_id"),
        F.max(time).alias(time))


def best_run(summary: DataFrame, metric: str = "mean_roc_auc", by: str = "experiment") -> DataFrame:
    """The successful run with the highest ``metric`` per group (ties: smallest id)."""
    return successful(summary).groupBy(by).agg(
        F.min_by("run_id", F.struct(-F.col(metric), F.col("run_id"))).alias("run_id"),
        F.max(metric).alias(metric))


def leaderboard(summary: DataFrame, metric: str = "mean_roc_auc", k: int = 10,
                cols: list[str] | None = None) -> DataFrame:
    """Top-k successful runs by ``metric`` (ties by run id) with their rank.
    A distributed top-k; the numbering then runs over k rows only."""
    top = successful(summary).orderBy(F.desc(metric), F.asc("run_id")).limit(k)
    out = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(metric), F.asc("run_id"))))
    return out.select("rank", "run_id", metric, *(cols or []))


def per_task_metrics(runs: DataFrame, where=None, metrics=("roc", "pr", "f2")) -> DataFrame:
    """Mean metric per task over the selected successful runs."""
    ok = successful(runs)
    if where is not None:
        ok = ok.filter(where)
    return ok.groupBy("task").agg(*[F.avg(m).alias(m) for m in metrics])

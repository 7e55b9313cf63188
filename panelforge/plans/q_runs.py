"""Queries: experiment-run analytics."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import runs as RU
from . import fixtures as fx
from .q_panel import rnd
from .registry import query

_RS = """
    rs AS (SELECT run_id, experiment, start_time, family, dropout, optimizer, loss, use_smote, error,
                  avg(roc) AS mean_roc_auc, avg(pr) AS mean_pr_auc, avg(f2) AS mean_f2_score,
                  stddev_pop(roc) AS std_roc_auc, sum(time_sec) AS training_time_sec, count(*) AS n_tasks
           FROM runs GROUP BY ALL),
    ok AS (SELECT * FROM rs WHERE error IS NULL)"""


def rsql(body: str, round_cols=(), extra: str = "") -> str:
    head = fx.with_ctes("runs").rstrip() + "," + _RS + (("," + extra) if extra else "") + "\n"
    if not round_cols:
        return head + body
    rep = ", ".join(f"round({c}, 6) AS {c}" for c in round_cols)
    return head + f"SELECT * REPLACE ({rep}) FROM ({body}) q"


def _summary(spark, sf):
    return RU.aggregate_metrics(fx.runs(spark, sf))


_AGG_COLS = ["mean_roc_auc", "mean_pr_auc", "mean_f2_score", "std_roc_auc", "training_time_sec"]


@query("aggregate_metrics", rsql("SELECT * FROM rs", _AGG_COLS))
def q_aggregate_metrics(spark, sf):
    return rnd(_summary(spark, sf), _AGG_COLS)


_FAM_AGGS = ", ".join(
    f"round(avg({m}), 4) AS {m}_mean, round(stddev_samp({m}), 4) AS {m}_std, round(max({m}), 4) AS {m}_max"
    for m in ("mean_roc_auc", "mean_pr_auc", "mean_f2_score"))


@query("runs_by_family", rsql(f"SELECT family, {_FAM_AGGS}, round(avg(training_time_sec), 4) AS training_time_sec_mean "
                              "FROM ok GROUP BY family"))
def q_runs_by_family(spark, sf):
    return RU.runs_by_family(_summary(spark, sf))


_PARAM_SQL = " UNION ALL ".join(
    f"SELECT '{p}' AS param, CAST({p} AS VARCHAR) AS value, mean_roc_auc AS m FROM ok"
    for p in RU.PARAMS)


@query("param_impact", rsql(f"""
    SELECT param, value, avg(m) AS mean, stddev_samp(m) AS std, count(*) AS count
    FROM ({_PARAM_SQL}) l
    WHERE param IN (SELECT param FROM ({_PARAM_SQL}) l2 GROUP BY param HAVING count(DISTINCT value) > 1)
    GROUP BY param, value""", ["mean", "std"]))
def q_param_impact(spark, sf):
    return rnd(RU.param_impact(_summary(spark, sf)), ["mean", "std"])


@query("per_task_best", rsql("""
    SELECT task, arg_min(run_id, (-roc, run_id)) AS best_run, max(roc) AS best_roc_auc,
           avg(roc) AS mean_roc_auc, stddev_pop(roc) AS std_roc_auc, count(*) AS n_runs
    FROM runs WHERE error IS NULL GROUP BY task""", ["mean_roc_auc", "std_roc_auc"]))
def q_per_task_best(spark, sf):
    return rnd(RU.per_task_best(fx.runs(spark, sf)), ["mean_roc_auc", "std_roc_auc"])


@query("latest_run", rsql("""
    SELECT experiment, arg_max(run_id, (start_time, run_id)) AS run_id, max(start_time) AS start_time
    FROM rs GROUP BY experiment"""))
def q_latest_run(spark, sf):
    return RU.latest_run(_summary(spark, sf))


@query("best_run", rsql("""
    SELECT experiment, arg_min(run_id, (-mean_roc_auc, run_id)) AS run_id, max(mean_roc_auc) AS mean_roc_auc
    FROM ok GROUP BY experiment""", ["mean_roc_auc"]))
def q_best_run(spark, sf):
    return rnd(RU.best_run(_summary(spark, sf)), ["mean_roc_auc"])


@query("leaderboard", rsql("""
    SELECT row_number() OVER (ORDER BY mean_roc_auc DESC, run_id) AS rank, run_id, mean_roc_auc
    FROM ok ORDER BY mean_roc_auc DESC, run_id LIMIT 10""", ["mean_roc_auc"]))
def q_leaderboard(spark, sf):
    out = RU.leaderboard(_summary(spark, sf), "mean_roc_auc", 10)
    return rnd(out.withColumn("rank", F.col("rank").cast("long")), ["mean_roc_auc"])


_CMP = """
    a AS (SELECT task, avg(roc) AS roc, avg(pr) AS pr FROM runs WHERE error IS NULL AND NOT use_smote GROUP BY task),
    b AS (SELECT task, avg(roc) AS roc, avg(pr) AS pr FROM runs WHERE error IS NULL AND use_smote GROUP BY task),
    cmp AS (SELECT a.task, a.roc AS multi_roc, a.pr AS multi_pr, b.roc AS single_roc, b.pr AS single_pr,
                   a.roc - b.roc AS roc_diff,
                   CASE WHEN b.roc IS NULL THEN NULL WHEN b.roc > 0 THEN (a.roc - b.roc) / b.roc * 100 ELSE 0.0 END AS roc_pct,
                   a.pr - b.pr AS pr_diff,
                   CASE WHEN b.pr IS NULL THEN NULL WHEN b.pr > 0 THEN (a.pr - b.pr) / b.pr * 100 ELSE 0.0 END AS pr_pct
            FROM a LEFT JOIN b ON a.task = b.task)"""
_CMP_COLS = ["multi_roc", "multi_pr", "single_roc", "single_pr", "roc_diff", "roc_pct", "pr_diff", "pr_pct"]


def _compare(spark, sf):
    r = fx.runs(spark, sf)
    a = RU.per_task_metrics(r, ~F.col("use_smote"), ("roc", "pr"))
    b = RU.per_task_metrics(r, F.col("use_smote"), ("roc", "pr"))
    return J.compare_runs(a, b, "task", ("roc", "pr"))


@query("compare_runs", rsql("SELECT * FROM cmp", _CMP_COLS, extra=_CMP))
def q_compare_runs(spark, sf):
    return rnd(_compare(spark, sf), _CMP_COLS)


@query("improvement_summary", rsql("""
    SELECT avg(roc_pct) AS mean_roc_pct, count(*) FILTER (WHERE roc_diff > 0) AS roc_better,
           avg(pr_pct) AS mean_pr_pct, count(*) FILTER (WHERE pr_diff > 0) AS pr_better,
           count(roc_diff) AS total FROM cmp""", ["mean_roc_pct", "mean_pr_pct"], extra=_CMP))
def q_improvement_summary(spark, sf):
    return rnd(J.improvement_summary(_compare(spark, sf)), ["mean_roc_pct", "mean_pr_pct"])


FEATURE_SETS = ["top8", "top50", "min_imp_5", "all", "temporal_only", "top50_plus_temporal"]
_FS_SQL = ", ".join(f"'{s}'" for s in FEATURE_SETS)


@query("experiment_grid", rsql(f"""
    SELECT m.family AS model, f.feature_set, s.use_smote,
           m.family || '_' || f.feature_set || '_' || CASE WHEN s.use_smote THEN 'smote' ELSE 'nosmote' END AS experiment
    FROM (SELECT DISTINCT family FROM runs) m, (SELECT unnest([{_FS_SQL}]) AS feature_set) f,
         (SELECT unnest([false, true]) AS use_smote) s"""))
def q_experiment_grid(spark, sf):
    models = fx.runs(spark, sf).select(F.col("family").alias("model"))
    return J.experiment_grid(models, FEATURE_SETS)

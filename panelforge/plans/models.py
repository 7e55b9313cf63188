"""Model jobs on Spark ML.

The original trains single-machine learners (scikit-learn, LightGBM,
XGBoost, CatBoost, PyTorch).  Here every fit is a distributed Spark ML
estimator on the keyed model table:

* lr  -> LogisticRegression on standardised complete cases, balanced weights
* rf  -> RandomForestClassifier (50 trees, depth 6), complete cases, balanced
* gbt -> GBTClassifier with early stopping on an inner validation wave taken
         from the training waves (no peeking at the reported split); missing
         values become 0 plus a missing-indicator column
* mlp -> MultilayerPerceptronClassifier on zero-filled standardised features

Validation scores are evaluated with the exact metrics of
``functions.metrics``.
"""
from __future__ import annotations

import hashlib
import json
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conf import RANDOM_STATE, RunConfig, SplitSpec
from ..functions import metrics as M
from ..operators.balance import sample_fraction, sample_rows
from ..operators.columns import complete_cases
from ..operators.split import temporal_split
from ..session import cut_lineage, scratch_path
from ..sources import files as IO
from .shared_fit import fit_conditions, score_conditions

COMPLETE_CASE_MODELS = ("lr", "rf")


def _prepare(df: DataFrame, feats: list[str], label: str, model_type: str,
             spec: SplitSpec) -> tuple[DataFrame, list[str], list[str]]:
    """(rows, names, columns): labelled rows (id, wave, label, split, columns), missing handled per
    model type.  The columns are copies beside the keys, so scaling ``wave`` leaves the key ``wave``."""
    feats = list(dict.fromkeys(feats))
    d = df.filter(F.col(label).isNotNull()).withColumn("label", F.col(label).cast("int"))
    if model_type in COMPLETE_CASE_MODELS:
        d = complete_cases(d, feats)
    d = temporal_split(d, spec=spec)
    made = {c: F.col(c).cast("double") for c in feats}
    if model_type not in COMPLETE_CASE_MODELS:
        made = {c: F.coalesce(v, F.lit(0.0)) for c, v in made.items()}
    if model_type == "gbt":
        made |= {f"{c}_missing": F.col(c).isNull().cast("double") for c in feats}
    columns = [f"_x{i}" for i in range(len(made))]
    return d.select("id", "wave", "label", "split", *[v.alias(x) for x, v in zip(columns, made.values())]), list(made), columns


def _train_stats(d: DataFrame, columns: list[str]):
    """One pass over the training rows: their number, the positives, mean and population std of the columns
    (a std of 0 counts as 1)."""
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("pos")]
    for c in columns:
        aggs += [F.avg(c), F.stddev_pop(c)]
    r = d.filter(F.col("split") == "train").agg(*aggs).first()
    return r["n"], r["pos"], {c: (r[2 + 2 * i], r[3 + 2 * i] or 1.0) for i, c in enumerate(columns)}


def _weights(d: DataFrame, n: int, pos: int, mode: str) -> DataFrame:
    """Row weights of ``n`` training rows with ``pos`` positives."""
    if mode == "balanced":
        one, zero = n / (2 * pos) if pos else None, n / (2 * (n - pos)) if n > pos else None
    elif mode == "scale_pos_weight":
        one, zero = (n - pos) / pos if pos else 1.0, 1.0
    else:
        raise ValueError(f"unknown weighting: {mode}")
    return d.withColumn("weight", F.when(F.col("label") == 1, F.lit(one)).otherwise(F.lit(zero)).cast("double"))


def build_estimator(model_type: str, params: dict, weighted: bool):
    p = dict(params)
    if model_type == "lr":
        return LogisticRegression(maxIter=p.get("max_iter", 100), regParam=p.get("reg", 0.0),
                                  weightCol="weight" if weighted else None)
    if model_type == "rf":
        return RandomForestClassifier(numTrees=p.get("n_estimators", 50), maxDepth=p.get("max_depth", 6),
                                      seed=p.get("random_state", RANDOM_STATE),
                                      weightCol="weight" if weighted else None)
    if model_type == "gbt":
        return GBTClassifier(maxIter=p.get("n_estimators", 100), maxDepth=p.get("max_depth", 5),
                             stepSize=p.get("learning_rate", 0.1), seed=p.get("random_state", RANDOM_STATE),
                             validationIndicatorCol="_inner_val", validationTol=p.get("tol", 0.001),
                             weightCol="weight" if weighted else None)
    if model_type == "mlp":
        return MultilayerPerceptronClassifier(maxIter=p.get("max_iter", 100), seed=p.get("random_state", RANDOM_STATE),
                                              layers=p["layers"])
    raise ValueError(f"unknown model type: {model_type}")


def train_eval(df: DataFrame, feats: list[str], label: str, model_type: str = "gbt",
               params: dict | None = None, spec: SplitSpec = SplitSpec(), task: str | None = None,
               use_smote: bool = False, weighting: str = "balanced"):
    """Fit on the training waves, score the validation waves.

    ``use_smote`` adds synthetic minority rows to the training side only
    (a no-op when the minority share is already above the SMOTE ratio);
    ``weighting`` is "balanced" or "scale_pos_weight" (B4).
    Returns (model, used feature names, scored DataFrame (task, id, wave, label, prob)).
    """
    params = dict(params or {})
    base, used, columns = _prepare(df, feats, label, model_type, spec)
    base = base.persist()   # read for the statistics, the fit and the scores
    try:
        n, pos, moments = _train_stats(base, columns)
        if not n:
            raise ValueError(f"no training rows in waves {spec.train[0]}-{spec.train[1]}")
        d = base
        if model_type in ("lr", "mlp"):
            d = d.withColumns({c: (F.col(c) - m) / s for c, (m, s) in moments.items()})
        if use_smote:
            from ..operators.smote import smote
            tr = smote(d.filter(F.col("split") == "train").withColumn("task", F.lit("t")), columns).drop("task", "synthetic")
            tr = cut_lineage(tr, "smoted")
            n, pos, _ = _train_stats(tr, [])
            d = tr.unionByName(d.filter(F.col("split") == "val"))
        weighted = model_type in ("lr", "rf", "gbt")
        if weighted:
            d = _weights(d, n, pos, weighting)
        d = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(d)
        train = d.filter(F.col("split") == "train")
        if model_type == "gbt":
            # early stopping on the last training wave, never on the reported split
            train = train.withColumn("_inner_val", F.col("wave") == spec.train[1])
        if model_type == "mlp":
            params.setdefault("layers", [len(used)] + list(params.pop("hidden", [16, 8])) + [2])
        model = build_estimator(model_type, params, weighted).fit(train)
        val = d.filter(F.col("split") == "val")
        scored = (model.transform(val)
                  .select(F.lit(task or label).alias("task"), "id", "wave", "label",
                          vector_to_array("probability")[1].alias("prob")))
        scored = cut_lineage(scored, "scored")   # read for several metrics
    finally:
        base.unpersist()
    return model, used, scored


def metrics_row(scored: DataFrame) -> DataFrame:
    """F2 at 0.5, average precision, ROC-AUC and best observed F2 threshold; the curve points are
    built once."""
    pts = cut_lineage(M.curve_points(scored), "curve")
    roc, ap, _ = M._curve_aggs()
    curve = pts.groupBy("task").agg(
        F.when((F.first("P") > 0) & (F.first("N") > 0), roc).alias("ROC_AUC"),
        F.when(F.first("P") > 0, ap).alias("PR_AUC"))
    f = M._fbeta(F.col("tp"), F.col("fp"), F.col("P") - F.col("tp"), 2.0)
    best = (pts.filter(F.col("P") > 0).withColumn("f", f).groupBy("task")
            .agg(F.max_by(F.col("prob"), F.struct(F.col("f"), -F.col("prob"))).alias("best_threshold")))
    f2 = M.fbeta_at(scored, 0.5, 2.0).withColumnRenamed("fbeta", "F2_score")
    out = f2.join(curve, "task").join(best, "task", "left")
    return out.select("task", F.round("F2_score", 4).alias("F2_score"), F.round("PR_AUC", 4).alias("PR_AUC"),
                      F.round("ROC_AUC", 4).alias("ROC_AUC"),
                      F.round("best_threshold", 3).alias("best_F2_threshold"))


def feature_importance(spark: SparkSession, model, names: list[str]) -> DataFrame:
    """(feature, importance) sorted descending, for tree models; |coef| for LR."""
    if hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray().tolist()
    elif hasattr(model, "coefficients"):
        vals = [abs(v) for v in model.coefficients.toArray().tolist()]
    else:
        raise ValueError("model has no importances")
    rows = [(n, float(v)) for n, v in zip(names, vals)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def train_conditions(df: DataFrame, feats: list[str], targets: list[str], model_type: str = "lr",
                     params: dict | None = None, threads: int = 4) -> DataFrame:
    """One model per condition.  Logistic regressions of all conditions share every pass over the data
    (``shared_fit``) and one evaluation; other models are fitted over one cached table from a small thread
    pool (Spark runs them as concurrent jobs).  Returns the per-condition metric table plus a ``MEAN`` row."""
    base = df.select("id", "wave", *[c for c in feats if c not in ("id", "wave")], *targets)
    if model_type == "lr":
        fitted = fit_conditions(base, feats, targets, **({"max_iter": params["max_iter"]} if params and "max_iter" in params else {}))
        out = cut_lineage(metrics_row(cut_lineage(score_conditions(base, fitted), "scored")), "conditions")
    else:
        base = base.persist()

        def one(t):
            _, _, scored = train_eval(base, feats, t, model_type, params, task=t)
            return cut_lineage(metrics_row(scored), "condition")

        try:
            with ThreadPoolExecutor(max_workers=threads) as ex:
                parts = list(ex.map(one, targets))
        finally:
            base.unpersist()
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
    means = out.agg(F.lit("MEAN").alias("task"), *[F.round(F.avg(c), 4).alias(c) for c in
                                                   ("F2_score", "PR_AUC", "ROC_AUC", "best_F2_threshold")])
    return out.unionByName(means)


def run_condition(df: DataFrame, cfg: RunConfig, feats: list[str], min_rows: int = 1, use_smote: bool = False,
                  out_dir: str | None = None) -> DataFrame:
    """One run from a config: features of the config (else ``feats``) that are in the data, ``wave``
    always first; an exact-size sample (``sample_fraction``) or the first ``sample_rows`` rows by key
    if asked for; too few labelled rows are an error.  With ``out_dir`` the record (JSON), the
    importances (CSV) and the run log are written below it.  Returns the metrics row."""
    target = f"target_{cfg.condition}"
    if target not in df.columns:
        raise ValueError(f"no target column {target}")
    present = [c for c in (cfg.features or feats) if c in df.columns and c != "wave"]
    if not present:
        raise ValueError("none of the requested features is in the data")
    used = ["wave", *present]
    d = df.select("id", *dict.fromkeys(used), target)
    if cfg.sample_fraction is not None:
        d = sample_fraction(d, cfg.sample_fraction, ["id", "wave"])
    elif cfg.sample_rows:
        d = sample_rows(d, cfg.sample_rows, ["id", "wave"])
    if len(d.filter(F.col(target).isNotNull()).select("id").take(min_rows)) < min_rows:
        raise ValueError(f"fewer than {min_rows} labelled rows for {target}")
    model, names, scored = train_eval(d, used, target, cfg.model_type, cfg.params, cfg.split, cfg.condition, use_smote, cfg.weighting)
    row = metrics_row(scored).withColumn("model_type", F.lit(cfg.model_type))
    if out_dir is not None:
        row = cut_lineage(row, "metrics")
        IO.write_json(row.withColumn("features", F.array(*map(F.lit, names))), f"{out_dir}/record")
        if hasattr(model, "featureImportances") or hasattr(model, "coefficients"):
            IO.write_csv(feature_importance(df.sparkSession, model, names), f"{out_dir}/importances")
        keys = ["F2_score", "PR_AUC", "ROC_AUC"]
        stack = ", ".join(f"'{k}', {k}" for k in keys)
        IO.log_run(row.selectExpr(f"'{cfg.condition}' AS experiment", f"'{cfg.model_type}' AS run_id", "'metrics' AS kind",
                                  f"stack({len(keys)}, {stack}) AS (key, value)")
                   .withColumn("text", F.lit(None).cast("string")).withColumn("logged_at", F.current_timestamp()), f"{out_dir}/log")
    return row


QUICK_GRID = {"models": ["gbt"], "feature_sets": ["top8", "all"], "smote": (False,)}
FULL_GRID = {"models": ["lr", "rf", "gbt", "mlp"], "feature_sets": ["top8", "top50", "min_imp_5", "all"], "smote": (False, True)}


SWEEP_SCHEMA = "run_key string, model string, feature_set string, use_smote boolean, roc double, pr double, f2 double, " \
               "duration_sec double, error string"


def run_key(condition: str, model: str, feature_set: str, features: list[str], use_smote: bool, params: dict) -> str:
    """The identity of a sweep run: what it fits on which features with which parameters."""
    said = json.dumps([condition, model, feature_set, features, use_smote, params], sort_keys=True, default=str)
    return hashlib.sha256(said.encode()).hexdigest()[:24]


def run_sweep(df: DataFrame, grid: DataFrame, feature_sets: dict[str, list[str]], condition: str,
              params: dict[str, dict] | None = None, threads: int = 4, out_dir: str | None = None,
              retry_errors: bool = False) -> DataFrame:
    """Run every grid row (model, feature_set, use_smote) over one cached table, a few at a time.

    Each finished run is committed under its key below ``out_dir`` at once, a failed one with its
    ``error``.  A sweep that is started again with the same ``out_dir`` runs only what isn't there yet (and the failed
    runs, with ``retry_errors``); all results are then written as JSON to ``results``.  The grid is a
    small configuration table, so its rows are read on the driver.  Returns (model, feature_set,
    use_smote, roc, pr, f2, error), one row a grid row."""
    spark = df.sparkSession
    out_dir = out_dir or scratch_path(spark, "sweep")
    log = f"{out_dir}/runs"
    rows = []
    for g in grid.select("model", "feature_set", F.col("use_smote").cast("boolean").alias("use_smote")).distinct().collect():
        feats = feature_sets.get(g["feature_set"])
        rows.append((run_key(condition, g["model"], g["feature_set"], feats, g["use_smote"], (params or {}).get(g["model"], {})), *g))
    keyed = spark.createDataFrame(rows, "run_key string, model string, feature_set string, use_smote boolean")
    done = IO.read_committed(spark, log, SWEEP_SCHEMA, ["run_key"])
    if retry_errors:
        done = done.filter(F.col("error").isNull())
    todo = keyed.join(done, "run_key", "left_anti").orderBy("model", "feature_set", "use_smote").collect()

    def one(g):
        start = time.monotonic()
        try:
            feats = feature_sets[g["feature_set"]]
            cfg = RunConfig(condition, g["model"], feats, params=(params or {}).get(g["model"], {}))
            m = run_condition(base, cfg, [], use_smote=g["use_smote"]).first()
            result = (m["ROC_AUC"], m["PR_AUC"], m["F2_score"], round(time.monotonic() - start, 3), None)
        except Exception as e:  # noqa: BLE001  whatever a run fails on is its result
            result = (None, None, None, round(time.monotonic() - start, 3), f"{type(e).__name__}: {str(e)[:300]}")
        IO.commit_records(spark.createDataFrame([(*g, *result)], SWEEP_SCHEMA), log, ["run_key"])

    if todo:
        base = df.persist()
        try:
            with ThreadPoolExecutor(max_workers=threads) as ex:
                list(ex.map(one, todo))
        finally:
            base.unpersist()
    found = IO.read_committed(spark, log, SWEEP_SCHEMA, ["run_key"]).join(keyed.select("run_key"), "run_key", "left_semi")
    IO.write_json(found.drop("run_key").orderBy(F.desc_nulls_last("roc"), "model", "feature_set", "use_smote"), f"{out_dir}/results")
    return found.select("model", "feature_set", "use_smote", "roc", "pr", "f2", "error")

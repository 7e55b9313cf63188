"""Queries: model jobs (E1-E8) and synthetic oversampling.

Iterative fits are not SQL-expressible, so their metrics carry no oracle; tests
check them on a separable and a constant set, and the ``_facts`` queries hold
what the data fix of a fit (rows, positives, moments, ranks) against SQL.  Of the synthetic rows, SQL fixes the
number per task and the range they lie in, and it finds the same neighbours by
comparing all rows.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.joins import experiment_grid
from ..operators.neighbours import exact_neighbours
from ..operators.smote import adasyn, risk_share, search_pool, smote
from ..conf import SMOTE_K, RunConfig, SplitSpec
from ..functions import metrics as M
from ..functions.prefix import prefix_sums
from ..session import cut_lineage, scratch_path
from ..sources.files import read_run_log, read_table
from . import fixtures as fx
from . import models as MD
from .fixtures import FEATURES, TARGETS
from .q_panel import oracle
from .registry import query

_SMALL = {"lr": {"max_iter": 50}, "rf": {"n_estimators": 50, "max_depth": 6},
          "gbt": {"n_estimators": 30, "max_depth": 4}, "mlp": {"max_iter": 50, "hidden": [16, 8]}}


def _fit(model_type):
    def run(spark, sf):
        _, _, scored = MD.train_eval(fx.model(spark, sf), FEATURES, "target_URGE", model_type,
                                     _SMALL[model_type], task="URGE")
        return MD.metrics_row(scored).withColumn("model_type", F.lit(model_type))
    return run


query("train_logistic")(_fit("lr"))
query("train_forest")(_fit("rf"))
query("train_gbt")(_fit("gbt"))
query("train_mlp")(_fit("mlp"))


@query("feature_importance")
def q_feature_importance(spark, sf):
    model, used, _ = MD.train_eval(fx.model(spark, sf), FEATURES, "target_URGE", "gbt", _SMALL["gbt"])
    return MD.feature_importance(spark, model, used)


@query("train_conditions")
def q_train_conditions(spark, sf):
    return MD.train_conditions(fx.model(spark, sf), FEATURES, TARGETS, "lr", _SMALL["lr"])


@query("run_condition")
def q_run_condition(spark, sf):
    """A full run: all rows, outputs written; the result joins the metrics with what the run log says."""
    out = scratch_path(spark, "run")
    row = MD.run_condition(fx.model(spark, sf), RunConfig("STF", "gbt", FEATURES + ["BMI"], params=_SMALL["gbt"]), [], out_dir=out)
    logged = read_run_log(spark, f"{out}/log").agg(F.count("key").alias("n_logged"))
    return row.crossJoin(logged)   # one row each


@query("run_condition_sampled")
def q_run_condition_sampled(spark, sf):
    return MD.run_condition(fx.model(spark, sf), RunConfig("URGE", "lr", FEATURES, sample_fraction=0.5, params=_SMALL["lr"]), [])


@query("experiment_grids", oracle(["runs", "importances"], """
    SELECT DISTINCT mode, model, feature_set, use_smote FROM (
      SELECT 'full' AS mode, r.family AS model, i.grp AS feature_set, s.use_smote
      FROM (SELECT DISTINCT family FROM runs) r, (SELECT DISTINCT grp FROM importances) i, (SELECT DISTINCT use_smote FROM runs) s
      UNION ALL
      SELECT 'quick', (SELECT min(family) FROM runs), grp, false
      FROM (SELECT grp FROM importances GROUP BY grp ORDER BY sum(CAST(round(importance * 100) AS BIGINT)) DESC, grp LIMIT 2) t) g"""))
def q_experiment_grids(spark, sf):
    """Grids over what has been run and measured: all model families of the run records x the feature groups of
    the importances x the SMOTE settings seen; the quick one has the first family and the two heaviest groups."""
    runs, imp = fx.runs(spark, sf), fx.importances(spark, sf)
    seen = runs.agg(F.collect_set("family").alias("models"), F.collect_set("use_smote").alias("smote"))
    groups = imp.groupBy("grp").agg(F.sum(F.round(F.col("importance") * 100).cast("long")).alias("weight"))
    sets = groups.agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "grp"))).alias("sets"))
    one = seen.crossJoin(sets)   # one row each
    names = F.transform("sets", lambda x: x["grp"])
    full = one.select(F.lit("full").alias("mode"), F.explode("models").alias("model"), names.alias("sets"), "smote")
    quick = one.select(F.lit("quick").alias("mode"), F.array_min("models").alias("model"), F.slice(names, 1, 2).alias("sets"), F.array(F.lit(False)).alias("smote"))
    both = full.unionByName(quick).withColumn("feature_set", F.explode("sets")).withColumn("use_smote", F.explode("smote"))
    return both.select("mode", "model", "feature_set", "use_smote")


def _sweep_grid(spark):
    models = spark.createDataFrame([(m,) for m in (*MD.FULL_GRID["models"], "bogus")], "model string")
    grid = experiment_grid(models, ["all"], smote=(False,))
    # STF is the rarest condition: SMOTE has work to do there
    return grid.unionByName(experiment_grid(models.filter("model = 'lr'"), ["all"], smote=(True,)))


@query("run_sweep")
def q_run_sweep(spark, sf):
    return MD.run_sweep(fx.model(spark, sf), _sweep_grid(spark), {"all": FEATURES}, "STF", _SMALL)


@query("run_sweep_resumed", oracle(["model"], """
    SELECT model, feature_set, use_smote, false AS failed, 1 AS n_commits
    FROM (VALUES ('lr', 'all', false), ('lr', 'all', true), ('lr', 'few', false), ('lr', 'few', true)) v(model, feature_set, use_smote)
    WHERE (SELECT count(target_STF) FROM model) > 0
    UNION ALL SELECT 'lr', 'absent', false, true, 1"""))
def q_run_sweep_resumed(spark, sf):
    """A sweep that was ended halfway and started again: every run was committed once, the one without features as an error."""
    out, model, sets = scratch_path(spark, "resumed"), cut_lineage(fx.model(spark, sf), "model"), {"all": FEATURES, "few": FEATURES[:2]}
    lr = spark.createDataFrame([("lr",)], "model string")
    half = experiment_grid(lr, ["all"], smote=(False, True)).unionByName(experiment_grid(lr, ["absent"], smote=(False,)))
    MD.run_sweep(model, half, sets, "STF", _SMALL, out_dir=out)
    got = MD.run_sweep(model, half.unionByName(experiment_grid(lr, ["few"], smote=(False, True))), sets, "STF", _SMALL, out_dir=out)
    marks = spark.read.option("recursiveFileLookup", "true").schema("run_key string").parquet(f"{out}/runs/commits")
    named = spark.read.option("recursiveFileLookup", "true").schema(MD.SWEEP_SCHEMA).parquet(f"{out}/runs/attempts")
    n = named.join(marks, "run_key").groupBy("model", "feature_set", "use_smote").agg(F.count("*").cast("int").alias("n_commits"))
    return got.withColumn("failed", F.col("error").isNotNull()).join(n, ["model", "feature_set", "use_smote"]).select(
        "model", "feature_set", "use_smote", "failed", "n_commits")


def _rank_gap(scored):
    """By task the difference between the reported ROC-AUC and the share of (positive, negative) pairs in
    order, ties half, from running counts of the negatives."""
    n = scored.groupBy("task", "prob").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    below = prefix_sums(cut_lineage(n, "ranks"), ["task"], "prob", {"neg": F.col("neg")}, descending=False)
    pairs = below.groupBy("task").agg(F.try_divide(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("pairs"))
    return M.roc_auc(scored).join(pairs, "task").select("task", F.round(F.abs(F.col("roc_auc") - F.col("pairs")), 6).alias("gap"))


def _facts_sql(model_type):
    needs = "".join(f" AND {c} IS NOT NULL" for c in FEATURES) if model_type in MD.COMPLETE_CASE_MODELS else ""
    rows = ["SELECT 'train_rows' AS fact, '' AS item, CAST(count(*) AS DOUBLE) AS value FROM t",
            "SELECT 'train_positives', '', CAST(count_if(target_URGE = 1) AS DOUBLE) FROM t",
            "SELECT 'scored_rows', '', CAST(count(*) AS DOUBLE) FROM v", "SELECT 'scored_positives', '', CAST(count_if(target_URGE = 1) AS DOUBLE) FROM v",
            "SELECT 'scores_outside', '', 0.0::DOUBLE", "SELECT 'rank_gap', '', 0.0::DOUBLE"]
    for c in FEATURES:
        if model_type in ("lr", "mlp"):
            rows += [f"SELECT 'mean', '{c}', 0.0::DOUBLE", f"SELECT 'std', '{c}', CASE WHEN stddev_pop(CAST(coalesce({c}, 0) AS DOUBLE)) > 0 THEN 1.0 ELSE 0.0 END FROM t"]
        if model_type == "gbt":
            rows += [f"SELECT 'mean', '{c}', round(avg(CAST(coalesce({c}, 0) AS DOUBLE)), 4) FROM t",
                     f"SELECT 'mean', '{c}_missing', round(count_if({c} IS NULL) / CAST(count(*) AS DOUBLE), 4) FROM t"]
    return oracle(["model"], f"""SELECT fact, item, value FROM (
        WITH d AS (SELECT * FROM model WHERE target_URGE IS NOT NULL{needs}),
        t AS (SELECT * FROM d WHERE wave BETWEEN 3 AND 9), v AS (SELECT * FROM d WHERE wave BETWEEN 10 AND 12)
        {" UNION ALL ".join(rows)}) f""")


def _facts(model_type):
    """What a fit's data fix whatever the optimiser does: rows and positives on both sides, moments of the columns
    it is given, probabilities within bounds, and scores whose order gives the reported ROC-AUC."""
    def run(spark, sf):
        model = cut_lineage(fx.model(spark, sf), "model")
        d, names, columns = MD._prepare(model, FEATURES, "target_URGE", model_type, SplitSpec())
        n, pos, moments = MD._train_stats(d, columns)
        train = d.filter("split = 'train'")
        _, _, scored = MD.train_eval(model, FEATURES, "target_URGE", model_type, _SMALL[model_type], task="URGE")
        rows = [("train_rows", "", float(n)), ("train_positives", "", float(pos))]
        s = scored.agg(F.count("*"), F.count_if(F.col("label") == 1), F.count_if(~F.col("prob").between(0, 1))).first()
        rows += [(k, "", float(v)) for k, v in zip(("scored_rows", "scored_positives", "scores_outside"), s)]
        if model_type in ("lr", "mlp"):
            scaled = [(F.col(c) - moments[c][0]) / moments[c][1] for c in columns]
            r = train.agg(*[f(x) for x in scaled for f in (F.avg, F.stddev_pop)]).first()
            rows += [(k, c, abs(round(r[2 * i + j], 6))) for i, c in enumerate(names) for j, k in enumerate(("mean", "std"))]
        if model_type == "gbt":
            rows += [("mean", c, round(moments[x][0], 4)) for c, x in zip(names, columns)]
        return spark.createDataFrame(rows, "fact string, item string, value double").unionByName(
            _rank_gap(scored).select(F.lit("rank_gap").alias("fact"), F.lit("").alias("item"), F.col("gap").alias("value")))
    return run


for _name, _type in (("fit_logistic_facts", "lr"), ("fit_forest_facts", "rf"), ("fit_gbt_facts", "gbt"), ("fit_mlp_facts", "mlp")):
    query(_name, _facts_sql(_type))(_facts(_type))


@query("importance_facts", oracle(["model"], f"""
    SELECT {2 * len(FEATURES)} AS n_features, CASE WHEN count_if(target_URGE = 1) > 0 THEN 1.0 ELSE 0.0 END AS total, 0 AS n_negative, 0 AS n_unsorted FROM model"""))
def q_importance_facts(spark, sf):
    """Importances of the boosted trees: one a column, none negative, descending, of sum 1."""
    model, used, _ = MD.train_eval(fx.model(spark, sf), FEATURES, "target_URGE", "gbt", _SMALL["gbt"])
    imp = MD.feature_importance(spark, model, used)
    listed = imp.agg(F.count("*").cast("int").alias("n_features"), F.round(F.sum("importance"), 6).alias("total"),
                     F.count_if(F.col("importance") < 0).cast("int").alias("n_negative"), F.collect_list("importance").alias("l"))
    return listed.select("n_features", "total", "n_negative", F.when(F.col("l") == F.reverse(F.array_sort("l")), 0).otherwise(1).alias("n_unsorted"))


@query("fit_conditions_facts", oracle(["model"], " UNION ALL ".join(
    f"""SELECT '{t}' AS task, count(*) AS n_scored, count_if({t} = 1) AS n_positive, 0 AS n_outside, 0.0::DOUBLE AS rank_gap, true AS few_passes
        FROM model WHERE wave BETWEEN 10 AND 12 AND {t} IS NOT NULL{"".join(f" AND {c} IS NOT NULL" for c in FEATURES)}""" for t in TARGETS)))
def q_fit_conditions_facts(spark, sf):
    """All conditions fitted in shared passes: rows and positives scored by condition, and the order of the scores."""
    model = cut_lineage(fx.model(spark, sf), "model")
    fitted = MD.fit_conditions(model, FEATURES, TARGETS)
    scored = cut_lineage(MD.score_conditions(model, fitted), "scored")
    n = scored.groupBy("task").agg(F.count("*").alias("n_scored"), F.count_if(F.col("label") == 1).alias("n_positive"),
                                   F.count_if(~F.col("prob").between(0, 1)).cast("int").alias("n_outside"))
    return n.join(_rank_gap(scored), "task").select("task", "n_scored", "n_positive", "n_outside", F.col("gap").alias("rank_gap"),
                                                    F.lit(fitted.iterations <= 50).alias("few_passes"))


DIMS = 64   # of the embeddings table
# One-vs-rest tasks over the embedding classes: rare positives.
_VEC_SQL = """
    v AS (SELECT 'C' || CAST(k AS VARCHAR) AS task, CAST(label = k AS INTEGER) AS label, embedding AS e FROM embeddings, range(0, 10) AS g(k)),
    c AS (SELECT task, count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0 FROM v GROUP BY task),
    n AS (SELECT *, CASE WHEN least(n1, n0) > 0 THEN greatest(CAST(floor(greatest(n1, n0) * CAST(0.33 AS DOUBLE)) AS BIGINT) - least(n1, n0), 0) ELSE 0 END AS new FROM c)"""
# New rows lie between two minority rows, so inside the minority's range in every dimension.
_SYNTH_SQL = f"WITH {_VEC_SQL} SELECT task, n1 + n0 AS n_rows, new AS n_synthetic, 0 AS n_outside FROM n"


def _vectors(spark, sf):
    e = read_table(spark, f"{sf}/embeddings.parquet")
    cols = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(DIMS)]
    tasks = F.explode(F.sequence(F.lit(0), F.lit(9)))
    return (e.select(F.col("vec_id").alias("id"), F.lit(0).alias("wave"), F.col("label").alias("_l"), *cols)
            .withColumn("k", tasks)
            .select(F.concat(F.lit("C"), F.col("k").cast("string")).alias("task"), "id", "wave",
                    (F.col("_l") == F.col("k")).cast("int").alias("label"),
                    *[f"e{i}" for i in range(DIMS)]))


def _synthetic(over, v):
    """Per task: rows, new rows, and new rows outside the minority's range in some dimension."""
    cols = [f"e{i}" for i in range(DIMS)]
    out = cut_lineage(over(v, cols), "synthetic")
    lo = [F.min(F.when((F.col("label") == 1) & ~F.col("synthetic"), F.col(c))).alias(f"lo_{c}") for c in cols]
    hi = [F.max(F.when((F.col("label") == 1) & ~F.col("synthetic"), F.col(c))).alias(f"hi_{c}") for c in cols]
    ranged = out.join(out.groupBy("task").agg(*lo, *hi), "task")
    outside = F.lit(False)
    for c in cols:
        outside = outside | (F.col(c) < F.col(f"lo_{c}") - 1e-9) | (F.col(c) > F.col(f"hi_{c}") + 1e-9)
    return ranged.groupBy("task").agg(
        F.count_if(~F.col("synthetic")).alias("n_rows"), F.count_if("synthetic").alias("n_synthetic"),
        F.count_if(F.col("synthetic") & outside).alias("n_outside"))


@query("smote", _SYNTH_SQL)
def q_smote(spark, sf):
    return _synthetic(smote, _vectors(spark, sf))


@query("adasyn", _SYNTH_SQL)
def q_adasyn(spark, sf):
    return _synthetic(adasyn, _vectors(spark, sf))


# The k nearest rows of each minority row, found by comparing it with every row of its task.
_NEAREST_SQL = """
    p AS (SELECT v.task, vec_id AS id, v.label, e FROM (
        SELECT vec_id, 'C' || CAST(k AS VARCHAR) AS task, CAST(label = k AS INTEGER) AS label, embedding AS e FROM embeddings, range(0, 10) AS g(k)) v),
    n AS (SELECT a.task, a.id, b.label, sqrt(list_sum(list_transform(range(1, 65), lambda i: power(CAST(a.e[i] AS DOUBLE) - CAST(b.e[i] AS DOUBLE), 2)))) AS d
          FROM p a JOIN p b ON a.task = b.task AND a.id <> b.id WHERE a.label = 1 {among}),
    r AS (SELECT *, row_number() OVER (PARTITION BY task, id ORDER BY d) AS place FROM n)"""


def _vector_pool(spark, sf):
    v = cut_lineage(_vectors(spark, sf).withColumn("_row", F.monotonically_increasing_id()), "vectors")
    pool = search_pool(v, [f"e{i}" for i in range(DIMS)], "task", ["id", "wave"], F.col("label") == 1)
    return v.select(F.col("_row").alias("row"), "task", "id"), cut_lineage(pool, "pool")


@query("smote_neighbours", f"""WITH {_NEAREST_SQL.format(among="AND b.label = 1")}
    SELECT task, id, CAST(count(*) AS INTEGER) AS n_near, round(min(d), 6) AS nearest, round(max(d), 6) AS farthest, round(avg(d), 6) AS mean_distance
    FROM r WHERE place <= 5 GROUP BY task, id""")
def q_smote_neighbours(spark, sf):
    """Distances of the partners that SMOTE draws from: the 5 nearest minority rows of each minority row."""
    named, pool = _vector_pool(spark, sf)
    d = F.transform("near", lambda x: F.sqrt(x["d"]))
    mean = F.aggregate("d", F.lit(0.0), lambda s, x: s + x) / F.size("d")
    return (exact_neighbours(pool.filter("flag"), SMOTE_K).filter(F.size("near") > 0).withColumn("d", d).join(named, "row")
            .select("task", "id", F.size("d").alias("n_near"), F.round(F.array_min("d"), 6).alias("nearest"),
                    F.round(F.array_max("d"), 6).alias("farthest"), F.round(mean, 6).alias("mean_distance")))


@query("adasyn_risk", f"""WITH {_NEAREST_SQL.format(among="")}
    SELECT task, id, count_if(label = 0) / CAST(5 AS DOUBLE) AS risk, round(max(d), 6) AS farthest FROM r WHERE place <= 5 GROUP BY task, id""")
def q_adasyn_risk(spark, sf):
    """The share of majority rows among the 5 nearest of all rows, by minority row."""
    named, pool = _vector_pool(spark, sf)
    near = exact_neighbours(pool.withColumn("query", F.col("flag")), SMOTE_K)
    return near.join(named, "row").select("task", "id", risk_share(F.col("near")).alias("risk"),
                                          F.round(F.sqrt(F.element_at("near", -1)["d"]), 6).alias("farthest"))

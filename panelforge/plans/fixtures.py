"""Inputs derived from the provided tables, in Spark and in SQL.

The survey data of the original is not available, so the panel and the side
tables are derived from the TPC-H-like tables; every derivation is a Spark
job whose work grows with the tables.  Each builder has a SQL twin (a CTE)
that the DuckDB oracle runs on the same parquet files.

* ``panel``       P: customer x waves 1..14, order aggregates per half-year.
* ``wide``        P pivoted to ``R<w><CONCEPT>`` columns plus decoys.
* ``model``       P waves 3..14 -> incident targets -> waves <= 12.
* ``person``      customer + nation, one row per person (key ``HHIDPN``).
* ``importances`` part -> (feature, importance, grp).
* ``imp_multi``   part -> per-"disease" importance lists (disease = brand).
* ``runs``        events -> one row per (run, task) with metrics and params.
* ``scored``      model targets and document labels with fixed scores.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.reshape import filter_waves
from ..operators.targets import incident_targets
from ..sources.files import read_table

# ---------------------------------------------------------------------------
# The eight panel conditions (suffix, source column, code).
# ---------------------------------------------------------------------------
PANEL_CONDITIONS = [
    ("URGE", "o_orderpriority", "1-URGENT"),
    ("HIGH", "o_orderpriority", "2-HIGH"),
    ("MEDI", "o_orderpriority", "3-MEDIUM"),
    ("NOTS", "o_orderpriority", "4-NOT SPECIFIED"),
    ("LOWP", "o_orderpriority", "5-LOW"),
    ("STF", "o_orderstatus", "F"),
    ("STO", "o_orderstatus", "O"),
    ("STP", "o_orderstatus", "P"),
]
PANEL_WAVES = 14
FIRST_YEAR = 1995
# Run parameters derived from the user id.
FAMILIES = ["mlp", "resnet", "attention", "wide_deep"]
DROPOUTS = [0.1, 0.2, 0.3]
OPTIMIZERS = ["adam", "adamw"]
LOSSES = ["focal", "focal_weighted", "weighted_bce", "weighted_bce", "weighted_bce"]
# ---------------------------------------------------------------------------

COND_NAMES = [c for c, _, _ in PANEL_CONDITIONS]
CONCEPTS = ["SPEND", "N"] + COND_NAMES
TARGETS = [f"target_{c}" for c in COND_NAMES]
FEATURES = ["SPEND", "N"] + COND_NAMES


def _wave_expr(ts: str = "o_orderdate"):
    return ((F.year(ts) - FIRST_YEAR) * 2 + F.when(F.month(ts) > 6, 1).otherwise(0) + 1).cast("int")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long panel P: one row per (customer, wave), NULL cells where no orders.

    Plan: orders are pre-aggregated per (customer, wave) with a map-side
    combine (so one customer holding a third of all orders costs nothing
    extra), unioned with the customer x wave grid, and everything after that
    runs on one hash partitioning by ``id``: the cell merge and the "ever so
    far" window reuse it.
    """
    orders = read_table(spark, f"{sf_dir}/orders.parquet")
    customer = read_table(spark, f"{sf_dir}/customer.parquet")
    flags = [F.max((F.col(src) == code).cast("int")).alias(name)
             for name, src, code in PANEL_CONDITIONS]
    cells = (orders.groupBy(F.col("o_custkey").alias("id"), _wave_expr().alias("wave"))
             .agg(F.round(F.sum("o_totalprice"), 2).alias("SPEND"),
                  F.count(F.lit(1)).alias("N"), *flags)
             .withColumn("_grid", F.lit(0)))
    grid = customer.select(F.col("c_custkey").alias("id"),
                           F.explode(F.sequence(F.lit(1), F.lit(PANEL_WAVES))).alias("wave"),
                           F.lit(1).alias("_grid"))
    merged = (grid.unionByName(cells, allowMissingColumns=True)
              .repartition("id")
              .groupBy("id", "wave")
              .agg(F.max("_grid").alias("_grid"),
                   *[F.max(c).alias(c) for c in CONCEPTS])
              .filter(F.col("_grid") == 1))
    ever = Window.partitionBy("id").orderBy("wave").rowsBetween(Window.unboundedPreceding, 0)
    return merged.select(
        "id", "wave", "SPEND", "N",
        *[F.when(F.col("N").isNotNull(), F.max(c).over(ever)).alias(c) for c in COND_NAMES])


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P pivoted to one row per person: ``R<w><CONCEPT>`` plus decoy columns
    ``RAGENDER`` (no wave number) and ``H1X`` (no ``R`` prefix)."""
    p = panel(spark, sf_dir)
    cells = [F.max(F.when(F.col("wave") == w, F.col(c))).alias(f"R{w}{c}")
             for w in range(1, PANEL_WAVES + 1) for c in CONCEPTS]
    out = p.groupBy(F.col("id").alias("HHIDPN")).agg(*cells, F.sum("N").alias("H1X"))
    return out.withColumn("RAGENDER", (F.col("HHIDPN") % 2 + 1).cast("int"))


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model table: P, waves 3..14, incident targets, waves <= 12."""
    return incident_targets(filter_waves(panel(spark, sf_dir), 3, 14), COND_NAMES)


def person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person side table keyed by ``HHIDPN``; ``N`` overlaps the panel on purpose."""
    c = read_table(spark, f"{sf_dir}/customer.parquet")
    n = read_table(spark, f"{sf_dir}/nation.parquet")
    return (c.join(n, c.c_nationkey == n.n_nationkey, "left")
            .select(F.col("c_custkey").alias("HHIDPN"), F.col("c_acctbal").alias("ACCTBAL"),
                    F.col("n_name").alias("NATION"), F.col("c_mktsegment").alias("SEGMENT"),
                    F.col("c_nationkey").alias("N")))


def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, f"{sf_dir}/part.parquet")
    return part.select(F.concat(F.lit("F"), F.col("p_partkey").cast("string")).alias("feature"),
                       F.col("p_retailprice").alias("importance"),
                       F.col("p_brand").alias("grp"))


def imp_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance lists of many "diseases": one per brand, features = part names."""
    part = read_table(spark, f"{sf_dir}/part.parquet")
    return (part.groupBy(F.col("p_brand").alias("disease"),
                         F.regexp_replace("p_name", " ", "_").alias("feature"))
            .agg(F.max("p_retailprice").alias("importance")))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run table, one row per (run, task), from ``events``."""
    ev = read_table(spark, f"{sf_dir}/events.parquet")
    uid = F.col("user_id")

    def pick(values, mod):
        expr = None
        for i, v in enumerate(values):
            expr = (F.when(uid % mod == i, F.lit(v)) if expr is None
                    else expr.when(uid % mod == i, F.lit(v)))
        return expr

    # Values are whole cents; sums and the rounding to 6 places are done in integers, so that no
    # order of summation shows in a result.
    cents = F.round(F.col("value") * 100).cast("long")
    sums = ev.groupBy("user_id", F.upper("event_type").alias("task")).agg(
        F.min("ts").alias("task_start"), F.sum(cents).alias("s"), F.max(cents).alias("m"), F.count("value").alias("n"))
    million = F.lit(1000000.0)
    per_task = sums.select(
        "user_id", "task", "task_start",
        (F.expr("500000 + (20 * s + n) div (2 * n)") / million).alias("roc"),
        (F.expr("(40 * s + n) div (2 * n)") / million).alias("pr"),
        (F.col("m") * 10 / million).alias("f2"),
        (F.col("s") * 1000 / million).alias("time_sec"))
    run_w = Window.partitionBy("user_id")
    return per_task.select(
        F.concat(F.lit("run_"), uid.cast("string")).alias("run_id"),
        F.concat(F.lit("exp_"), (uid % 3).cast("string")).alias("experiment"),
        F.min("task_start").over(run_w).alias("start_time"),
        pick(FAMILIES, 4).alias("family"),
        pick(DROPOUTS, 3).alias("dropout"),
        pick(OPTIMIZERS, 2).alias("optimizer"),
        pick(LOSSES, 5).alias("loss"),
        (uid % 7 == 0).alias("use_smote"),
        "task", "roc", "pr", "f2", "time_sec",
        F.when(uid % 11 == 0, F.lit("failed")).alias("error"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, id, label, prob): panel targets on validation waves and document labels."""
    m = model(spark, sf_dir).filter(F.col("wave").between(10, 12))
    x = F.lit(10.0) * F.coalesce(F.col("N"), F.lit(0)) + F.coalesce(F.col("SPEND"), F.lit(0.0)) / 10000
    prob = F.round((x + 1) / (x + 21), 4)
    stack = ", ".join(f"'{c}', target_{c}" for c in COND_NAMES)
    panel_part = (m.select("id", prob.alias("prob"),
                           F.expr(f"stack({len(COND_NAMES)}, {stack}) AS (task, label)"))
                  .filter(F.col("label").isNotNull()))
    docs = read_table(spark, f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    lab = read_table(spark, f"{sf_dir}/labels.parquet")
    dprob = F.round((F.col("n_chars") % 997) / 997.0, 3)
    doc_part = (lab.join(docs, "doc_id")
                .select(F.col("doc_id").alias("id"), dprob.alias("prob"),
                        F.expr("stack(2, 'TOXIC', toxic, 'QUALITY', quality) AS (task, label)"))
                .filter(F.col("label").isNotNull()))
    return (panel_part.unionByName(doc_part)
            .select("task", "id", F.col("label").cast("int").alias("label"), "prob"))


BUILDERS = {"panel": panel, "wide": wide, "model": model, "person": person,
            "importances": importances, "imp_multi": imp_multi, "runs": runs, "scored": scored}


# ---------------------------------------------------------------------------
# SQL twins (DuckDB).  ``with_ctes(...)`` returns a WITH clause.
# ---------------------------------------------------------------------------
def _flag_sql(src, code):
    return f"max(CASE WHEN {src} = '{code}' THEN 1 ELSE 0 END)"


def _pick_sql(values, mod):
    def lit(v):
        return f"CAST({v} AS DOUBLE)" if isinstance(v, float) else f"'{v}'"
    arms = " ".join(f"WHEN user_id % {mod} = {i} THEN {lit(v)}" for i, v in enumerate(values))
    return f"CASE {arms} END"


def _target_sql(c):
    return (f"CASE WHEN b.{c} = 0 THEN CASE WHEN t1.{c} = 1 OR t2.{c} = 1 THEN 1 "
            f"WHEN t1.{c} = 0 AND t2.{c} = 0 THEN 0 END END AS target_{c}")


_X = "(CAST(10 AS DOUBLE) * coalesce(N, 0) + coalesce(SPEND, CAST(0 AS DOUBLE)) / 10000)"

CTES: dict[str, tuple[list[str], str]] = {
    "p_cells": ([], f"""
        SELECT o_custkey AS id,
               CAST((year(o_orderdate) - {FIRST_YEAR}) * 2
                    + CASE WHEN month(o_orderdate) > 6 THEN 1 ELSE 0 END + 1 AS INTEGER) AS wave,
               round(sum(o_totalprice), 2) AS SPEND, count(*) AS N,
               {", ".join(f"{_flag_sql(s, v)} AS {n}" for n, s, v in PANEL_CONDITIONS)}
        FROM orders GROUP BY 1, 2"""),
    "p_grid": ([], f"""
        SELECT c_custkey AS id, CAST(g.w AS INTEGER) AS wave
        FROM customer, range(1, {PANEL_WAVES + 1}) AS g(w)"""),
    "panel": (["p_cells", "p_grid"], f"""
        SELECT g.id, g.wave, c.SPEND, c.N,
               {", ".join(f"CASE WHEN c.N IS NOT NULL THEN max(c.{n}) OVER ever END AS {n}" for n in COND_NAMES)}
        FROM p_grid g LEFT JOIN p_cells c ON c.id = g.id AND c.wave = g.wave
        WINDOW ever AS (PARTITION BY g.id ORDER BY g.wave ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
    "plong": (["panel"], "SELECT * FROM panel WHERE wave BETWEEN 3 AND 14"),
    "model": (["plong"], f"""
        SELECT b.*, {", ".join(_target_sql(c) for c in COND_NAMES)}
        FROM plong b
        LEFT JOIN plong t1 ON t1.id = b.id AND t1.wave = b.wave + 1
        LEFT JOIN plong t2 ON t2.id = b.id AND t2.wave = b.wave + 2
        WHERE b.wave <= 12"""),
    "person": ([], """
        SELECT c_custkey AS HHIDPN, c_acctbal AS ACCTBAL, n_name AS NATION,
               c_mktsegment AS SEGMENT, c_nationkey AS N
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""),
    "importances": ([], """
        SELECT 'F' || CAST(p_partkey AS VARCHAR) AS feature, p_retailprice AS importance,
               p_brand AS grp FROM part"""),
    "imp_multi": ([], """
        SELECT p_brand AS disease, replace(p_name, ' ', '_') AS feature,
               max(p_retailprice) AS importance FROM part GROUP BY 1, 2"""),
    "runs_task": ([], """
        SELECT user_id, task, task_start,
               CAST(500000 + (20 * s + n) // (2 * n) AS DOUBLE) / CAST(1000000 AS DOUBLE) AS roc,
               CAST((40 * s + n) // (2 * n) AS DOUBLE) / CAST(1000000 AS DOUBLE) AS pr,
               CAST(m * 10 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS f2,
               CAST(s * 1000 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS time_sec
        FROM (SELECT user_id, upper(event_type) AS task, min(ts) AS task_start,
                     CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS s,
                     max(CAST(round(value * 100) AS BIGINT)) AS m, count(value) AS n
              FROM events GROUP BY 1, 2) q"""),
    "runs": (["runs_task"], f"""
        SELECT 'run_' || CAST(user_id AS VARCHAR) AS run_id,
               'exp_' || CAST(user_id % 3 AS VARCHAR) AS experiment,
               min(task_start) OVER (PARTITION BY user_id) AS start_time,
               {_pick_sql(FAMILIES, 4)} AS family,
               {_pick_sql(DROPOUTS, 3)} AS dropout,
               {_pick_sql(OPTIMIZERS, 2)} AS optimizer,
               {_pick_sql(LOSSES, 5)} AS loss,
               (user_id % 7 = 0) AS use_smote,
               task, roc, pr, f2, time_sec,
               CASE WHEN user_id % 11 = 0 THEN 'failed' END AS error
        FROM runs_task"""),
    "scored": (["model"], f"""
        SELECT task, id, CAST(label AS INTEGER) AS label, prob FROM (
          {" UNION ALL ".join(f"SELECT '{c}' AS task, id, target_{c} AS label, round(({_X} + 1) / ({_X} + 21), 4) AS prob FROM model WHERE wave BETWEEN 10 AND 12" for c in COND_NAMES)}
          UNION ALL
          SELECT 'TOXIC', l.doc_id, l.toxic, round((d.n_chars % 997) / CAST(997 AS DOUBLE), 3)
            FROM labels l JOIN documents d ON d.doc_id = l.doc_id
          UNION ALL
          SELECT 'QUALITY', l.doc_id, l.quality, round((d.n_chars % 997) / CAST(997 AS DOUBLE), 3)
            FROM labels l JOIN documents d ON d.doc_id = l.doc_id
        ) s WHERE label IS NOT NULL"""),
}


def with_ctes(*names: str) -> str:
    """WITH clause holding the named CTEs and everything they depend on."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n"

"""Queries: scalar functions used by the pipeline (strings, math, nulls,
dates, arrays / maps / JSON)."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as SC
from ..sources.files import read_table
from . import fixtures as fx
from .q_panel import oracle
from .q_runs import rsql
from .registry import query


@query("string_scalars", """
    SELECT p_partkey,
           starts_with(p_brand, 'Brand#1') AS brand1x,
           regexp_matches(p_name, '^[a-z]+ [a-z]+$') AS two_words,
           substring(p_brand, 7) AS brand_no,
           ends_with(p_name, 'gear') AS is_gear,
           contains(lower(p_type), 'small') AS small,
           trim('  ' || p_name || ' ') AS trimmed,
           upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS type_title,
           array_to_string(list_transform(string_split(replace('F_' || p_name, '_', ' '), ' '),
                                          lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label
    FROM part""")
def q_string_scalars(spark, sf):
    p = read_table(spark, f"{sf}/part.parquet")
    return p.select(
        "p_partkey",
        F.col("p_brand").startswith("Brand#1").alias("brand1x"),
        F.col("p_name").rlike("^[a-z]+ [a-z]+$").alias("two_words"),
        F.substring("p_brand", 7, 1 << 20).alias("brand_no"),
        F.col("p_name").endswith("gear").alias("is_gear"),
        F.lower("p_type").contains("small").alias("small"),
        F.trim(F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))).alias("trimmed"),
        F.initcap("p_type").alias("type_title"),
        SC.title_label(F.concat(F.lit("F_"), F.col("p_name"))).alias("label"))


@query("joined_truncated", """
    SELECT p_brand, CASE WHEN length(j) > 447 THEN substr(j, 1, 447) || '...' ELSE j END AS features
    FROM (SELECT p_brand, array_to_string(list(feature ORDER BY feature), ', ') AS j FROM (
            SELECT p_brand, 'F' || CAST(p_partkey AS VARCHAR) AS feature,
                   row_number() OVER (PARTITION BY p_brand ORDER BY 'F' || CAST(p_partkey AS VARCHAR)) AS r
            FROM part) x WHERE r <= 448 GROUP BY p_brand) y""")
def q_joined_truncated(spark, sf):
    p = read_table(spark, f"{sf}/part.parquet").select(
        "p_brand", F.concat(F.lit("F"), F.col("p_partkey").cast("string")).alias("feature"))
    return SC.joined_truncated(p, "p_brand", "feature", 447).withColumnRenamed("joined", "features")


@query("math_scalars", """
    SELECT event_id, round(value / 7, 3) AS r3,
           least(greatest(value / 100, 0.1), 0.75) AS clamp,
           round(1 / (1 + exp(-(value / 100 - 2))), 6) AS sigmoid,
           round(pow(value / 100, 2), 6) AS sq,
           CAST(floor(value * 3) AS BIGINT) AS floor3
    FROM events""")
def q_math_scalars(spark, sf):
    e = read_table(spark, f"{sf}/events.parquet")
    v = F.col("value")
    return e.select("event_id", F.round(v / 7, 3).alias("r3"),
                    SC.clamp(v / 100, 0.1, 0.75).alias("clamp"),
                    F.round(SC.sigmoid(v / 100 - 2), 6).alias("sigmoid"),
                    F.round(F.pow(v / 100, 2), 6).alias("sq"),
                    F.floor(v * 3).cast("long").alias("floor3"))


@query("null_scalars", oracle(["model"], """
    SELECT id, wave, SPEND IS NOT NULL AS has_spend, URGE IN (0, 1) AS urge_01,
           coalesce(N, 0) AS n0,
           CASE WHEN N IS NULL THEN 0.0 ELSE SPEND END AS spend_or_zero
    FROM model"""))
def q_null_scalars(spark, sf):
    m = fx.model(spark, sf)
    nan_when_missing = F.when(F.col("N").isNull(), F.lit(float("nan"))).otherwise(F.col("SPEND"))
    return m.select("id", "wave", F.col("SPEND").isNotNull().alias("has_spend"),
                    F.col("URGE").isin(0, 1).alias("urge_01"), F.coalesce("N", F.lit(0)).alias("n0"),
                    F.nanvl(nan_when_missing, F.lit(0.0)).alias("spend_or_zero"))


@query("run_label", rsql("SELECT run_id, strftime(start_time, '%Y%m%d_%H%M') AS label FROM rs"))
def q_run_label(spark, sf):
    from ..operators.runs import aggregate_metrics
    s = aggregate_metrics(fx.runs(spark, sf))
    return s.select("run_id", SC.run_label("start_time").alias("label"))


@query("json_roundtrip", fx.with_ctes("runs") + """
    SELECT run_id, task, roc AS roc_back, count(*) OVER (PARTITION BY run_id) AS n_tasks FROM runs""")
def q_json_roundtrip(spark, sf):
    r = fx.runs(spark, sf)
    per_run = r.groupBy("run_id").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("task", F.struct("roc", "pr"))))).alias("js"))
    schema = "map<string, struct<roc: double, pr: double>>"
    back = per_run.select("run_id", F.from_json("js", schema).alias("m"))
    return back.select("run_id", F.explode("m").alias("task", "v"),
                       F.size("m").cast("long").alias("n_tasks")).select(
        "run_id", "task", F.col("v.roc").alias("roc_back"), "n_tasks")

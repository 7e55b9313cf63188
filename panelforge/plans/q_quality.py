"""Queries: profiles, data-quality report, class weights, sampling."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balance as B
from ..operators import quality as Q
from ..operators import reshape as R
from ..operators.targets import incident_targets
from ..session import cut_lineage
from . import fixtures as fx
from .fixtures import COND_NAMES, FEATURES, TARGETS
from .q_panel import _train, oracle, rnd, task_split_sql
from .registry import query

_MISS_COLS = FEATURES + ["BMI"]


@query("panel_profile", oracle(["panel"], """
    SELECT count(*) AS rows, count(DISTINCT id) AS unique_ids,
           array_to_string(list_sort(list_distinct(list(wave))), ',') AS waves
    FROM panel WHERE wave BETWEEN 3 AND 14"""))
def q_panel_profile(spark, sf):
    p = Q.panel_profile(R.filter_waves(fx.panel(spark, sf), 3, 14))
    return p.select("rows", "unique_ids", F.array_join("waves", ",").alias("waves"))


@query("rows_per_wave", oracle(["panel"], "SELECT wave, count(*) AS rows FROM panel GROUP BY wave"))
def q_rows_per_wave(spark, sf):
    return Q.rows_per_wave(fx.panel(spark, sf))


_MISS_SQL = " UNION ALL ".join(
    [f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS missing_count, "
     f"round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2)::DOUBLE AS missing_pct, "
     f"'ok' AS status FROM model" for c in FEATURES]
    + ["SELECT 'BMI', NULL::BIGINT, NULL::DOUBLE, 'column_not_present'"])


@query("missingness", oracle(["model"], _MISS_SQL))
def q_missingness(spark, sf):
    return Q.missingness(fx.model(spark, sf), _MISS_COLS)


_ALL = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)


@query("complete_case_counts", oracle(["model"], f"""
    SELECT count(*) AS rows_total, count(*) FILTER (WHERE {_ALL}) AS complete_cases,
           count(*) - count(*) FILTER (WHERE {_ALL}) AS rows_with_any_missing_feature FROM model"""))
def q_complete_case_counts(spark, sf):
    return Q.complete_case_counts(fx.model(spark, sf), _MISS_COLS)


_BAL_SQL = " UNION ALL ".join(
    f"SELECT 'target_{c}' AS target, count(target_{c}) AS non_missing, "
    f"count(*) FILTER (WHERE target_{c} = 1) AS events, "
    f"CASE WHEN count(target_{c}) > 0 THEN round(CAST(100 * count(*) FILTER (WHERE target_{c} = 1) AS DOUBLE)"
    f" / count(target_{c}), 2) END AS event_rate_pct FROM model" for c in COND_NAMES)


@query("target_balance", oracle(["model"], _BAL_SQL))
def q_target_balance(spark, sf):
    return Q.target_balance(fx.model(spark, sf))


_STATS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, "
    f"round(avg({c}), 4) AS mean FROM model" for c in FEATURES)


@query("feature_stats", oracle(["model"], _STATS_SQL))
def q_feature_stats(spark, sf):
    return Q.feature_stats(fx.model(spark, sf), _MISS_COLS)


def _report_sql():
    parts = ["SELECT 'long' AS section, '' AS item, 'rows' AS metric, count(*)::DOUBLE AS value FROM plong",
             "SELECT 'long', '', 'unique_ids', count(DISTINCT id)::DOUBLE FROM plong",
             "SELECT 'long_rows_per_wave', CAST(wave AS VARCHAR), 'rows', count(*)::DOUBLE FROM plong GROUP BY wave",
             "SELECT DISTINCT 'long', CAST(wave AS VARCHAR), 'waves', wave::DOUBLE FROM plong",
             f"SELECT 'X_final', '', 'rows', (count(*) FILTER (WHERE target_URGE IS NOT NULL AND {_ALL}))::DOUBLE FROM model",
             f"SELECT 'y_conditions', '', 'rows', (count(*) FILTER (WHERE target_URGE IS NOT NULL AND {_ALL}))::DOUBLE FROM model",
             "SELECT 'model', '', 'rows', count(*)::DOUBLE FROM model",
             "SELECT 'step5', '', 'rows_total', count(*)::DOUBLE FROM model",
             f"SELECT 'step5', '', 'complete_cases', (count(*) FILTER (WHERE {_ALL}))::DOUBLE FROM model",
             f"SELECT 'step5', '', 'rows_with_any_missing_feature', (count(*) - count(*) FILTER (WHERE {_ALL}))::DOUBLE FROM model",
             "SELECT 'missingness', 'BMI', 'column_not_present', NULL::DOUBLE"]
    for c in FEATURES:
        parts += [f"SELECT 'missingness', '{c}', 'count', (count(*) FILTER (WHERE {c} IS NULL))::DOUBLE FROM model",
                  f"SELECT 'missingness', '{c}', 'pct', round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2)::DOUBLE FROM model",
                  f"SELECT 'feature_stats', '{c}', 'min', min({c})::DOUBLE FROM model",
                  f"SELECT 'feature_stats', '{c}', 'max', max({c})::DOUBLE FROM model",
                  f"SELECT 'feature_stats', '{c}', 'mean', round(avg({c}), 4) FROM model"]
    for c in COND_NAMES:
        t = f"target_{c}"
        parts += [f"SELECT 'target_balance', '{t}', 'non_missing', count({t})::DOUBLE FROM model",
                  f"SELECT 'target_balance', '{t}', 'events', (count(*) FILTER (WHERE {t} = 1))::DOUBLE FROM model",
                  f"SELECT 'target_balance', '{t}', 'event_rate_pct', CASE WHEN count({t}) > 0 THEN "
                  f"round(CAST(100 * count(*) FILTER (WHERE {t} = 1) AS DOUBLE) / count({t}), 2) END FROM model"]
    return " UNION ALL ".join(parts)


@query("quality_report", oracle(["model", "plong"], _report_sql()))
def q_quality_report(spark, sf):
    long = cut_lineage(R.filter_waves(fx.panel(spark, sf), 3, 14), "long")   # profiled and modelled
    return Q.quality_report(long, incident_targets(long, COND_NAMES), _MISS_COLS, target="target_URGE")


# -- class weights, weights, sampling ---------------------------------------
_CW_COLS = ["pos_rate", "scale_pos_weight", "scale_pos_weight_floor", "weight_neg", "weight_pos"]
_CW_SQL = """
    SELECT task, n_pos, n_neg, CAST(n_pos AS DOUBLE) / (n_pos + n_neg) AS pos_rate,
           CASE WHEN n_pos > 0 THEN CAST(n_neg AS DOUBLE) / n_pos ELSE 1.0 END AS scale_pos_weight,
           CAST(n_neg AS DOUBLE) / greatest(n_pos, 1) AS scale_pos_weight_floor,
           CASE WHEN n_neg > 0 THEN CAST(n_pos + n_neg AS DOUBLE) / (2 * n_neg) END AS weight_neg,
           CASE WHEN n_pos > 0 THEN CAST(n_pos + n_neg AS DOUBLE) / (2 * n_pos) END AS weight_pos
    FROM (SELECT task, count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg
          FROM ts WHERE split = 'train' GROUP BY task) c"""


@query("class_weights", task_split_sql(_CW_SQL, _CW_COLS))
def q_class_weights(spark, sf):
    return rnd(B.class_weights(_train(spark, sf)), _CW_COLS)


@query("row_weights", task_split_sql(f"""
    SELECT t.*, CASE WHEN t.label = 1 THEN w.weight_pos ELSE w.weight_neg END AS weight
    FROM ts t JOIN ({_CW_SQL}) w ON w.task = t.task WHERE t.split = 'train'""", ["weight"]))
def q_row_weights(spark, sf):
    tr = _train(spark, sf)
    return rnd(B.row_weights(tr, B.class_weights(tr), "balanced"), ["weight"])


_H = "('0x' || substr(md5(concat_ws('|', {cols}, '42')), 1, 15))::BIGINT"


@query("row_weights_scale_pos", task_split_sql(f"""
    SELECT t.*, CASE WHEN t.label = 1 THEN w.scale_pos_weight ELSE 1.0::DOUBLE END AS weight
    FROM ts t JOIN ({_CW_SQL}) w ON w.task = t.task WHERE t.split = 'train'""", ["weight"]))
def q_row_weights_scale_pos(spark, sf):
    tr = _train(spark, sf)
    return rnd(B.row_weights(tr, B.class_weights(tr), "scale_pos_weight"), ["weight"])


@query("sample_fraction", oracle(["model"], f"""
    SELECT * EXCLUDE (_h, _r) FROM (
      SELECT *, {_H.format(cols='id, wave')} AS _h,
             row_number() OVER (ORDER BY {_H.format(cols='id, wave')}, id, wave) AS _r FROM model) s
    WHERE _r <= (SELECT greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT)) FROM model)"""))
def q_sample_fraction(spark, sf):
    return B.sample_fraction(fx.model(spark, sf), 0.1, ["id", "wave"])


@query("sample_rows", oracle(["model"], "SELECT * FROM model ORDER BY id, wave LIMIT 500"))
def q_sample_rows(spark, sf):
    return B.sample_rows(fx.model(spark, sf), 500, ["id", "wave"])


@query("undersample", task_split_sql(f"""
    SELECT id, wave, task, label, split FROM (
      SELECT t.*, row_number() OVER (PARTITION BY t.task ORDER BY {_H.format(cols='t.id, t.wave')}, t.id, t.wave) AS _r,
             c.keep FROM ts t JOIN (SELECT task, CAST(floor(3.0 * count(*) FILTER (WHERE label = 1)) AS BIGINT) AS keep
                                    FROM ts WHERE split = 'train' GROUP BY task) c ON c.task = t.task
      WHERE t.split = 'train' AND t.label = 0) n WHERE _r <= keep OR keep = 0
    UNION ALL SELECT id, wave, task, label, split FROM ts WHERE split = 'train' AND label = 1"""))
def q_undersample(spark, sf):
    return B.undersample(_train(spark, sf), "label", 3.0, "task", ["id", "wave"])


@query("oversample", task_split_sql(f"""
    WITH c AS (SELECT task, count(*) FILTER (WHERE label = 1) AS n1,
                      greatest(count(*) FILTER (WHERE label = 1), count(*) FILTER (WHERE label = 0)) AS m
               FROM ts WHERE split = 'train' GROUP BY task),
    p AS (SELECT t.*, c.n1, c.m,
                 row_number() OVER (PARTITION BY t.task ORDER BY {_H.format(cols='t.id, t.wave')}, t.id, t.wave) AS _r
          FROM ts t JOIN c ON c.task = t.task WHERE t.split = 'train' AND t.label = 1)
    SELECT id, wave, task, label, split, 0 AS copy FROM ts WHERE split = 'train' AND label <> 1
    UNION ALL
    SELECT id, wave, task, label, split, CAST(g.copy AS INTEGER) AS copy FROM p,
      range(0, CAST(m // n1 + CASE WHEN _r <= m - (m // n1) * n1 THEN 1 ELSE 0 END AS BIGINT)) AS g(copy)"""))
def q_oversample(spark, sf):
    return B.oversample(_train(spark, sf), "label", 1.0, "task", ["id", "wave"])


@query("importance_nonzero", oracle(["importances"], """
    SELECT count(*) AS n_features, count(*) FILTER (WHERE importance > 0) AS n_nonzero FROM importances"""))
def q_importance_nonzero(spark, sf):
    return Q.nonzero_importance(fx.importances(spark, sf))

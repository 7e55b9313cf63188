"""Queries: scoring metrics on the scored table."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators.balance import class_weights
from . import fixtures as fx
from .q_panel import oracle, rnd
from .registry import query

_PTS = """
    pts AS (SELECT task, prob, count(*) FILTER (WHERE label = 1) AS pos,
                   count(*) FILTER (WHERE label = 0) AS neg
            FROM scored WHERE prob IS NOT NULL GROUP BY task, prob),
    cum AS (SELECT task, prob, CAST(pos AS DOUBLE) AS pos, CAST(neg AS DOUBLE) AS neg,
                   CAST(sum(pos) OVER (PARTITION BY task ORDER BY prob DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS tp,
                   CAST(sum(neg) OVER (PARTITION BY task ORDER BY prob DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS fp,
                   CAST(sum(pos) OVER (PARTITION BY task) AS DOUBLE) AS P,
                   CAST(sum(neg) OVER (PARTITION BY task) AS DOUBLE) AS N FROM pts)"""
_PREV = "CASE WHEN (tp - pos) + (fp - neg) > 0 THEN (tp - pos) / ((tp - pos) + (fp - neg)) ELSE 1.0 END"
_ROC = "sum(pos * ((N - fp) + neg / 2.0)) / (max(P) * max(N))"
_AP = "sum(pos / P * (tp / (tp + fp)))"
_TRAP = f"sum(pos / P * ((tp / (tp + fp)) + {_PREV}) / 2.0)"


def msql(body: str, round_cols=(), nd=6, extra: str = "") -> str:
    head = fx.with_ctes("scored").rstrip() + "," + _PTS + (("," + extra) if extra else "") + "\n"
    if not round_cols:
        return head + body
    rep = ", ".join(f"round({c}, {nd}) AS {c}" for c in round_cols)
    return head + f"SELECT * REPLACE ({rep}) FROM ({body}) q"


def _scored(spark, sf):
    return fx.scored(spark, sf)


@query("roc_auc", msql(f"SELECT task, CASE WHEN max(P) > 0 AND max(N) > 0 THEN {_ROC} END AS roc_auc "
                       "FROM cum GROUP BY task", ["roc_auc"]))
def q_roc_auc(spark, sf):
    return rnd(M.roc_auc(_scored(spark, sf)), ["roc_auc"])


@query("average_precision", msql(f"SELECT task, CASE WHEN max(P) > 0 THEN {_AP} END AS average_precision "
                                 "FROM cum GROUP BY task", ["average_precision"]))
def q_average_precision(spark, sf):
    return rnd(M.average_precision(_scored(spark, sf)), ["average_precision"])


@query("pr_auc_trapezoid", msql(f"SELECT task, CASE WHEN max(P) > 0 THEN {_TRAP} END AS pr_auc "
                                "FROM cum GROUP BY task", ["pr_auc"]))
def q_pr_auc_trapezoid(spark, sf):
    return rnd(M.pr_auc_trapezoid(_scored(spark, sf)), ["pr_auc"])


@query("pr_curve", msql("SELECT task, prob AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, "
                        "tp / (tp + fp) AS precision, CASE WHEN P > 0 THEN tp / P END AS recall FROM cum",
                        ["precision", "recall"]))
def q_pr_curve(spark, sf):
    return rnd(M.pr_curve(_scored(spark, sf)), ["precision", "recall"])


def _fb(tp, fp, fn):
    den = f"(5 * {tp} + 4 * {fn} + {fp})"
    return f"CASE WHEN {den} > 0 THEN CAST(5 * {tp} AS DOUBLE) / {den} ELSE 0.0 END"


@query("fbeta_at_threshold", msql(f"""
    SELECT task, {_fb('tp', 'fp', 'fn')} AS fbeta FROM (
      SELECT task, count(*) FILTER (WHERE prob >= 0.5 AND label = 1) AS tp,
             count(*) FILTER (WHERE prob >= 0.5 AND label = 0) AS fp,
             count(*) FILTER (WHERE prob < 0.5 AND label = 1) AS fn
      FROM scored WHERE label IS NOT NULL GROUP BY task) c""", ["fbeta"]))
def q_fbeta_at_threshold(spark, sf):
    return rnd(M.fbeta_at(_scored(spark, sf), 0.5, 2.0), ["fbeta"])


@query("best_f2_observed", msql(f"""
    SELECT task, prob AS best_threshold, f AS best_fbeta FROM (
      SELECT task, prob, f, row_number() OVER (PARTITION BY task ORDER BY f DESC, prob ASC) AS r FROM (
        SELECT task, prob, {_fb('tp', 'fp', '(P - tp)')} AS f FROM cum WHERE P > 0) a) b
    WHERE r = 1""", ["best_fbeta"]))
def q_best_f2_observed(spark, sf):
    return rnd(M.best_fbeta_observed(_scored(spark, sf), 2.0), ["best_fbeta"])


_GRID = """
    g AS (SELECT i, CAST(0.1 AS DOUBLE) + i * ((CAST(0.1 AS DOUBLE) + CAST(0.01 AS DOUBLE)) - CAST(0.1 AS DOUBLE)) AS t
          FROM range(0, 80) r(i)),
    gc AS (SELECT s.task, g.i, g.t,
                  count(*) FILTER (WHERE s.label = 1 AND s.prob >= g.t) AS tp,
                  count(*) FILTER (WHERE s.label = 0 AND s.prob >= g.t) AS fp,
                  count(*) FILTER (WHERE s.label = 1) AS P
           FROM scored s, g WHERE s.label IS NOT NULL AND s.prob IS NOT NULL GROUP BY s.task, g.i, g.t),
    gf AS (SELECT task, i, t, """ + _fb("tp", "fp", "(P - tp)") + """ AS f FROM gc),
    gb AS (SELECT task, max(f) AS mx, min(t) FILTER (WHERE f = mx_w) AS tb FROM (
             SELECT *, max(f) OVER (PARTITION BY task) AS mx_w FROM gf) z GROUP BY task),
    grid AS (SELECT task, CASE WHEN mx > 0 THEN mx ELSE 0.0 END AS best_fbeta,
                    CASE WHEN mx > 0 THEN tb ELSE 0.5 END AS best_threshold FROM gb)"""


@query("best_f2_grid", msql("SELECT * FROM grid", ["best_fbeta", "best_threshold"], extra=_GRID))
def q_best_f2_grid(spark, sf):
    return rnd(M.best_fbeta_grid(_scored(spark, sf), 2.0), ["best_fbeta", "best_threshold"])


_CR = """
    cr AS (SELECT task, tp, fp, fn, tn,
             CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p1,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r1,
             CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0.0 END AS p0,
             CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS r0,
             tp + fn AS s1, tn + fp AS s0 FROM (
        SELECT task, CAST(count(*) FILTER (WHERE prob >= 0.5 AND label = 1) AS DOUBLE) AS tp,
               CAST(count(*) FILTER (WHERE prob >= 0.5 AND label = 0) AS DOUBLE) AS fp,
               CAST(count(*) FILTER (WHERE prob < 0.5 AND label = 1) AS DOUBLE) AS fn,
               CAST(count(*) FILTER (WHERE prob < 0.5 AND label = 0) AS DOUBLE) AS tn
        FROM scored WHERE label IS NOT NULL GROUP BY task) c),
    cr2 AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0 END AS f0,
                   CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END AS f1, s0 + s1 AS n FROM cr)"""


@query("classification_report", msql("""
    SELECT task, '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, CAST(s0 AS BIGINT) AS support FROM cr2
    UNION ALL SELECT task, '1', p1, r1, f1, CAST(s1 AS BIGINT) FROM cr2
    UNION ALL SELECT task, 'accuracy', NULL, NULL, CASE WHEN n > 0 THEN (tp + tn) / n ELSE 0.0 END, CAST(n AS BIGINT) FROM cr2
    UNION ALL SELECT task, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, CAST(n AS BIGINT) FROM cr2
    UNION ALL SELECT task, 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n,
                     (f0 * s0 + f1 * s1) / n, CAST(n AS BIGINT) FROM cr2""",
                                     ["precision", "recall", "f1"], extra=_CR))
def q_classification_report(spark, sf):
    out = M.classification_report(_scored(spark, sf), 0.5)
    return rnd(out.withColumn("support", F.col("support").cast("long")), ["precision", "recall", "f1"])


@query("evaluate_tasks", msql(f"""
    SELECT c.task,
           CASE WHEN two THEN round(roc, 4) ELSE 0.0 END AS ROC_AUC,
           CASE WHEN two THEN round(pr, 4) ELSE 0.0 END AS PR_AUC,
           CASE WHEN two THEN round(grid.best_fbeta, 4) ELSE 0.0 END AS F2_score,
           CASE WHEN two THEN round(grid.best_threshold, 3) ELSE 0.5 END AS best_threshold,
           n_samples, n_positive
    FROM (SELECT task, {_ROC} AS roc, {_TRAP} AS pr, CAST(max(P) + max(N) AS BIGINT) AS n_samples,
                 CAST(max(P) AS BIGINT) AS n_positive, max(P) > 0 AND max(N) > 0 AS two
          FROM cum GROUP BY task) c JOIN grid ON grid.task = c.task""", extra=_GRID))
def q_evaluate_tasks(spark, sf):
    return M.evaluate_tasks(_scored(spark, sf))


_CLIP = "greatest(least(prob, 1 - CAST(1e-7 AS DOUBLE)), CAST(1e-7 AS DOUBLE))"
_W = """
    cw AS (SELECT task, CASE WHEN n_pos > 0 THEN CAST(n_neg AS DOUBLE) / n_pos ELSE 1.0 END AS pos_weight
           FROM (SELECT task, count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg
                 FROM scored WHERE label IS NOT NULL GROUP BY task) c)"""


@query("weighted_log_loss", msql(f"""
    WITH per AS (SELECT s.task, avg(-(w.pos_weight * s.label * ln({_CLIP}) + (1 - s.label) * ln(1 - {_CLIP}))) AS loss
                 FROM scored s JOIN cw w ON w.task = s.task WHERE s.label IS NOT NULL GROUP BY s.task)
    SELECT task, loss FROM per UNION ALL SELECT '__total__', avg(loss) FROM per""", ["loss"], extra=_W))
def q_weighted_log_loss(spark, sf):
    s = _scored(spark, sf)
    w = class_weights(s).select("task", F.col("scale_pos_weight").alias("pos_weight"))
    return rnd(M.weighted_log_loss(s, w), ["loss"])


_PT = f"({_CLIP} * label + (1 - {_CLIP}) * (1 - label))"


@query("focal_loss", msql(f"""
    SELECT task, avg((0.25 * label + 0.75 * (1 - label)) * pow(1 - {_PT}, 2.0) * -ln({_PT})) AS loss
    FROM scored WHERE label IS NOT NULL GROUP BY task""", ["loss"]))
def q_focal_loss(spark, sf):
    return rnd(M.focal_loss(_scored(spark, sf), 2.0, 0.25), ["loss"])


@query("focal_loss_weighted", msql(f"""
    SELECT s.task, avg((least(w.pos_weight / 20.0::DOUBLE, 0.75::DOUBLE) * label + (1 - least(w.pos_weight / 20.0::DOUBLE, 0.75::DOUBLE)) * (1 - label))
                       * pow(1 - {_PT}, 2.0) * -ln({_PT})) AS loss
    FROM scored s JOIN cw w ON w.task = s.task WHERE s.label IS NOT NULL GROUP BY s.task""", ["loss"], extra=_W))
def q_focal_loss_weighted(spark, sf):
    s = _scored(spark, sf)
    w = class_weights(s).select("task", F.col("scale_pos_weight").alias("pos_weight"))
    return rnd(M.focal_loss(s, 2.0, weights=w), ["loss"])

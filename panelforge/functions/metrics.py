"""Exact, tie-aware scoring metrics per task.

Input: a long table (task, label, prob).  Rows are first reduced to one row
per (task, distinct score) with positive / negative counts (map-side partial
aggregation), then running counts in descending score order come from
``prefix_sums`` (bucketed, no one-partition window).  Every metric is then
a plain aggregate over those curve points:

* ROC-AUC  = sum(pos * (negatives below + ties / 2)) / (P * N)
* AP       = sum(pos / P * precision at that score)
* PR trapezoid = sum(pos / P * (precision + previous precision) / 2),
  the curve anchored at (recall 0, precision 1)
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..conf import FBETA_GRID, FOCAL_ALPHA, FOCAL_GAMMA
from ..session import cut_lineage
from .prefix import join_groups, prefix_sums

EPS = 1e-7


def score_counts(scored: DataFrame, by: str = "task", label: str = "label", score: str = "prob") -> DataFrame:
    """One row per (task, distinct score): pos, neg.  Written once, as every curve reads it several
    times (bounds, running counts, totals)."""
    return cut_lineage(scored.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
                       .groupBy(by, score)
                       .agg(F.count_if(F.col(label) == 1).alias("pos"),
                            F.count_if(F.col(label) == 0).alias("neg")), "score-counts")


def curve_points(scored: DataFrame, by: str = "task", label: str = "label",
                 score: str = "prob", buckets: int | None = None) -> DataFrame:
    """One row per (task, distinct score): pos, neg, tp / fp at threshold
    ``>= score`` and the task totals P, N."""
    return points_of(score_counts(scored, by, label, score), by, score, buckets)


def points_of(pts: DataFrame, by: str = "task", score: str = "prob", buckets: int | None = None) -> DataFrame:
    """Curve points of ``score_counts``."""
    cum = prefix_sums(pts, [by], score, {"tp": F.col("pos"), "fp": F.col("neg")},
                      descending=True, buckets=buckets)
    totals = pts.groupBy(by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return join_groups(cum.withColumnsRenamed({"cum_tp": "tp", "cum_fp": "fp"}), totals, [by])


def _prev_precision():
    tp0 = F.col("tp") - F.col("pos")
    fp0 = F.col("fp") - F.col("neg")
    return F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(F.lit(1.0))


def _curve_aggs():
    P, N = F.col("P"), F.col("N")
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    roc = F.try_divide(F.sum(F.col("pos") * ((N - F.col("fp")) + F.col("neg") / 2.0)),
                       F.first(P) * F.first(N))
    recall_step = F.try_divide(F.col("pos"), P)
    ap = F.sum(recall_step * prec)
    trap = F.sum(recall_step * (prec + _prev_precision()) / 2.0)
    return roc, ap, trap


def roc_auc(scored: DataFrame, by: str = "task", **kw) -> DataFrame:
    """ROC-AUC with ties counted one half; NULL for a single-class task."""
    roc, _, _ = _curve_aggs()
    return (curve_points(scored, by, **kw).groupBy(by)
            .agg(F.when((F.first("P") > 0) & (F.first("N") > 0), roc).alias("roc_auc")))


def average_precision(scored: DataFrame, by: str = "task", **kw) -> DataFrame:
    _, ap, _ = _curve_aggs()
    return (curve_points(scored, by, **kw).groupBy(by)
            .agg(F.when(F.first("P") > 0, ap).alias("average_precision")))


def pr_auc_trapezoid(scored: DataFrame, by: str = "task", **kw) -> DataFrame:
    _, _, trap = _curve_aggs()
    return (curve_points(scored, by, **kw).groupBy(by)
            .agg(F.when(F.first("P") > 0, trap).alias("pr_auc")))


def pr_curve(scored: DataFrame, by: str = "task", **kw) -> DataFrame:
    """Precision / recall at every distinct score threshold."""
    return (curve_points(scored, by, **kw)
            .select(by, F.col(kw.get("score", "prob")).alias("threshold"), "tp", "fp",
                    (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                    F.try_divide(F.col("tp"), F.col("P")).alias("recall")))


def _fbeta(tp, fp, fn, beta: float):
    b2 = beta * beta
    den = (1 + b2) * tp + b2 * fn + fp
    return F.when(den > 0, (1 + b2) * tp / den).otherwise(F.lit(0.0))


def fbeta_at(scored: DataFrame, threshold: float = 0.5, beta: float = 2.0, by: str = "task",
             label: str = "label", score: str = "prob") -> DataFrame:
    """F-beta of ``score >= threshold``; 0 when undefined."""
    pred = F.col(score) >= threshold
    y = F.col(label) == 1
    c = (scored.filter(F.col(label).isNotNull()).groupBy(by)
         .agg(F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"),
              F.count_if(~pred & y).alias("fn")))
    return c.select(by, _fbeta(F.col("tp"), F.col("fp"), F.col("fn"), beta).alias("fbeta"))


def best_fbeta_observed(scored: DataFrame, beta: float = 2.0, by: str = "task", **kw) -> DataFrame:
    """Best F-beta over the observed scores (thresholds from the lowest
    positive score up); among equal maxima the lowest threshold wins."""
    pts = curve_points(scored, by, **kw)
    score = kw.get("score", "prob")
    f = _fbeta(F.col("tp"), F.col("fp"), F.col("P") - F.col("tp"), beta)
    cand = pts.filter(F.col("P") > 0).withColumn("f", f)
    # thresholds below the lowest positive score cannot win (same tp, more fp)
    return (cand.groupBy(by)
            .agg(F.max_by(F.col(score), F.struct(F.col("f"), -F.col(score))).alias("best_threshold"),
                 F.max("f").alias("best_fbeta")))


def grid_thresholds(lo=FBETA_GRID[0], hi=FBETA_GRID[1], step=FBETA_GRID[2]):
    """numpy.arange(lo, hi, step) as (n, delta): values are lo + i * delta."""
    import math
    delta = (lo + step) - lo
    n = int(math.ceil((hi - lo) / step))
    return n, delta


def best_fbeta_grid(scored: DataFrame, beta: float = 2.0, by: str = "task", label: str = "label",
                    score: str = "prob", grid=FBETA_GRID) -> DataFrame:
    """Best F-beta over the fixed grid; strict improvement from 0.0, so the
    lowest threshold wins ties and 0.5 is kept when nothing beats 0."""
    rows = scored.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).select(
        by, score, (F.col(label) == 1).cast("long").alias("pos"), (F.col(label) == 0).cast("long").alias("neg"))
    return _best_on_grid(rows, beta, by, score, grid)


def _best_on_grid(counts: DataFrame, beta: float, by: str, score: str, grid=FBETA_GRID) -> DataFrame:
    """The same from rows with the numbers of positives and negatives at a score."""
    n, delta = grid_thresholds(*grid)
    lo = grid[0]

    def t(i):
        return F.lit(lo) + i * F.lit(delta)

    p = F.col(score)
    b0 = F.least(F.greatest(F.floor((p - F.lit(lo)) / F.lit(delta)) + 1, F.lit(0)), F.lit(n)).cast("int")
    b1 = F.when((b0 < n) & (p >= t(b0)), b0 + 1).otherwise(b0)
    b2 = F.when((b1 > 0) & (p < t(b1 - 1)), b1 - 1).otherwise(b1)
    hist = counts.groupBy(by, b2.alias("b")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # per task at most n + 1 rows: sums above each grid point in one small aggregate
    per_task = hist.groupBy(by).agg(
        F.collect_list(F.struct("b", "pos", "neg")).alias("h"),
        F.sum("pos").alias("P"))
    grid_i = per_task.select(by, "P", "h", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    above = F.filter("h", lambda r: r["b"] >= F.col("i") + 1)
    tp = F.aggregate(above, F.lit(0).cast("long"), lambda acc, r: acc + r["pos"])
    fp = F.aggregate(above, F.lit(0).cast("long"), lambda acc, r: acc + r["neg"])
    scoredg = grid_i.select(by, "i", _fbeta(tp, fp, F.col("P") - tp, beta).alias("f"))
    best = scoredg.groupBy(by).agg(F.max("f").alias("best_f"),
                                   F.max_by("i", F.struct(F.col("f"), -F.col("i"))).alias("best_i"))
    return best.select(
        by, F.when(F.col("best_f") > 0, F.col("best_f")).otherwise(F.lit(0.0)).alias("best_fbeta"),
        F.when(F.col("best_f") > 0, t(F.col("best_i"))).otherwise(F.lit(0.5)).alias("best_threshold"))


def classification_report(scored: DataFrame, threshold: float = 0.5, by: str = "task",
                          label: str = "label", score: str = "prob") -> DataFrame:
    """Per task and class: precision, recall, F1, support; accuracy, macro and
    weighted averages (zero when undefined)."""
    pred = F.col(score) >= threshold
    y = F.col(label) == 1
    c = (scored.filter(F.col(label).isNotNull()).groupBy(by)
         .agg(F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"),
              F.count_if(~pred & y).alias("fn"), F.count_if(~pred & ~y).alias("tn")))

    def div(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    def f1(pr, rc):
        return F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(F.lit(0.0))

    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p1, r1 = div(tp, tp + fp), div(tp, tp + fn)
    p0, r0 = div(tn, tn + fn), div(tn, tn + fp)
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1
    m = c.select(by, p0.alias("p0"), r0.alias("r0"), f1(p0, r0).alias("f0"), s0.alias("s0"),
                 p1.alias("p1"), r1.alias("r1"), f1(p1, r1).alias("f1"), s1.alias("s1"),
                 div(tp + tn, n).alias("acc"), n.alias("n"))
    rows = ("stack(5, '0', p0, r0, f0, s0, '1', p1, r1, f1, s1, "
            "'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), acc, n, "
            "'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n, "
            "'weighted avg', try_divide(p0 * s0 + p1 * s1, n), try_divide(r0 * s0 + r1 * s1, n), "
            "try_divide(f0 * s0 + f1 * s1, n), n) AS (class, precision, recall, f1, support)")
    return m.selectExpr(by, rows)


def evaluate_tasks(scored: DataFrame, by: str = "task", label: str = "label", score: str = "prob",
                   beta: float = 2.0) -> DataFrame:
    """Per task: ROC-AUC, trapezoid PR-AUC, best grid F2 and its threshold,
    sample and positive counts.  A single-class task reports 0, 0, 0, 0.5."""
    roc, _, trap = _curve_aggs()
    counts = score_counts(scored, by, label, score)
    curve = (points_of(counts, by, score).groupBy(by)
             .agg(roc.alias("_roc"), trap.alias("_pr"),
                  F.first("P").alias("n_positive"), (F.first("P") + F.first("N")).alias("n_samples")))
    grid = _best_on_grid(counts, beta, by, score)
    two = (F.col("n_positive") > 0) & (F.col("n_positive") < F.col("n_samples"))
    return (join_groups(curve, grid, [by]).select(
        by,
        F.when(two, F.round("_roc", 4)).otherwise(F.lit(0.0)).alias("ROC_AUC"),
        F.when(two, F.round("_pr", 4)).otherwise(F.lit(0.0)).alias("PR_AUC"),
        F.when(two, F.round("best_fbeta", 4)).otherwise(F.lit(0.0)).alias("F2_score"),
        F.when(two, F.round("best_threshold", 3)).otherwise(F.lit(0.5)).alias("best_threshold"),
        F.col("n_samples").cast("long").alias("n_samples"),
        F.col("n_positive").cast("long").alias("n_positive")))


def _clip(p):
    return F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))


def weighted_log_loss(scored: DataFrame, weights: DataFrame | None = None, by: str = "task",
                      label: str = "label", score: str = "prob") -> DataFrame:
    """Per task mean of -(w y log p + (1 - y) log(1 - p)) over labelled rows
    (``weights``: (task, pos_weight); 1 when absent), plus the mean over the
    tasks present as task ``__total__``."""
    s = scored.filter(F.col(label).isNotNull())
    if weights is not None:
        s = s.join(weights.select(by, "pos_weight"), by, "left")
    else:
        s = s.withColumn("pos_weight", F.lit(1.0))
    p = _clip(F.col(score))
    y = F.col(label).cast("double")
    w = F.coalesce(F.col("pos_weight"), F.lit(1.0))
    per = s.groupBy(by).agg(F.avg(-(w * y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("loss"))
    total = per.agg(F.lit("__total__").alias(by), F.avg("loss").alias("loss"))
    return per.unionByName(total)


def focal_loss(scored: DataFrame, gamma: float = FOCAL_GAMMA, alpha: float = FOCAL_ALPHA,
               weights: DataFrame | None = None, by: str = "task", label: str = "label",
               score: str = "prob") -> DataFrame:
    """Mean focal loss per task; with ``weights`` alpha = min(w / 20, 0.75)."""
    s = scored.filter(F.col(label).isNotNull())
    if weights is not None:
        s = s.join(weights.select(by, "pos_weight"), by, "left")
        a = F.least(F.coalesce(F.col("pos_weight"), F.lit(1.0)) / 20.0, F.lit(0.75))
    else:
        a = F.lit(alpha)
    p = _clip(F.col(score))
    y = F.col(label).cast("double")
    pt = p * y + (1 - p) * (1 - y)
    at = a * y + (1 - a) * (1 - y)
    return s.groupBy(by).agg(F.avg(at * F.pow(1 - pt, F.lit(gamma)) * -F.ln(pt)).alias("loss"))

import pytest
from pyspark.sql import functions as F

from panelforge.functions import metrics as M
from panelforge.operators.balance import class_weights, oversample, sample_fraction, undersample
from panelforge.operators.smote import smote


def _scored(spark, rows):
    return spark.createDataFrame(rows, "task string, label int, prob double")


def _one(df, col):
    return df.first()[col]


def test_perfect_separation(spark):
    s = _scored(spark, [("DIABE", y, p) for y, p in zip([0, 0, 0, 1, 1], [.1, .2, .3, .8, .9])]
                + [("HIBPE", y, p) for y, p in zip([0, 1, 0, 1, 1], [.2, .7, .1, .9, .8])])
    ev = {r.task: r for r in M.evaluate_tasks(s).collect()}
    assert set(ev) == {"DIABE", "HIBPE"}
    for r in ev.values():
        assert r.ROC_AUC == 1.0 and r.PR_AUC == 1.0
    ap = {r.task: r.average_precision for r in M.average_precision(s).collect()}
    assert ap == {"DIABE": 1.0, "HIBPE": 1.0}


def test_ties_golden(spark):
    s = _scored(spark, [("T", 0, .1), ("T", 0, .2), ("T", 0, .3), ("T", 1, .3), ("T", 1, .9)])
    assert abs(_one(M.roc_auc(s), "roc_auc") - 0.916667) < 1e-6
    assert abs(_one(M.average_precision(s), "average_precision") - 0.833333) < 1e-6
    assert abs(_one(M.pr_auc_trapezoid(s), "pr_auc") - 0.916667) < 1e-6


def test_constant_score_and_single_class(spark):
    s = _scored(spark, [("T", 1, .5)] * 3 + [("T", 0, .5)] * 7 + [("S", 0, .4)] * 4)
    assert abs(_one(M.pr_auc_trapezoid(s.filter("task = 'T'")), "pr_auc") - (1 + 0.3) / 2) < 1e-12
    ev = {r.task: r for r in M.evaluate_tasks(s).collect()}
    assert (ev["S"].ROC_AUC, ev["S"].PR_AUC, ev["S"].F2_score, ev["S"].best_threshold) == (0.0, 0.0, 0.0, 0.5)
    assert ev["S"].n_samples == 4 and ev["S"].n_positive == 0


def test_grid_and_observed_fbeta(spark):
    s = _scored(spark, [("T", 0, .05), ("T", 1, .35), ("T", 0, .6), ("T", 1, .95)])
    g = M.best_fbeta_grid(s).first()
    # any threshold in (0.05, 0.35] keeps both positives and drops one negative:
    # F2 = 5*2 / (5*2 + 0 + 1); the lowest grid point doing that is 0.1
    assert abs(g.best_fbeta - 10 / 11) < 1e-12 and abs(g.best_threshold - 0.1) < 1e-12
    o = M.best_fbeta_observed(s).first()
    assert o.best_threshold == .35 and abs(o.best_fbeta - 10 / 11) < 1e-12
    assert abs(_one(M.fbeta_at(s, 0.5), "fbeta") - 5 / (5 + 4 + 1)) < 1e-12
    rep = {r["class"]: r for r in M.classification_report(s).collect()}
    assert rep["accuracy"].f1 == 0.5 and rep["1"].support == 2


def test_losses_positive(spark):
    s = _scored(spark, [("T", 1, 0.7310585786), ("T", 0, 0.2689414214), ("T", 1, 0.880797), ("T", 0, 0.119203)])
    assert _one(M.focal_loss(s), "loss") > 0
    w = spark.createDataFrame([("T", 5.0)], "task string, pos_weight double")
    ll = {r.task: r.loss for r in M.weighted_log_loss(s, w).collect()}
    assert ll["T"] > 0 and ll["__total__"] == ll["T"]


def test_class_weights(spark):
    rows = ([("DIABE", 0)] * 146 + [("DIABE", 1)] * 10 + [("HIBPE", 0)] * 80 + [("HIBPE", 1)] * 10
            + [("CANCR", 0)] * 200 + [("CANCR", 1)] * 5 + [("NONE", 0)] * 3)
    cw = {r.task: r.scale_pos_weight for r in
          class_weights(spark.createDataFrame(rows, "task string, label int")).collect()}
    assert cw == {"DIABE": 14.6, "HIBPE": 8.0, "CANCR": 40.0, "NONE": 1.0}


def test_sampling_exact_sizes(spark):
    df = spark.range(1000).select(F.col("id"), F.lit(1).alias("wave"))
    assert sample_fraction(df, 0.1, ["id", "wave"]).count() == 100
    assert sample_fraction(df, 0.0001, ["id", "wave"]).count() == 1
    a = {r.id for r in sample_fraction(df, 0.1, ["id", "wave"]).collect()}
    b = {r.id for r in sample_fraction(df.repartition(7), 0.1, ["id", "wave"]).collect()}
    assert a == b                                      # independent of partitioning
    with pytest.raises(ValueError):
        sample_fraction(df, 1.5, ["id"])
    lab = spark.createDataFrame([("T", i, 1 if i < 10 else 0) for i in range(100)], "task string, id long, label int")
    assert undersample(lab, ratio=3.0).groupBy("label").count().orderBy("label").collect()[0]["count"] == 30
    over = oversample(lab, ratio=1.0)
    assert over.filter("label = 1").count() == 90 and over.filter("label = 0").count() == 90


def test_smote_fixture(spark):
    rows = [("T", i, 0, float(1 + i % 3), float(2 + i % 3)) for i in range(300)]
    rows += [("T", 1000 + i, 1, 10.0, 20.0) for i in range(10)]
    df = spark.createDataFrame(rows, "task string, id long, label int, a double, b double").withColumn("wave", F.lit(3))
    out = smote(df, ["a", "b"])
    ones = out.filter("label = 1")
    assert ones.count() == 99                          # floor(300 * 0.33)
    assert ones.filter("synthetic").filter("a != 10 OR b != 20").count() == 0
    assert out.filter("label = 0").count() == 300
    # already balanced beyond the ratio: explicit no-op
    bal = df.filter("label = 0 AND id < 20").unionByName(df.filter("label = 1"))
    assert smote(bal, ["a", "b"]).count() == bal.count()

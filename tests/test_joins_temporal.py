import pytest

from panelforge.operators.joins import align_tasks, compare_runs, feature_presence, merge_person
from panelforge.operators.temporal import (median_impute, missingness_features, temporal_delta,
                                           temporal_impute, temporal_pct_change)


def test_merge_person_basic(spark):
    model = spark.createDataFrame([(101, 3, 0.0, 10), (101, 4, 1.0, 11), (102, 3, 0.0, 20), (102, 4, 0.0, 21)],
                                  "id long, wave int, target_DIABE double, feat_a int")
    fam = spark.createDataFrame([(101, 100.0, 1), (102, 200.0, 2), (103, 300.0, 3)],
                                "id long, fam_x double, fam_y int")
    out = merge_person(model, fam).orderBy("id", "wave").collect()
    assert len(out) == 4
    assert [r.fam_x for r in out] == [100.0, 100.0, 200.0, 200.0]
    assert [r.fam_y for r in out] == [1, 1, 2, 2]
    assert 103 not in {r.id for r in out}


def test_merge_person_alt_key_and_overlap(spark):
    left = spark.createDataFrame([(1, 3, 10)], "id long, wave int, x int")
    right = spark.createDataFrame([(1, 99)], "HHIDPN int, fam_z int")
    assert merge_person(left, right).first().fam_z == 99
    left = spark.createDataFrame([(1, 3, .1), (2, 3, .2)], "id long, wave int, score double")
    right = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id long, score double")
    out = merge_person(left, right).orderBy("id").collect()
    assert [r.score for r in out] == [.1, .2] and [r.score_fam for r in out] == [1.0, 2.0]
    with pytest.raises(ValueError):
        merge_person(left, spark.createDataFrame([(1,)], "pid long"))


def test_temporal_delta(spark):
    df = spark.createDataFrame([(1, 3, 25.0, 150), (1, 4, 26.0, 155), (1, 5, 27.5, 160), (2, 3, 30.0, 200),
                                (2, 4, 29.0, 198)], "id int, wave int, BMI double, WEIGHT int")
    out = temporal_delta(df).orderBy("id", "wave").collect()
    assert [r.BMI_delta for r in out] == [None, 1.0, 1.5, None, -1.0]
    assert out[4].WEIGHT_delta == -2


def test_pct_change_pads_and_divides_safely(spark):
    vals = [0.0, 5.0, None, 10.0, 10.0]
    df = spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(vals)], "id int, wave int, X double")
    pad = [r.X_pct_change for r in temporal_pct_change(df, ["X"]).orderBy("wave").collect()]
    assert pad == [None, None, 0.0, 1.0, 0.0]        # inf (5/0) is NULL, padded gap is 0
    raw = [r.X_pct_change for r in temporal_pct_change(df, ["X"], pad=False).orderBy("wave").collect()]
    assert raw == [None, None, None, None, 0.0]


def test_impute_and_missingness(spark):
    df = spark.createDataFrame([(1, 1, None, 1.0), (1, 2, 2.0, None), (1, 3, None, None), (2, 1, 8.0, 4.0)],
                               "id int, wave int, a double, b double")
    t = {(r.id, r.wave): (r.a, r.b) for r in temporal_impute(df, ["a", "b"]).collect()}
    assert t[(1, 1)] == (2.0, 1.0) and t[(1, 3)] == (2.0, 1.0)
    m = {(r.id, r.wave): (r.a, r.b) for r in median_impute(df, ["a", "b"]).collect()}
    assert m[(1, 1)][0] == 5.0 and m[(1, 2)][1] == 2.5
    f = missingness_features(df, ["a", "b"]).orderBy("id", "wave").collect()
    assert [r.missing_pct for r in f] == [50.0, 50.0, 100.0, 0.0]
    assert [r.missing_change for r in f][:3] == [None, 0.0, 50.0]
    assert f[2].missing_accel == 50.0


def test_align_compare_presence(spark):
    a = spark.createDataFrame([(1, 3, 1), (2, 3, 0)], "id long, wave int, label int")
    b = spark.createDataFrame([(2, 3, 1), (3, 3, 0)], "id long, wave int, label int")
    out = {(r.id, r.wave): (r.A, r.B) for r in align_tasks({"A": a, "B": b}).collect()}
    assert out == {(1, 3): (1, None), (2, 3): (0, 1), (3, 3): (None, 0)}
    m = spark.createDataFrame([("X", 0.7, 0.2), ("Y", 0.6, 0.1)], "task string, roc double, pr double")
    s = spark.createDataFrame([("X", 0.5, 0.0)], "task string, roc double, pr double")
    c = {r.task: r for r in compare_runs(m, s).collect()}
    assert abs(c["X"].roc_pct - 40.0) < 1e-9 and c["X"].pr_pct == 0.0 and c["Y"].roc_diff is None
    want = spark.createDataFrame([("f1",), ("f2",)], "feature string")
    have = spark.createDataFrame([("f1",)], "feature string")
    assert {r.feature: r.present for r in feature_presence(want, have).collect()} == {"f1": True, "f2": False}
    with pytest.raises(ValueError):
        feature_presence(want, have, strict=True)

import itertools

from pyspark.sql import functions as F

from panelforge.operators.reshape import columns_for_wave, wide_to_long
from panelforge.operators.targets import build_target_one, duplicate_keys, incident_targets


def test_prefix_rule():
    cols = ["HHIDPN", "R1AB", "R10AB", "R1", "RAGENDER", "H1X", "R2AB", "R11AB"]
    assert columns_for_wave(cols, 1) == ["R1AB", "R1"]
    assert columns_for_wave(cols, 10) == ["R10AB"]
    assert columns_for_wave(cols, 2) == ["R2AB"]
    assert columns_for_wave(cols, 11) == ["R11AB"]


def test_wide_to_long_outer_union_and_nan(spark):
    df = spark.createDataFrame(
        [(1, 1.0, float("nan"), 5, None), (2, None, None, None, None)],
        "HHIDPN long, R1BMI double, R2BMI double, R2ONLY int, RAGENDER int")
    long = wide_to_long(df)
    rows = {(r.id, r.wave): r for r in long.collect()}
    assert len(rows) == 4                      # every person, every wave, even all-NULL
    assert rows[(1, 1)].BMI == 1.0 and rows[(1, 1)].ONLY is None
    assert rows[(1, 2)].BMI is None            # NaN became NULL
    assert rows[(1, 2)].ONLY == 5
    assert "GENDER" not in long.columns and "AGENDER" not in long.columns
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan              # a narrow projection, no shuffle


def _truth(cur, n1, n2):
    if cur != 0:
        return None
    if n1 == 1 or n2 == 1:
        return 1
    if n1 == 0 and n2 == 0:
        return 0
    return None


def test_target_truth_table(spark):
    vals = [0.0, 1.0, None, 3.0]
    rows, expect = [], {}
    for i, (c, a, b) in enumerate(itertools.product(vals, repeat=3)):
        rows += [(i, 3, c), (i, 4, a), (i, 5, b)]
        expect[i] = _truth(c, a, b)
    df = spark.createDataFrame(rows, "id long, wave int, X double")
    out = incident_targets(df, ["X"], max_wave=3).collect()
    got = {r.id: r.target_X for r in out}
    assert got == expect


def test_lookahead_by_wave_number_with_gap(spark):
    # wave 4 missing for id 1: t+1 of wave 3 is absent, t+2 (wave 5) decides
    df = spark.createDataFrame([(1, 3, 0.0), (1, 5, 1.0), (2, 3, 0.0), (2, 4, 0.0)],
                               "id long, wave int, X double")
    got = {(r.id, r.wave): r.target_X for r in incident_targets(df, ["X"], max_wave=12).collect()}
    assert got[(1, 3)] == 1
    assert got[(2, 3)] is None      # t+2 absent and no event: unknown
    assert got[(2, 4)] is None      # last wave: nothing ahead


def test_single_condition_form_and_absent(spark):
    df = spark.createDataFrame([(1, 3, 0.0), (1, 4, 0.0), (1, 5, 0.0)], "id long, wave int, X double")
    assert build_target_one(df, "Y") is None
    assert build_target_one(df, "X").columns == ["id", "wave", "target_X"]


def test_eight_targets_one_exchange(spark):
    cols = [f"C{i}" for i in range(8)]
    df = spark.range(100).select(F.col("id"), F.explode(F.sequence(F.lit(3), F.lit(14))).alias("wave"),
                                 *[(F.col("id") % 2).cast("double").alias(c) for c in cols]).repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = incident_targets(df, cols)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Window [") == 1


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(1, 3), (1, 3), (2, 3)], "id long, wave int")
    assert duplicate_keys(df).count() == 1

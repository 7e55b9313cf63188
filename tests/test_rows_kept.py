"""Rows in = rows out for ranks and resampling: NULL groups, NULL keys, one-class tasks."""
import pytest
from pyspark.sql import functions as F

from panelforge.functions import metrics as M
from panelforge.functions.prefix import global_rank, prefix_sums
from panelforge.operators.balance import oversample, undersample

ROWS = [("A", 1, 3.0), ("A", 2, None), ("A", 3, 1.0), (None, 4, 2.0), (None, 5, 5.0), ("N", 6, None), ("N", 7, None)]


def frame(spark):
    return spark.createDataFrame(ROWS, "grp string, id long, x double")


@pytest.mark.parametrize("buckets", [None, 1, 2, 300])
@pytest.mark.parametrize("descending", [True, False])
def test_rank_keeps_null_groups_and_keys(spark, buckets, descending):
    got = {r.id: r.pos for r in global_rank(frame(spark), "x", descending, ["id"], ["grp"], buckets).collect()}
    nulls_last = descending
    key = lambda r: ((r[2] is None) == nulls_last, (-r[2] if descending else r[2]) if r[2] is not None else 0, r[1])
    want = {}
    for g in {r[0] for r in ROWS}:
        for pos, r in enumerate(sorted((r for r in ROWS if r[0] == g), key=key), 1):
            want[r[1]] = pos
    assert got == want
    assert global_rank(frame(spark), "x", descending, ["id"], None, buckets).count() == len(ROWS)


def test_bucket_number_is_checked(spark):
    with pytest.raises(ValueError):
        global_rank(frame(spark), "x", buckets=10_000_000)


def test_prefix_sums_many_buckets(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("g"), (F.col("id") * 37 % 1009).alias("k"))
    got = prefix_sums(df, ["g"], "k", {"n": F.lit(1)}, descending=False, tiebreak=["k"], buckets=512)
    last = got.groupBy("g").agg(F.max("cum_n").alias("m"), F.count("*").alias("c")).collect()
    assert all(r.m == r.c for r in last) and len(last) == 7


def labelled(spark):
    rows = [("A", i, 1 if i < 3 else 0) for i in range(20)] + [("A", 20, None), (None, 21, 1), (None, 22, 0), (None, 23, None)]
    rows += [("Z", 30 + i, 0) for i in range(5)] + [("P", 40 + i, 1) for i in range(4)]
    return spark.createDataFrame(rows, "task string, id long, label int")


def count(df, **want):
    cond = F.lit(True)
    for c, v in want.items():
        cond = cond & F.col(c).eqNullSafe(F.lit(v))
    return df.filter(cond).count()


def test_undersample_keeps_what_it_must(spark):
    df = labelled(spark)
    out = undersample(df, "label", 2.0, "task", ["id"])
    assert out.columns == df.columns
    assert count(out, task="A", label=1) == 3 and count(out, task="A", label=0) == 6 and count(out, task="A", label=None) == 1
    assert count(out, task=None) == 3 and count(out, task="Z") == 5 and count(out, task="P") == 4


def test_oversample_keeps_every_row(spark):
    df = labelled(spark)
    out = oversample(df, "label", 1.0, "task", ["id"])
    assert out.filter("copy = 0").count() == df.count()
    assert count(out, task="A", label=1) == 17 and count(out, task=None) == 3 and count(out, task="Z") == 5 and count(out, task="P") == 4


def test_curve_of_a_null_task(spark):
    s = spark.createDataFrame([(None, 1, 0.9), (None, 0, 0.1), ("T", 1, 0.2), ("T", 0, 0.8)], "task string, label int, prob double")
    got = {r.task: r.ROC_AUC for r in M.evaluate_tasks(s).collect()}
    assert got == {None: 1.0, "T": 0.0}


def test_runs_do_not_depend_on_partitions(spark):
    """The fixture's sums are exact, so results can't change with the order of summation."""
    from conftest import SF
    from panelforge.operators.joins import compare_runs
    from panelforge.operators.runs import per_task_metrics
    from panelforge.plans import fixtures as fx
    read, seen = fx.read_table, set()
    try:
        for n in (1, 3, 8, 16):
            fx.read_table = lambda s, p, n=n: read(s, p).repartition(n)
            r = fx.runs(spark, SF).filter("run_id <= 'run_2'")
            seen.add(tuple(sorted(map(tuple, r.select("run_id", "task", "roc", "pr", "f2", "time_sec").collect()))))
    finally:
        fx.read_table = read
    assert len(seen) == 1
    r = fx.runs(spark, SF)
    assert compare_runs(per_task_metrics(r, F.col("family") == "mlp"), per_task_metrics(r, F.col("family") == "resnet")).count() > 0


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from panelforge.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"
        getConf, getCheckpointDir = (lambda self: Conf()), (lambda self: None)

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())


def test_person_side_must_be_unique(spark):
    from panelforge.operators.joins import merge_person
    panel = spark.createDataFrame([(1, 3), (1, 4)], "id long, wave int")
    side = spark.createDataFrame([(1, "a"), (1, "b")], "id long, x string")
    # the check is part of the plan: it fails the job that reads the result, and adds no exchange to the join's
    merged = merge_person(panel, side)
    with pytest.raises(Exception, match="more than one row for 1"):
        merged.collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = merge_person(panel, side)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(id") == 2 and plan.count("Window") >= 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    gone = merge_person(panel, spark.createDataFrame([(1, "a"), (None, "b"), (None, "c"), (7, "d")], side.schema))
    assert sorted(map(tuple, gone.collect())) == [(1, 3, "a"), (1, 4, "a")]
    assert merge_person(panel, side, check_unique=False).count() == 4


def test_joined_values_skip_nulls(spark):
    from panelforge.functions.scalars import joined_truncated
    rows = [("g", None)] * 50 + [("g", f"{i:03d}") for i in range(40)]
    df = spark.createDataFrame(rows, "g string, v string")
    full = "".join(f"{i:03d}" for i in range(40))
    for sep in ("", ";", ", "):
        want = sep.join(f"{i:03d}" for i in range(40))
        got = joined_truncated(df, "g", "v", 20, sep).first().joined
        assert got == want[:20] + "..."
    assert joined_truncated(df, "g", "v", 200, "").first().joined == full

"""Model jobs (E1-E8), SMOTE neighbours, sources."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.conf import RunConfig
from panelforge.operators.joins import experiment_grid
from panelforge.operators.neighbours import exact_neighbours
from panelforge.operators.smote import adasyn, smote
from panelforge.plans import models as MD
from panelforge.session import cut_lineage, scratch_path
from panelforge.sources import files as IO

PARAMS = {"lr": {"max_iter": 10}, "rf": {"n_estimators": 5, "max_depth": 3}, "gbt": {"n_estimators": 3, "max_depth": 2},
          "mlp": {"max_iter": 30, "hidden": [4]}}


def separable(spark, constant=False):
    x = F.lit(1.0) if constant else F.when(F.col("id") % 4 == 0, 2.0).otherwise(-2.0) + (F.col("id") % 5) / 10.0
    rows = spark.range(60).select("id", F.explode(F.sequence(F.lit(3), F.lit(12))).alias("wave"))
    return rows.select("id", F.col("wave").cast("int").alias("wave"), x.alias("x"), (F.col("id") % 3).cast("double").alias("y"),
                       (F.col("id") % 4 == 0).cast("int").alias("target_T"))


@pytest.mark.parametrize("model", ["lr", "rf", "gbt", "mlp"])
def test_models_on_a_separable_set(spark, model):
    row = MD.run_condition(separable(spark), RunConfig("T", model, ["x", "y"], params=PARAMS[model]), []).first()
    assert row.ROC_AUC == 1.0 and row.F2_score == 1.0 and row.model_type == model


@pytest.mark.parametrize("model", ["rf", "gbt"])
def test_constant_features_give_chance(spark, model):
    d = separable(spark, constant=True).withColumn("y", F.lit(0.0))
    row = MD.run_condition(d, RunConfig("T", model, ["x", "y"], params=PARAMS[model]), []).first()
    assert row.ROC_AUC == 0.5


def test_run_writes_its_outputs_and_leaves_no_cache(spark):
    out = scratch_path(spark, "run-test")
    before = len(spark.sparkContext._jsc.sc().getRDDStorageInfo())
    row = MD.run_condition(separable(spark), RunConfig("T", "gbt", ["x", "nope"], sample_rows=500, params=PARAMS["gbt"]), [], out_dir=out).first()
    assert len(spark.sparkContext._jsc.sc().getRDDStorageInfo()) == before
    rec = spark.read.json(f"{out}/record").first()
    assert rec.F2_score == row.F2_score and rec.features[0] == "wave"
    imp = IO.read_importances(spark, f"{out}/importances")
    assert {r.feature for r in imp.collect()} >= {"wave", "x"}
    assert IO.read_run_log(spark, f"{out}/log").count() == 3


def test_run_errors(spark):
    d = separable(spark)
    for cfg in (RunConfig("NOPE"), RunConfig("T", features=["zz"]), RunConfig("T", "bogus", ["x"])):
        with pytest.raises(ValueError):
            MD.run_condition(d, cfg, [])


def rare(spark):
    """The separable set with positives so rare that SMOTE has work to do."""
    return separable(spark).withColumn("target_T", (F.col("id") % 12 == 0).cast("int")).withColumn(
        "x", F.when(F.col("id") % 12 == 0, 2.0).otherwise(-2.0) + (F.col("id") % 5) / 10.0)


@pytest.mark.parametrize("model", ["lr", "rf", "gbt", "mlp"])
def test_smote_runs_of_every_model(spark, model):
    cfg = RunConfig("T", model, ["x", "y"], params=PARAMS[model])
    row = MD.run_condition(rare(spark), cfg, [], use_smote=True).first()
    assert row.ROC_AUC == 1.0


@pytest.mark.parametrize("model", ["lr", "mlp", "gbt"])
def test_scored_rows_keep_their_keys(spark, model):
    d = rare(spark)
    _, names, scored = MD.train_eval(d, ["wave", "x"], "target_T", model, PARAMS[model], use_smote=model == "lr")
    assert names[:2] == ["wave", "x"]
    want = {(r.id, r.wave, r.target_T) for r in d.filter("wave >= 10").collect()}
    assert {(r.id, r.wave, r.label) for r in scored.collect()} == want and scored.count() == len(want)


def test_weighting_of_a_run(spark):
    d = rare(spark).withColumn("x", F.col("x") + F.when(F.col("id") % 7 == 0, 3.0).otherwise(0.0))
    coefs = {}
    for w in ("balanced", "scale_pos_weight"):
        model, _, _ = MD.train_eval(d, ["x"], "target_T", "lr", {"max_iter": 30, "reg": 0.01}, weighting=w)
        coefs[w] = (model.coefficients[0], model.intercept)
    assert np.allclose(coefs["balanced"], coefs["scale_pos_weight"], atol=1e-3)   # the same weights but for their sum
    with pytest.raises(ValueError):
        MD.train_eval(d, ["x"], "target_T", "lr", weighting="no")


def test_run_config_from_a_file(spark, tmp_path):
    said = {"target_suffix": "T", "model": {"type": "rf", "params": {"max_depth": 2}}, "feature_columns": ["x"], "sample_rows": 9}
    (tmp_path / "a.json").write_text(__import__("json").dumps(said))
    cfg = IO.read_run_config(spark, str(tmp_path / "a.json"))
    assert cfg == RunConfig("T", "rf", ["x"], sample_rows=9, params={"max_depth": 2})
    yaml = pytest.importorskip("yaml")
    (tmp_path / "b.yaml").write_text(yaml.safe_dump(said))
    assert IO.read_run_config(spark, str(tmp_path / "b.yaml")) == cfg
    (tmp_path / "c.json").write_text("[1]")
    with pytest.raises(ValueError):
        IO.read_run_config(spark, str(tmp_path / "c.json"))
    assert RunConfig.from_mapping({}) == RunConfig("DIABE", "lr")


def test_sweep_reports_failed_runs(spark):
    grid = experiment_grid(spark.createDataFrame([("lr",), ("bogus",)], "model string"), ["all", "absent"], smote=(False,))
    got = {(r.model, r.feature_set): r for r in MD.run_sweep(separable(spark), grid, {"all": ["x", "y"]}, "T", PARAMS).collect()}
    assert got["lr", "all"].roc == 1.0 and got["lr", "all"].error is None and "bogus" in got["bogus", "all"].error
    assert got["lr", "absent"].error.startswith("KeyError") and len(got) == 4


def test_sweep_goes_on_where_it_stopped(spark, monkeypatch):
    """Killed halfway, a sweep repeats no run; runs that failed are run again only on demand."""
    out, ran, true_run = scratch_path(spark, "sweep-test"), [], MD.run_condition
    grid = experiment_grid(spark.createDataFrame([("lr",), ("gbt",), ("rf",)], "model string"), ["one", "two"], smote=(False,))
    sets = {"one": ["x"], "two": ["x", "y"]}

    def run(df, cfg, *a, **kw):
        if len(ran) == 3:
            raise KeyboardInterrupt
        ran.append((cfg.model_type, tuple(cfg.features)))
        if cfg.model_type == "gbt" and len(cfg.features) == 1:
            raise RuntimeError("lost")
        return true_run(df, cfg, *a, **kw)

    monkeypatch.setattr(MD, "run_condition", run)
    with pytest.raises(KeyboardInterrupt):
        MD.run_sweep(separable(spark), grid, sets, "T", PARAMS, threads=1, out_dir=out)
    assert len(ran) == 3
    first = list(ran)
    again = []
    monkeypatch.setattr(MD, "run_condition", lambda df, cfg, *a, **kw: (again.append((cfg.model_type, tuple(cfg.features))), true_run(df, cfg, *a, **kw))[1])
    got = MD.run_sweep(separable(spark), grid, sets, "T", PARAMS, out_dir=out).collect()
    assert len(again) == 3 and not set(again) & set(first) and len(got) == 6
    assert [r.error for r in got if r.error] == ["RuntimeError: lost"]
    written = spark.read.json(f"{out}/results")
    assert written.count() == 6 and written.filter("roc = 1.0").count() == 5
    del again[:]
    got = MD.run_sweep(separable(spark), grid, sets, "T", PARAMS, out_dir=out, retry_errors=True).collect()
    assert again == [("gbt", ("x",))] and len(got) == 6 and not any(r.error for r in got)


def test_run_log_reads_back_once(spark):
    root = scratch_path(spark, "log-test")
    assert IO.read_run_log(spark, root).count() == 0
    rows = spark.createDataFrame([("e", r, k, f"{k}{i}", float(i), None, None) for r in ("a", None) for k in ("params", "metrics") for i in (1, 2)], IO.RUN_LOG_SCHEMA)
    IO.log_run(rows.filter("kind = 'params'"), root)
    IO.log_run(rows.filter("kind = 'metrics'"), root)
    IO.log_run(rows.filter("run_id = 'a'"), root)
    rows.write.parquet(f"{root}/attempts/attempt=dead")        # an attempt that died before its commit
    assert sorted(map(str, IO.read_run_log(spark, root).collect())) == sorted(map(str, rows.collect()))
    IO.log_run(rows.filter("run_id = 'a' AND key = 'metrics1'"), root)   # a later, shorter record replaces its kind
    assert sorted(r.key for r in IO.read_run_log(spark, root).filter("run_id = 'a'").collect()) == ["metrics1", "params1", "params2"]


def test_shared_fit_equals_single_fits(spark):
    """Coefficients of conditions fitted together are those of each alone; some labels are missing."""
    rng = np.random.default_rng(9)
    n = 2400
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2] + [0, 40, 1]
    p = 1 / (1 + np.exp(-(x[:, 0] - 0.2 * (x[:, 1] - 40) + 2 * (x[:, 2] - 1))))
    rows = [(i, 3 + i % 10, *map(float, v), *[None if (i + t) % 5 == 0 else int(rng.random() < q ** (1 + 2 * t)) for t in range(3)])
            for i, (v, q) in enumerate(zip(x, p))]
    df = spark.createDataFrame(rows, "id long, wave int, a double, b double, c double, t0 int, t1 int, t2 int").repartition(4)
    feats, targets = ["a", "b", "c"], ["t0", "t1", "t2"]
    fitted = MD.fit_conditions(df, feats, targets)
    scored = MD.score_conditions(df, fitted)
    for t, name in enumerate(targets):
        model, _, alone = MD.train_eval(df, feats, name, "lr", {"max_iter": 200}, task=name)
        assert np.allclose(fitted.coef[t], model.coefficients.toArray(), atol=2e-4) and abs(fitted.intercept[t] - model.intercept) < 2e-4
        mine = {r.id: (r.label, r.prob) for r in scored.filter(F.col("task") == name).collect()}
        for r in alone.collect():
            assert mine.pop(r.id) == (r.label, pytest.approx(r.prob, abs=1e-4))
        assert not mine
    assert fitted.iterations < 15
    with pytest.raises(ValueError):
        MD.fit_conditions(df.withColumn("t0", F.lit(None).cast("int")), feats, targets)
    one = MD.fit_conditions(df.withColumn("t0", F.lit(1)), feats, ["t0"])
    assert one.coef.tolist() == [[0, 0, 0]] and MD.score_conditions(df.withColumn("t0", F.lit(1)), one).filter("prob < 0.99").count() == 0


def clouds(spark, n=1500, dims=6):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dims)) + rng.integers(0, 3, (n, 1)) * 3
    rows = [("t" if i % 2 else None, i, 0, int(i % 10 < 2), *map(float, v)) for i, v in enumerate(x)]
    cols = [f"c{i}" for i in range(dims)]
    return spark.createDataFrame(rows, "task string, id long, wave int, label int, " + ", ".join(f"{c} double" for c in cols)), cols, x


def pool_of(spark, x, group, flag, query):
    rows = [(g, i, (i * 7919) % 1009, bool(q), bool(f), v) for i, (v, g, f, q) in enumerate(zip(x.tolist(), group, flag, query))]
    return spark.createDataFrame(rows, "g string, row long, n long, query boolean, flag boolean, v array<double>").repartition(6)


def brute_neighbours(x, group, query, k):
    """By query row the row numbers of its k nearest: by distance, hash of the key, row number."""
    n, out = (np.arange(len(x)) * 7919) % 1009, {}
    for i in np.nonzero(query)[0]:
        own = np.nonzero((group == group[i]) & (np.arange(len(x)) != i))[0]
        d = ((x[i] - x[own]) ** 2).sum(1)
        out[i] = own[np.lexsort((own, n[own], d))[:k]].tolist()
    return out


def check_neighbours(spark, x, group, flag, query, k, **kw):
    got = exact_neighbours(pool_of(spark, x, group, flag, query), k, **kw).collect()
    want = brute_neighbours(x, group, query, k)
    assert {r.row: [a.row for a in r.near] for r in got} == want
    for r in got:
        assert [a.d for a in r.near] == [((x[r.row] - x[j]) ** 2).sum() for j in want[r.row]]
        assert [a.flag for a in r.near] == [bool(flag[j]) for j in want[r.row]]


def test_neighbours_equal_brute_force_64_dimensions(spark):
    """5,000 rows of 64 dimensions in one group, 20 times the block."""
    x = np.random.default_rng(4).normal(size=(5000, 64))
    every = np.ones(5000, bool)
    check_neighbours(spark, x, np.array(["=t"] * 5000), every, every, 5, block=256, queries=2000)


def test_neighbours_of_a_skewed_group(spark):
    """Minority rows (1 %) ask, every row answers; clusters, copies, a small group and one row alone."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 8)) + rng.integers(0, 9, (4000, 1)) * 4
    x[3000:3100] = x[0]           # 100 copies: ties at distance 0
    x[::41] = x[1::41][:len(x[::41])]
    group = np.array(["=a"] * 3960 + ["-"] * 39 + ["=b"])
    flag = rng.random(4000) < 0.01
    flag[[0, 3000, 3999]] = True
    check_neighbours(spark, x, group, flag, flag, 5, block=100, queries=7)
    check_neighbours(spark, x, group, flag, flag, 5)


def test_queries_are_sent_to_tiles_in_bounded_batches(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(6000, 16))
    every = np.ones(6000, bool)
    pool = cut_lineage(pool_of(spark, x, np.array(["=t"] * 6000), every, every))
    made, plain = [], type(pool).mapInArrow
    monkeypatch.setattr(type(pool), "mapInArrow", lambda df, f, *a: made.append((df, f)) or plain(df, f, *a))
    exact_neighbours(pool, 5, block=100)
    first, visits = made[1]      # after dealing rows to cells
    sent = [b.num_rows for b in visits(first.toArrow().combine_chunks().to_batches())]
    assert max(sent) <= 4096 and sum(sent) <= 6000 * 4      # four tiles of 16 blocks


@pytest.mark.parametrize("over", [smote, adasyn])
def test_synthetic_totals_and_range(spark, over):
    df, cols, x = clouds(spark, 400)
    df = df.withColumn("c0", F.when(F.col("id") % 7 != 0, F.col("c0"))).unionByName(
        df.limit(1).withColumn("label", F.lit(None).cast("int")).withColumn("id", F.lit(9999).cast("long")))
    out = over(df, cols)
    assert out.filter("NOT synthetic").count() == df.count()
    for task in ("t", None):
        own = out.filter(F.col("task").eqNullSafe(F.lit(task)))
        n1, n0 = own.filter("NOT synthetic AND label = 1").count(), own.filter("NOT synthetic AND label = 0").count()
        new = own.filter("synthetic")
        assert new.count() == max(0, int(0.33 * max(n0, n1)) - min(n0, n1))
        assert new.filter("c0 IS NULL").count() == 0


def test_adasyn_risk_equals_brute_force(spark):
    from panelforge.operators.smote import risk_share, search_pool
    df, cols, x = clouds(spark, 900)
    pool = cut_lineage(search_pool(df.withColumn("_row", F.col("id")), cols, "task", ["id", "wave"], F.col("label") == 1))
    got = exact_neighbours(pool.withColumn("query", F.col("flag")), 5, block=64).select("row", risk_share(F.col("near")).alias("risk")).collect()
    label = np.arange(len(x)) % 10 < 2
    assert len(got) == label.sum()
    for r in got:
        own = np.array([i for i in range(len(x)) if i % 2 == r.row % 2 and i != r.row])
        nearest = own[np.argsort(((x[own] - x[r.row]) ** 2).sum(1))[:5]]
        assert r.risk == (~label[nearest]).sum() / 5


def test_synthetic_rows_lie_between_nearest_minority_rows(spark):
    df, cols, x = clouds(spark, 600)
    df = df.filter("task = 't'")
    minority = np.array([i for i in range(len(x)) if i % 2 and i % 10 < 2])
    for r in smote(df, cols, block=32).filter("synthetic").collect():
        y, a = np.array([r[c] for c in cols]), x[r.id]
        others = minority[minority != r.id]
        near = others[np.argsort(((x[others] - a) ** 2).sum(1))[:5]]
        gaps = []
        for b in x[near]:
            t = np.dot(y - a, b - a) / np.dot(b - a, b - a)
            gaps.append(np.abs(a + t * (b - a) - y).max() if 0 <= t <= 1 else np.inf)
        assert min(gaps) < 1e-9


def test_run_records_report_rejects(spark):
    root = scratch_path(spark, "records-test")
    spark.createDataFrame([('{"a": 1, "b": {"c": "x"}}',)], "value string").coalesce(1).write.text(f"{root}/good")
    spark.createDataFrame([("{broken",)], "value string").coalesce(1).write.text(f"{root}/bad")
    spark.createDataFrame([('{"a": 7}',)], "value string").coalesce(1).write.text(f"{root}/summary")
    from pyspark.sql.types import _parse_datatype_string
    good, bad = IO.read_runs(spark, root, _parse_datatype_string("a int, b struct<c:string>"), skip="/summary/", glob=None)
    assert [(r.a, r.b.c) for r in good.collect()] == [(1, "x")]
    (r,) = bad.collect()
    assert "/bad/" in r.path and "broken" in r.reason


def test_malformed_metric_lines(spark):
    root = scratch_path(spark, "tracking-test")
    spark.createDataFrame([("1000 0.5 1",), ("oops",), ("2000 x 2",)], "value string").coalesce(1).write.text(
        f"{root}/experiment=e/run_id=r/kind=metrics/key=auc")
    got = sorted(((r.value, r.step) for r in IO.read_tracking(spark, root).collect()), key=str)
    assert got == sorted([(0.5, 1), (None, None), (None, 2)], key=str)


def test_packed_logs_read_as_the_tree_does(spark):
    logs = spark.createDataFrame([("e", "r", "metrics", "auc", "1000 0.5 1\n2000 0.6 2"), ("e", "r", "metrics", "f2", "oops"), (None, "s", "params", "", "0.1"),
                                  ("e", "s", "params", "note", ""), ("e", "s", "params", "none", None), ("e", "s", "other", "k", "1")],
                                 "experiment string, run_id string, kind string, key string, value string")
    tree, packed = scratch_path(spark, "tree"), scratch_path(spark, "packed")
    logs.write.partitionBy("experiment", "run_id", "kind", "key").text(tree)
    IO.pack_tracking(logs, packed)
    want = sorted(map(str, IO.read_tracking(spark, tree).collect()))
    assert len(want) == 4 and sorted(map(str, IO.read_tracking(spark, packed).collect())) == want
    IO.pack_tracking(logs, tree)
    assert sorted(map(str, IO.read_tracking(spark, tree).collect())) == sorted(want * 2)


def some_events(spark, users):
    """A folder with the events of so many users, two kinds each."""
    sf = scratch_path(spark, "events")
    spark.range(2 * users).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1600000000) + F.col("id")).alias("ts"), F.floor(F.col("id") / 2).alias("user_id"),
        F.when(F.col("id") % 2 == 0, "view").otherwise("click").alias("event_type"), ((F.col("id") % 50) / 100).alias("value")).write.parquet(f"{sf}/events.parquet")
    return sf


@pytest.mark.parametrize("name,rows", [("scan_tracking", 3), ("tracking_runs", 1), ("scan_run_records", 1)])
def test_files_of_runs_do_not_grow_with_the_runs(spark, monkeypatch, name, rows):
    from panelforge.plans import q_sources
    from panelforge.plans.registry import load_all
    made = []
    monkeypatch.setattr(q_sources, "scratch_path", lambda s, n: made.append(scratch_path(s, n)) or made[-1])
    for users in (30, 300):
        out = load_all()[name][0](spark, some_events(spark, users))
        got = out.collect()
        assert len(got) == rows * users and len({r[0] if name == "scan_run_records" else r.run_id for r in got}) == users
    files = [sum(n.startswith("part-") for r in (root, f"{root}-lines") for _, _, names in os.walk(r.removeprefix("file:")) for n in names) for root in made]
    assert len(files) == 2 and files[1] <= files[0] + 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_wide_schema(spark):
    """800 concepts through reshape and missingness, 200 through the quality report."""
    from panelforge.operators.quality import missingness, quality_report
    from panelforge.operators.reshape import wide_to_long
    concepts = [f"C{i}" for i in range(800)]
    df = spark.range(20).select(F.col("id").alias("HHIDPN"), *[
        (F.col("id") * 3 + w if i % 9 else F.lit(None).cast("long")).alias(f"R{w}{c}") for w in (1, 2) for i, c in enumerate(concepts)])
    long = cut_lineage(wide_to_long(df))   # a plan over thousands of columns is worth cutting
    assert long.count() == 40
    assert missingness(long, concepts).count() == 800
    some = concepts[:200]
    few = long.select("id", "wave", *some)
    report = quality_report(few, few.withColumn("target_X", F.lit(1)), some).filter("section = 'missingness' AND metric = 'count'")
    assert report.count() == 200


def test_statistics_of_very_many_columns(spark, monkeypatch):
    """830 columns x 14 waves through balance, statistics and report, and both plans agree on few columns."""
    import time
    from panelforge.operators import quality as Q
    cols = [f"C{i}" for i in range(830)]
    df = cut_lineage(spark.range(200 * 14).select((F.col("id") % 200).alias("id"), (F.col("id") / 200 + 1).cast("int").alias("wave"), *[
        F.when((F.col("id") + i) % 7 != 0, (F.col("id") * 3 + i) % 11).alias(c) for i, c in enumerate(cols)],
        *[F.when(F.col("id") % 5 != i % 5, (F.col("id") + i) % 2).alias(f"target_{i}") for i in range(80)]))
    start = time.monotonic()
    assert Q.feature_stats(df, cols).count() == 830 and Q.target_balance(df).count() == 80
    assert Q.quality_report(df.select("id", "wave"), df, cols).filter("section = 'feature_stats'").count() == 3 * 830
    assert time.monotonic() - start < 30
    some, few = cols[:5] + ["gone"], df.select("id", "wave", "C0", "C1", F.col("C2").cast("string").alias("C2"), "C3", "C4", "target_0", "target_1")
    said = lambda f: sorted(map(str, f.collect()))
    made = lambda: [said(Q.feature_stats(few, some)), said(Q.target_balance(few)), said(Q.quality_report(few, few, some, target="target_0"))]
    narrow = made()
    monkeypatch.setattr(Q, "WIDE", 1)
    assert made() == narrow

"""Joins (J4-J10).

Equi-joins are declared and left to the planner: with AQE a side that turns
out small at runtime becomes a broadcast, otherwise a sort-merge join; a
panel that is already hash-partitioned by ``id`` (after the target window)
is not shuffled again for a join on ``id``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalise_key(side: DataFrame, key: str = "id", alt_key: str = "HHIDPN",
                  key_type: T.DataType | None = None) -> DataFrame:
    """Rename ``alt_key`` to ``key`` when needed and cast it to ``key_type``."""
    if key not in side.columns:
        if alt_key in side.columns:
            side = side.withColumnRenamed(alt_key, key)
        else:
            raise ValueError(f"side table has no {key!r} or {alt_key!r} column: {side.columns[:20]}")
    if key_type is not None and side.schema[key].dataType != key_type:
        side = side.withColumn(key, F.col(key).cast(key_type))
    return side


def merge_person(panel: DataFrame, person: DataFrame, key: str = "id",
                 alt_key: str = "HHIDPN", suffix: str = "_fam", check_unique: bool = True) -> DataFrame:
    """Left-join a one-row-per-person table onto the panel.

    Unmatched panel rows keep NULLs, persons absent from the panel are
    dropped, and side columns whose name is already in the panel get
    ``suffix``.  A key that occurs twice would multiply panel rows: it is an
    error of the job that reads the result (``check_unique``).  The check counts the side's
    rows by key over the partitioning and order that the join asks for, so it adds no shuffle and
    runs nothing while the plan is built.
    """
    person = normalise_key(person, key, alt_key, panel.schema[key].dataType)
    if check_unique:
        rows = Window.partitionBy(key)
        twice = F.raise_error(F.concat(F.lit("the person table has more than one row for "), F.col(key).cast("string")))
        # rows without a key match nothing
        person = (person.filter(F.col(key).isNotNull()).withColumn("_rows", F.count(F.lit(1)).over(rows))
                  .filter(F.when(F.col("_rows") > 1, twice.cast("boolean")).otherwise(True)).drop("_rows"))
    overlap = (set(panel.columns) - {key}) & (set(person.columns) - {key})
    if overlap:
        person = person.withColumnsRenamed({c: f"{c}{suffix}" for c in overlap})
    return panel.join(person, key, "left")


def overlapping_columns(panel: DataFrame, person: DataFrame, key: str = "id") -> list[str]:
    return sorted((set(panel.columns) - {key}) & (set(person.columns) - {key}))


def align_tasks(frames: dict[str, DataFrame], on=("id", "wave"), value: str = "label") -> DataFrame:
    """Align per-task row sets on their key: one row per key in any task,
    one column per task, NULL where a task lacks the row.

    Instead of a chain of full outer joins (one shuffle each) the frames are
    stacked and pivoted: one shuffle whatever the number of tasks.
    """
    tasks = list(frames)
    stacked = None
    for t, df in frames.items():
        part = df.select(*on, F.lit(t).alias("_task"), F.col(value).alias("_v"))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy(*on).pivot("_task", tasks).agg(F.first("_v"))


def align_targets(model: DataFrame, targets: list[str], on=("id", "wave"),
                  prefix: str = "target_") -> DataFrame:
    """``align_tasks`` of the labelled rows of each target, without a frame per
    task: the keys with any label and one column per task, in one pass over the
    model table (whose keys are unique)."""
    names = {t: t[len(prefix):] if t.startswith(prefix) else t for t in targets}
    any_label = F.coalesce(*[F.col(t) for t in targets]).isNotNull()
    return model.filter(any_label).select(*on, *[F.col(t).alias(n) for t, n in names.items()])


def task_frames(model: DataFrame, targets: list[str], on=("id", "wave"),
                prefix: str = "target_") -> dict[str, DataFrame]:
    """Per-task labelled rows (non-NULL target) of a model table."""
    return {t[len(prefix):] if t.startswith(prefix) else t:
            model.filter(F.col(t).isNotNull()).select(*on, F.col(t).alias("label"))
            for t in targets}


def compare_runs(a: DataFrame, b: DataFrame, on: str = "task",
                 metrics=("roc", "pr"), names=("multi", "single")) -> DataFrame:
    """Compare two per-task metric tables: ``a`` rows are kept; missing ``b``
    gives NULL differences; the percentage is 0 when the base is not positive."""
    na, nb = names
    left = a.select(on, *[F.col(m).alias(f"{na}_{m}") for m in metrics])
    right = b.select(on, *[F.col(m).alias(f"{nb}_{m}") for m in metrics])
    out = left.join(right, on, "left")
    cols = {}
    for m in metrics:
        diff = F.col(f"{na}_{m}") - F.col(f"{nb}_{m}")
        base = F.col(f"{nb}_{m}")
        cols[f"{m}_diff"] = diff
        cols[f"{m}_pct"] = F.when(base.isNull(), None).when(
            base > 0, F.try_divide(diff, base) * 100).otherwise(F.lit(0.0))
    return out.withColumns(cols)


def improvement_summary(cmp: DataFrame, metrics=("roc", "pr")) -> DataFrame:
    """Mean percentage change, wins per metric and number of comparable rows."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(f"{m}_pct").alias(f"mean_{m}_pct"),
                 F.count_if(F.col(f"{m}_diff") > 0).alias(f"{m}_better")]
    aggs.append(F.count(f"{metrics[0]}_diff").alias("total"))
    return cmp.agg(*aggs)


def feature_presence(want: DataFrame, have: DataFrame, col: str = "feature",
                     strict: bool = False) -> DataFrame:
    """Requested features flagged present / absent (left join on the name).

    ``strict`` raises when anything is missing (an action on the anti join).
    """
    h = have.select(F.col(col)).distinct().withColumn("_present", F.lit(True))
    out = (want.select(col).join(h, col, "left")
           .select(col, F.coalesce("_present", F.lit(False)).alias("present")))
    if strict:
        missing = [r[0] for r in want.join(have, col, "left_anti").select(col).take(20)]
        if missing:
            raise ValueError(f"features missing from data: {missing}")
    return out


def experiment_grid(models: DataFrame, feature_sets: list[str], smote=(False, True),
                    model_col: str = "model") -> DataFrame:
    """Models x feature sets x SMOTE flag, built with generators (no join)."""
    fs = F.array(*[F.lit(s) for s in feature_sets])
    sm = F.array(*[F.lit(bool(s)) for s in smote])
    return (models.select(model_col).distinct()
            .withColumn("feature_set", F.explode(fs))
            .withColumn("use_smote", F.explode(sm))
            .withColumn("experiment", F.concat_ws("_", F.col(model_col), "feature_set",
                                                  F.when(F.col("use_smote"), "smote")
                                                  .otherwise("nosmote"))))

"""Temporal split, per-task split, standardisation.

Rows keep their (id, wave) key throughout: features and labels are never
aligned by position.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..conf import SplitSpec


def split_column(time: str = "wave", spec: SplitSpec = SplitSpec()):
    t = F.col(time)
    return (F.when(t.between(*spec.train), F.lit("train"))
             .when(t.between(*spec.val), F.lit("val")))


def temporal_split(df: DataFrame, time: str = "wave", spec: SplitSpec = SplitSpec(),
                   check: bool = False) -> DataFrame:
    """Add ``split`` (train / val); rows outside both ranges are dropped.

    ``check=True`` fails when the training side is empty (one bounded action).
    """
    out = df.withColumn("split", split_column(time, spec)).filter(F.col("split").isNotNull())
    if check and not out.filter(F.col("split") == "train").take(1):
        raise ValueError(f"no training rows in waves {spec.train[0]}-{spec.train[1]}")
    return out


def unpivot_targets(df: DataFrame, targets: list[str], keep=("id", "wave"),
                    prefix: str = "target_") -> DataFrame:
    """(keep..., task, label) with one row per labelled (row, task)."""
    body = ", ".join(f"'{t[len(prefix):] if t.startswith(prefix) else t}', CAST(`{t}` AS INT)"
                     for t in targets)
    cols = [f"`{k}`" for k in keep]
    return (df.selectExpr(*cols, f"stack({len(targets)}, {body}) AS (task, label)")
            .filter(F.col("label").isNotNull()))


def task_split(df: DataFrame, targets: list[str], keep=("id", "wave"), time: str = "wave",
               spec: SplitSpec = SplitSpec()) -> DataFrame:
    """Per task labelled rows with their split; tasks lacking rows on either
    side are dropped (semi join with the tasks that have both)."""
    long = temporal_split(unpivot_targets(df, targets, keep), time, spec)
    ok = (long.groupBy("task").agg(F.count_if(F.col("split") == "train").alias("_tr"),
                                   F.count_if(F.col("split") == "val").alias("_va"))
          .filter((F.col("_tr") > 0) & (F.col("_va") > 0)).select("task"))
    # one row per task: bounded by the number of tasks
    return long.join(F.broadcast(ok), "task", "left_semi")


def fit_standardizer(train: DataFrame, cols: list[str]) -> DataFrame:
    """One row: mean and population std of each column; a zero std becomes 1."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    stats = train.agg(*aggs)
    return stats.withColumns({f"{c}__std": F.when(F.col(f"{c}__std") > 0, F.col(f"{c}__std"))
                              .otherwise(F.lit(1.0)) for c in cols})


def standardize(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None,
                fill: float | None = None) -> DataFrame:
    """(x - mean) / std with statistics of ``fit_on`` (e.g. the train rows),
    applied to every row of ``df``.  ``fill`` replaces missing values first
    (the neural-net policy fills 0 before scaling)."""
    src = fit_on if fit_on is not None else df
    if fill is not None:
        src = src.fillna(fill, subset=cols)
        df = df.fillna(fill, subset=cols)
    stats = fit_standardizer(src, cols).withColumn("_one", F.lit(1))
    # a single statistics row: broadcast of bounded size
    joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(stats), "_one")
    scaled = joined.withColumns({c: (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std")
                                 for c in cols})
    return scaled.drop("_one", *[f"{c}__{s}" for c in cols for s in ("mean", "std")])

"""Small column helpers used across the pipeline."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def title_label(x: Column) -> Column:
    """``DIABE_roc_auc`` -> ``Diabe Roc Auc`` (underscores to spaces, title case)."""
    return F.initcap(F.regexp_replace(x, "_", " "))


def run_label(ts: Column | str, fmt: str = "yyyyMMdd_HHmm") -> Column:
    """Time stamp label of a run, e.g. ``20260214_1918``."""
    return F.date_format(ts, fmt)


def truncate(x: Column, n: int = 447, ellipsis: str = "...") -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit(ellipsis))).otherwise(x)


def joined_truncated(df: DataFrame, by: str, value: str, n: int = 447, sep: str = ", ") -> DataFrame:
    """Per group: the values joined with ``sep`` in sorted order, cut to ``n``
    characters plus ``...``; NULL values are left out.  Each value takes at least
    the separator's length (empty ones are left out if that is 0), so only the
    first values that can reach the cut are collected per group."""
    least = max(1, len(sep))
    kept = df.filter(F.col(value).isNotNull() if sep else F.length(value) > 0)
    w = Window.partitionBy(by).orderBy(value)
    head = kept.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n // least + 2)
    joined = F.array_join(F.array_sort(F.collect_list(value)), sep)
    return head.groupBy(by).agg(truncate(joined, n).alias("joined"))

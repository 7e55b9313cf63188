"""Class weights, reproducible exact-size sampling, resampling.

Random choices use an md5 of (key, seed): reproducible, independent of
partitioning, and portable to SQL.  "The n smallest hashes" is found with
the bucketed running count of ``functions.prefix`` - no global sort into one
task, no driver round trip.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import RANDOM_STATE
from ..functions.prefix import global_rank, join_groups
from ..session import cut_lineage


HASH_RANGE = (0.0, float(1 << 60))   # md5_hash is uniform on [0, 2^60)


def md5_hash(cols: list[str], seed: int = RANDOM_STATE) -> Column:
    """A 60-bit non-negative integer from md5(key columns | seed)."""
    s = F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("long")


# -- A7, B4 -----------------------------------------------------------------
def class_weights(scored: DataFrame, by: str = "task", label: str = "label") -> DataFrame:
    """Per task: counts, positive rate, scale_pos_weight = n_neg / n_pos
    (1.0 without positives), the variant n_neg / max(n_pos, 1), and the
    "balanced" weights n / (2 n_class)."""
    c = scored.filter(F.col(label).isNotNull()).groupBy(by).agg(
        F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))
    n = F.col("n_pos") + F.col("n_neg")
    return c.select(
        by, "n_pos", "n_neg",
        F.try_divide(F.col("n_pos"), n).alias("pos_rate"),
        F.when(F.col("n_pos") > 0, F.col("n_neg") / F.col("n_pos")).otherwise(F.lit(1.0))
         .alias("scale_pos_weight"),
        (F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1))).alias("scale_pos_weight_floor"),
        F.try_divide(n, 2 * F.col("n_neg")).alias("weight_neg"),
        F.try_divide(n, 2 * F.col("n_pos")).alias("weight_pos"))


def row_weights(df: DataFrame, weights: DataFrame, mode: str = "balanced", by: str = "task",
                label: str = "label") -> DataFrame:
    """Attach a ``weight`` column: balanced (n / (2 n_class)) or
    scale_pos_weight (positives weighted n_neg / n_pos, negatives 1)."""
    w = weights.select(by, "weight_neg", "weight_pos", "scale_pos_weight")
    j = df.join(w, by, "left")
    if mode == "balanced":
        wt = F.when(F.col(label) == 1, F.col("weight_pos")).otherwise(F.col("weight_neg"))
    elif mode == "scale_pos_weight":
        wt = F.when(F.col(label) == 1, F.col("scale_pos_weight")).otherwise(F.lit(1.0))
    else:
        raise ValueError(f"unknown weight mode {mode!r}")
    return j.withColumn("weight", wt).drop("weight_neg", "weight_pos", "scale_pos_weight")


# -- L4 ---------------------------------------------------------------------
def _hash_ranked(df: DataFrame, keys: list[str], seed: int, by: list[str] | None = None) -> DataFrame:
    """``_pos``: position by (hash, keys) within ``by``."""
    h = df.withColumn("_h", md5_hash(keys, seed))
    return global_rank(h, "_h", descending=False, tiebreak=keys, by=by, name="_pos", key_range=HASH_RANGE).drop("_h")


def sample_fraction(df: DataFrame, fraction: float, keys: list[str], seed: int = RANDOM_STATE) -> DataFrame:
    """Exactly max(1, int(N * fraction)) rows, chosen by hash order."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    df = cut_lineage(df, "sample")   # the table is counted and ranked
    n = df.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(fraction)).cast("long")).alias("_n"))
    return join_groups(_hash_ranked(df, keys, seed), n, []).filter(F.col("_pos") <= F.col("_n")).drop("_pos", "_n")


def sample_rows(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """The first ``n`` rows by key (a distributed top-n)."""
    return df.orderBy(*keys).limit(n)


# -- D4 ---------------------------------------------------------------------
def _with_counts(df: DataFrame, by: str, label: str, keys: list[str], seed: int) -> DataFrame:
    """Rows with the class counts of their task (``_n1``, ``_n0``) and their position by hash among
    the rows of their task and label; a NULL task is a task, a NULL label a class of its own."""
    df = cut_lineage(df, "balance")   # the table is counted and ranked
    counts = df.groupBy(by).agg(F.count_if(F.col(label) == 1).alias("_n1"),
                                F.count_if(F.col(label) == 0).alias("_n0"))
    return join_groups(_hash_ranked(df, keys, seed, [by, label]), counts, [by])


def undersample(df: DataFrame, label: str = "label", ratio: float = 3.0, by: str = "task",
                keys: list[str] = ("id",), seed: int = RANDOM_STATE) -> DataFrame:
    """Keep at most floor(``ratio`` x positives) negatives per task, chosen by
    hash order.  Positives and rows without a label always stay, and a task
    without positives has nothing to balance against, so all its rows stay."""
    d = _with_counts(df, by, label, list(keys), seed)
    keep = (F.col("_n1") == 0) | (F.col("_pos") <= F.floor(F.col("_n1") * F.lit(ratio)))
    return d.filter(~F.coalesce(F.col(label) == 0, F.lit(False)) | keep).select(*df.columns)


def oversample(df: DataFrame, label: str = "label", ratio: float = 1.0, by: str = "task",
               keys: list[str] = ("id",), seed: int = RANDOM_STATE) -> DataFrame:
    """Replicate positives until positives = floor(ratio x negatives) per
    task: every positive k times, the first r (hash order) once more.
    Adds ``copy`` (0 = original).  Tasks already at the ratio, tasks without
    positives and rows without a label are unchanged."""
    d = _with_counts(df, by, label, list(keys), seed)
    want = F.greatest(F.floor(F.col("_n0") * F.lit(ratio)).cast("long"), F.col("_n1"))
    k = F.floor(want / F.col("_n1"))
    reps = k + F.when(F.col("_pos") <= want - k * F.col("_n1"), 1).otherwise(0)
    reps = F.when(F.col(label) == 1, reps).otherwise(F.lit(1))
    return (d.withColumn("copy", F.explode(F.sequence(F.lit(0), (reps - 1).cast("int"))))
            .select(*df.columns, "copy"))

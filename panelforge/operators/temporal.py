"""Per-subject temporal features and imputation.

All windows partition by the subject key, so a panel that is already hash
partitioned by ``id`` (e.g. after the target window) is not shuffled again,
and one window specification serves every column.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import TEMPORAL_FEATURES_BASE


def _w(key: str, time: str):
    return Window.partitionBy(key).orderBy(time)


def temporal_delta(df: DataFrame, cols: list[str] | None = None, key: str = "id",
                   time: str = "wave") -> DataFrame:
    """``<c>_delta`` = value minus the previous row's value of the same
    subject (previous *row*: gaps are not filled); absent columns skipped."""
    cols = [c for c in (cols or TEMPORAL_FEATURES_BASE) if c in df.columns]
    w = _w(key, time)
    return df.withColumns({f"{c}_delta": F.col(c) - F.lag(c).over(w) for c in cols})


def _padded(c: str, key: str, time: str) -> Column:
    return F.last(c, ignorenulls=True).over(
        _w(key, time).rowsBetween(Window.unboundedPreceding, 0))


def temporal_pct_change(df: DataFrame, cols: list[str] | None = None, pad: bool = True,
                        key: str = "id", time: str = "wave") -> DataFrame:
    """``<c>_pct_change`` = value / previous - 1 within the subject.

    ``pad=True`` forward-fills missing values first (pandas' default), so a
    missing value after a present one yields 0.  Division by zero gives NULL
    (not infinity).
    """
    cols = [c for c in (cols or TEMPORAL_FEATURES_BASE) if c in df.columns]
    w = _w(key, time)
    out = {}
    for c in cols:
        cur = _padded(c, key, time) if pad else F.col(c)
        prev = F.lag(cur, 1).over(w) if not pad else None
        if pad:
            # lag of the padded series = padded value up to the previous row
            prev = F.last(c, ignorenulls=True).over(
                _w(key, time).rowsBetween(Window.unboundedPreceding, -1))
        out[f"{c}_pct_change"] = F.try_divide(cur.cast("double"), prev.cast("double")) - 1
    return df.withColumns(out)


def build_temporal_features(df: DataFrame, cols: list[str] | None = None, key: str = "id",
                            time: str = "wave") -> DataFrame:
    return temporal_pct_change(temporal_delta(df, cols, key, time), cols, True, key, time)


def temporal_impute(df: DataFrame, cols: list[str], key: str = "id", time: str = "wave") -> DataFrame:
    """Per subject: forward fill, then backward fill what is still missing."""
    w = _w(key, time)
    fwd = w.rowsBetween(Window.unboundedPreceding, 0)
    bwd = w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, True).over(fwd), F.first(c, True).over(bwd))
                           for c in cols if c in df.columns})


def median_impute(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Fill missing values with the median of ``fit_on`` (default ``df``).

    The median is the exact one (mean of the two middle values for an even
    count), found per column with the bucketed running count of
    ``functions.prefix`` so no single task sees a whole column.
    """
    from ..functions.prefix import prefix_sums
    from ..session import cut_lineage
    src = fit_on if fit_on is not None else df
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    stack = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    long = src.selectExpr(f"stack({len(cols)}, {stack}) AS (_col, _x)").filter(F.col("_x").isNotNull())
    counts = cut_lineage(long.groupBy("_col", "_x").agg(F.count(F.lit(1)).alias("_c")), "value-counts")
    cum = prefix_sums(counts, ["_col"], "_x", {"n": F.col("_c")}, descending=False)
    tot = counts.groupBy("_col").agg(F.sum("_c").alias("_tot"))
    cum = cum.join(tot, "_col")
    lo_rank = F.floor((F.col("_tot") + 1) / 2)   # 1-based ranks of the middle values
    hi_rank = F.floor(F.col("_tot") / 2) + 1
    start = F.col("cum_n") - F.col("_c") + 1
    covers = lambda r: (start <= r) & (F.col("cum_n") >= r)
    med = (cum.groupBy("_col")
           .agg(F.max(F.when(covers(lo_rank), F.col("_x"))).alias("_lo"),
                F.max(F.when(covers(hi_rank), F.col("_x"))).alias("_hi"))
           .select("_col", ((F.col("_lo") + F.col("_hi")) / 2).alias("_med")))
    wide = med.groupBy().pivot("_col", cols).agg(F.first("_med"))
    # one row: a broadcast of bounded size
    joined = df.withColumn("_one", F.lit(1)).join(
        F.broadcast(wide.select(*[F.col(f"`{c}`").alias(f"_med_{c}") for c in cols])
                    .withColumn("_one", F.lit(1))), "_one")
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}"))
                               for c in cols}).drop("_one", *[f"_med_{c}" for c in cols])


def missingness_features(df: DataFrame, cols: list[str], key: str = "id",
                         time: str = "wave") -> DataFrame:
    """Share of the feature columns missing in this wave (percent), its change
    since the subject's previous wave and the change of that change."""
    present = [c for c in cols if c in df.columns]
    n_miss = sum((F.col(c).isNull().cast("int") for c in present), F.lit(0))
    pct = n_miss * 100.0 / F.lit(len(present))
    w = _w(key, time)
    out = df.withColumn("missing_pct", pct)
    out = out.withColumn("missing_change", F.col("missing_pct") - F.lag("missing_pct").over(w))
    return out.withColumn("missing_accel", F.col("missing_change") - F.lag("missing_change").over(w))

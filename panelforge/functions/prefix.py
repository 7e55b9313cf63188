"""Running sums and ranks in a global order without a one-partition window.

A window ordered over a whole group puts the group in one task.  Here the
order key is cut into buckets first, running sums are computed inside each
(group, bucket) in parallel, and each bucket gets the totals of all earlier
buckets of its group from a small table (groups x buckets rows).  Buckets come
from approximate quantiles of the order key, so they hold similar numbers of
rows even when values crowd in a narrow range; rows with equal keys always
share a bucket, so ties stay exact.

Every row comes out again: a NULL group is a group, NULL keys come last in
descending and first in ascending order.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BUCKETS = 1 << 16
#: Accuracy, hence size, of a group's quantile digest at most; twice ``MAX_BUCKETS``, so a bucket is off by half at most.
DIGEST = 2 * MAX_BUCKETS


def default_buckets(df: DataFrame) -> int:
    """Buckets per group: a few for each shuffle partition, whose number is set by the data size."""
    return min(MAX_BUCKETS, max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def join_groups(df: DataFrame, side: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on ``by`` with NULL equal to NULL; the columns of ``by`` come from ``df``."""
    if not by:   # a single row: join it on a constant key
        return df.withColumn("_all", F.lit(0)).join(side.withColumn("_all", F.lit(0)), "_all", how).drop("_all")
    side = side.withColumnsRenamed({c: f"_side_{c}" for c in by})
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_side_{c}"))
    return df.join(side, cond, how).drop(*[f"_side_{c}" for c in by])


def _bucket_bounds(df: DataFrame, by: list[str], key: str, buckets: int) -> DataFrame:
    probs = [i / buckets for i in range(1, buckets)]
    # results don't depend on how even the buckets are, so the digest of a group stays bounded
    agg = F.percentile_approx(F.col(key).cast("double"), probs, min(10 * buckets, DIGEST)).alias("_bounds")
    return df.groupBy(*by).agg(agg) if by else df.agg(agg)


def _count_below(bounds: Column, key: Column, buckets: int) -> Column:
    """How many of the sorted bounds are below the key, by binary search."""
    steps = [1 << i for i in reversed(range(buckets.bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(
        F.coalesce(F.get(bounds, at + s - 1) < key, F.lit(False)), at + s).otherwise(at))


def with_buckets(df: DataFrame, by: list[str], key: str, buckets: int | None = None,
                 key_range: tuple[float, float] | None = None) -> DataFrame:
    """Add ``_bkt``: number of quantile bounds strictly below ``key``
    (monotone in ``key``, so equal keys share a bucket; 0 for a NULL key).

    ``key_range=(lo, hi)`` declares the key uniform on that range (e.g. a
    hash): buckets are then equal-width and no quantile pass is needed.
    """
    buckets = default_buckets(df) if buckets is None else buckets
    if not 1 <= buckets <= MAX_BUCKETS:
        raise ValueError(f"buckets must be 1 to {MAX_BUCKETS}, not {buckets}")
    if buckets == 1:
        return df.withColumn("_bkt", F.lit(0))
    k = F.col(key).cast("double")
    if key_range is not None:
        lo, hi = key_range
        b = F.floor((k - F.lit(float(lo))) / F.lit((hi - lo) / buckets))
        return df.withColumn("_bkt", F.coalesce(F.least(F.greatest(b, F.lit(0)), F.lit(buckets - 1)).cast("int"), F.lit(0)))
    joined = join_groups(df, _bucket_bounds(df, by, key, buckets), by)
    return joined.withColumn("_bkt", F.coalesce(_count_below(F.col("_bounds"), k, buckets), F.lit(0))).drop("_bounds")


def prefix_sums(df: DataFrame, by: list[str], key: str, values: dict[str, Column],
                descending: bool = True, tiebreak: list[str] | None = None,
                buckets: int | None = None, key_range: tuple[float, float] | None = None) -> DataFrame:
    """Add ``cum_<name>``: sum of ``values[name]`` over all rows of the same
    ``by`` group that come at or before this row in the order of ``key``
    (descending by default), ties broken by ``tiebreak``.

    ``df`` is read up to three times (bounds, sums, totals): it should already
    be reduced (e.g. one row per distinct key) or have its lineage cut.
    """
    tiebreak = tiebreak or []
    b = with_buckets(df.withColumns({f"_v_{n}": c for n, c in values.items()}), by, key, buckets, key_range)
    if descending:
        b = b.withColumn("_bkt", -F.col("_bkt"))
    kcol = F.col(key).desc() if descending else F.col(key).asc()
    local_w = (Window.partitionBy(*by, "_bkt").orderBy(kcol, *tiebreak)
               .rowsBetween(Window.unboundedPreceding, 0))
    local = b.withColumns({f"_loc_{n}": F.sum(f"_v_{n}").over(local_w) for n in values})
    totals = b.groupBy(*by, "_bkt").agg(*[F.sum(f"_v_{n}").alias(f"_tot_{n}") for n in values])
    before = Window.partitionBy(*by).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_bkt", *[F.coalesce(F.sum(f"_tot_{n}").over(before), F.lit(0))
                                           .alias(f"_off_{n}") for n in values])
    out = join_groups(local, offsets, [*by, "_bkt"])
    out = out.withColumns({f"cum_{n}": F.col(f"_off_{n}") + F.coalesce(F.col(f"_loc_{n}"), F.lit(0)) for n in values})
    drop = ["_bkt"] + [f"_{p}_{n}" for p in ("v", "loc", "off") for n in values]
    return out.drop(*drop)


def global_rank(df: DataFrame, key: str, descending: bool = True, tiebreak: list[str] | None = None,
                by: list[str] | None = None, buckets: int | None = None, name: str = "pos",
                key_range: tuple[float, float] | None = None) -> DataFrame:
    """1-based position of each row in the order (key, tiebreak) within ``by``."""
    out = prefix_sums(df, by or [], key, {"_one": F.lit(1)}, descending, tiebreak, buckets, key_range)
    return out.withColumnRenamed("cum__one", name)

"""SMOTE and ADASYN oversampling (B5, D5) as distributed jobs.

Neighbours are exact at every size (``neighbours``: a blocked search with pivot
bounds).  Partners of SMOTE and ADASYN are the k nearest minority rows; ADASYN's
risk is the share of majority rows among the k nearest of all, so minority rows
are its queries and every row of the task is stored once.  Neighbours are row
numbers; the partner that a synthetic row draws is joined when it is drawn.

How many synthetic rows each minority row produces is decided up front from the
counts, so the total is exact in both modes: n_new = floor(ratio * n_majority) -
n_minority per task.  SMOTE spreads them evenly (hash order breaks the
remainder), ADASYN by the share of majority rows among the k nearest (largest
remainders).  When the minority share is already at or above the ratio nothing
is generated (the original library raises and the pipeline swallows the error -
here that is an explicit no-op).  Random draws use md5 of (key, copy, seed).

A NULL feature counts as 0, in distances and in synthetic rows; a NULL task is a
task; rows without a label pass through and are nobody's neighbours.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..conf import RANDOM_STATE, SMOTE_K, SMOTE_RATIO
from ..functions.prefix import global_rank, join_groups
from ..session import cut_lineage
from .balance import HASH_RANGE, md5_hash
from .neighbours import BLOCK, exact_neighbours


def _u(cols: list[str], seed: int, salt: str):
    """Uniform [0, 1) from md5 of the columns, seed and salt."""
    s = F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(f"{seed}|{salt}"))
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("double") / F.lit(float(1 << 60))


def search_pool(rows: DataFrame, cols: list[str], by: str, keys: list[str], minority) -> DataFrame:
    """Rows (with ``_row``) as ``exact_neighbours`` takes them; ``flag`` marks the minority, all rows are queries."""
    v = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    return rows.select(F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("-")).alias("g"), F.col("_row").alias("row"),
                       F.xxhash64(*keys).alias("n"), F.lit(True).alias("query"), minority.alias("flag"), v.alias("v"))


def risk_share(near):
    """Share of majority rows among the nearest rows; 0 without any."""
    return F.when(F.size(near) > 0, F.size(F.filter(near, lambda x: ~x["flag"])) / F.size(near)).otherwise(F.lit(0.0))


def oversample_synthetic(df: DataFrame, cols: list[str], label: str = "label", by: str = "task",
                         keys: list[str] = ("id", "wave"), ratio: float = SMOTE_RATIO, k: int = SMOTE_K,
                         seed: int = RANDOM_STATE, block: int = BLOCK, mode: str = "smote") -> DataFrame:
    """Training rows plus synthetic minority rows (``synthetic`` = true).

    ``mode="smote"`` spreads new rows evenly over minority rows;
    ``mode="adasyn"`` in proportion to the share of majority rows among each
    minority row's k nearest neighbours (all classes).
    """
    keys, k = list(keys), int(k)
    plain = df.columns
    # counted, searched and returned
    df = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()), "oversample")
    counts = df.groupBy(by).agg(F.count_if(F.col(label) == 1).alias("_n1"),
                                F.count_if(F.col(label) == 0).alias("_n0"))
    # the minority class is the smaller one of each task
    counts = counts.select(
        by, F.when(F.col("_n1") <= F.col("_n0"), 1).otherwise(0).alias("_class"),
        F.least("_n1", "_n0").alias("_nmin"), F.greatest("_n1", "_n0").alias("_nmaj"))
    counts = counts.withColumn("_new", F.greatest(F.floor(F.col("_nmaj") * F.lit(ratio)).cast("long")
                                                  - F.col("_nmin"), F.lit(0)))
    active = counts.filter((F.col("_new") > 0) & (F.col("_nmin") > 0))
    pool = search_pool(join_groups(df.filter(F.col(label).isin(0, 1)), active, [by]), cols, by, keys, F.col(label) == F.col("_class"))
    pool = cut_lineage(pool if mode == "adasyn" else pool.filter("flag"), "pool")
    partners = exact_neighbours(pool.filter("flag"), k, block)
    src = join_groups(df, active, [by]).filter(F.col(label) == F.col("_class")).join(
        partners.select(F.col("row").alias("_row"), F.col("near").alias("_to")), "_row")
    if mode == "adasyn":
        around = exact_neighbours(pool.withColumn("query", F.col("flag")), k, block)
        src = src.join(around.select(F.col("row").alias("_row"), F.col("near").alias("_all")), "_row")
    src = cut_lineage(src.withColumn("_h", md5_hash(keys, seed)), "neighbours")
    if mode == "adasyn":
        src = src.withColumn("_risk", risk_share(F.col("_all")))
        total = src.groupBy(by).agg(F.sum("_risk").alias("_rsum"))
        src = join_groups(src, total, [by])
        want = F.when(F.col("_rsum") > 0, F.col("_risk") / F.col("_rsum")).otherwise(1 / F.col("_nmin")) * F.col("_new")
        src = src.withColumn("_whole", F.floor(want).cast("long")).withColumn("_frac", want - F.floor(want))
        left = src.groupBy(by).agg((F.max("_new") - F.sum("_whole")).alias("_left"))
        src = join_groups(global_rank(src, "_frac", tiebreak=["_h", *keys], by=[by], name="_hp"), left, [by])
        src = src.withColumn("_reps", F.col("_whole") + F.when(F.col("_hp") <= F.col("_left"), 1).otherwise(0))
    else:
        src = global_rank(src, "_h", descending=False, tiebreak=keys, by=[by], name="_hp", key_range=HASH_RANGE)
        per = F.floor(F.col("_new") / F.col("_nmin"))
        rem = F.col("_new") - per * F.col("_nmin")
        src = src.withColumn("_reps", (per + F.when(F.col("_hp") <= rem, 1).otherwise(0)).cast("long"))
    gen = (src.filter(F.col("_reps") > 0)
           .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_reps").cast("int")))))
    pick = (F.floor(_u(keys + ["copy"], seed, "n") * F.size("_to")) + 1).cast("int")
    # without any other minority row the copy is the row itself
    nb = F.when(F.size("_to") > 0, F.try_element_at("_to", F.greatest(pick, F.lit(1)))["row"])
    gen = gen.withColumn("_nb_row", nb).withColumn("_gap", _u(keys + ["copy"], seed, "g"))
    gen = gen.join(pool.select(F.col("row").alias("_nb_row"), F.col("v").alias("_nb")), "_nb_row", "left")

    own = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    gen = gen.withColumn("_own", own).withColumn("_mid", F.zip_with(
        "_own", F.coalesce("_nb", "_own"), lambda x, y: x + F.col("_gap") * (y - x)))
    synth = gen.withColumns({c: F.get("_mid", F.lit(i)).cast(df.schema[c].dataType) for i, c in enumerate(cols)}).withColumn("synthetic", F.lit(True))
    return df.select(*plain, F.lit(False).alias("synthetic")).unionByName(synth.select(*plain, "synthetic"))


def smote(df: DataFrame, cols: list[str], label: str = "label", by: str = "task", **kw) -> DataFrame:
    return oversample_synthetic(df, cols, label, by, mode="smote", **kw)


def adasyn(df: DataFrame, cols: list[str], label: str = "label", by: str = "task", **kw) -> DataFrame:
    return oversample_synthetic(df, cols, label, by, mode="adasyn", **kw)

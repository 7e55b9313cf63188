"""Row / column selection and feature lists.

Column-role rules work on names.  Two forms are offered: plain Python on a
list of column names (what a job uses to build its ``select``), and the same
rules over a DataFrame (feature, pos) of names, so long feature catalogues and
importance tables are processed as Spark jobs.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..conf import AGG_KEYWORDS, PanelSpec


# -- P4, P5, P9, P14 --------------------------------------------------------
def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    present = [c for c in cols if c in df.columns]
    return df.dropna(how="any", subset=present) if present else df


def labelled(df: DataFrame, target: str) -> DataFrame:
    """Rows with a label, label cast to int."""
    return df.filter(F.col(target).isNotNull()).withColumn(target, F.col(target).cast("int"))


def fill_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    present = [c for c in cols if c in df.columns]
    return df.fillna(0, subset=present)


def mask_targets(df: DataFrame, targets: list[str], keep=("id", "wave")) -> DataFrame:
    """(value, mask) per task: value 0 where missing, mask false there."""
    cols = []
    for t in targets:
        cols += [F.coalesce(F.col(t), F.lit(0)).cast("int").alias(f"{t}_value"),
                 F.col(t).isNotNull().alias(f"{t}_mask")]
    return df.select(*keep, *cols)


# -- P6, P7, P8 -------------------------------------------------------------
def feature_columns(columns: list[str], variant: str = "a", spec: PanelSpec = PanelSpec(),
                    targets: list[str] | None = None) -> list[str]:
    """Role-based feature list.

    a: not key, not ``target_*``, ``wave`` forced first.
    b: not key / wave / the known ``targets`` (other ``target_*`` columns stay), then ``wave`` prepended.
    c: like a, with ``wave`` kept where it stands as an ordinary feature.
    """
    if variant not in ("a", "b", "c"):
        raise ValueError(f"unknown variant {variant!r}")
    if variant == "b":
        gone = set(targets or [])
    else:
        gone = {c for c in columns if c.startswith(spec.target_prefix)}
    rest = [c for c in columns if c != spec.key and c not in gone]
    return rest if variant == "c" else [spec.time] + [c for c in rest if c != spec.time]


def resolve_features(columns: list[str], listed: list[str] | None = None, imp: DataFrame | None = None,
                     top_n: int | None = None, min_importance: float | None = None,
                     spec: PanelSpec = PanelSpec()) -> list[str]:
    """The features of a run: the listed ones, else the important ones (``min_importance`` before
    ``top_n``), else all; in each case only those in the data, ``wave`` first."""
    if listed is not None:
        want = listed
    elif imp is not None and (top_n is not None or min_importance is not None):
        want = [r["feature"] for r in top_importances(imp, top_n, min_importance).select("feature").collect()]   # a feature list
    else:
        want = feature_columns(columns, "a", spec)
    present, _ = select_features(columns, want)
    return [spec.time] + [c for c in present if c not in (spec.time, spec.key)]


def select_features(columns: list[str], want: list[str], strict: bool = False):
    """(present, missing) in request order; ``strict`` raises on missing."""
    have = set(columns)
    present = [c for c in want if c in have]
    missing = [c for c in want if c not in have]
    if strict and missing:
        raise ValueError(f"requested features not in data: {missing}")
    return present, missing


def project_xy(df: DataFrame, features: list[str], targets: list[str],
               keep=("id", "wave")) -> DataFrame:
    """Keys + features + the first available target renamed ``target``."""
    tgt = next((t for t in targets if t in df.columns), None)
    if tgt is None:
        raise ValueError(f"none of the targets {targets} is present")
    feats = [c for c in features if c in df.columns and c not in keep]
    return df.select(*keep, *feats, F.col(tgt).alias("target"))


# -- P11 --------------------------------------------------------------------
def top_importances(imp: DataFrame, n: int | None = None, min_importance: float | None = None,
                    strict: bool = True) -> DataFrame:
    """Features by importance, descending (ties by name); optional threshold
    (``>`` when strict, ``>=`` otherwise) and top-n (a distributed top-k)."""
    out = imp
    if min_importance is not None:
        cond = F.col("importance") > min_importance if strict else F.col("importance") >= min_importance
        out = out.filter(cond)
    out = out.orderBy(F.desc("importance"), F.asc("feature"))
    return out.limit(n) if n is not None else out


def min_importance(imp: DataFrame, x: float, strict: bool = True) -> DataFrame:
    cond = F.col("importance") > x if strict else F.col("importance") >= x
    return imp.filter(cond)


def _ranked(imp: DataFrame, by: list[str] | None = None) -> DataFrame:
    w = Window.orderBy(F.desc("importance"), F.asc("feature")) if not by else \
        Window.partitionBy(*by).orderBy(F.desc("importance"), F.asc("feature"))
    return imp.withColumn("rank", F.row_number().over(w))


def feature_set(name: str, available: DataFrame, imp: DataFrame, top_n=(8, 50),
                min_imp: float = 5.0) -> DataFrame:
    """Named feature set as (feature, pos): ``wave`` first (pos 0), then members.

    ``available`` is (feature, pos) of the data's columns.  top8 / top50: the
    first n of the importance ranking, dropped when not in the data (not
    "top n among available"); min_imp_5: importance > ``min_imp``; all:
    every non-key, non-target, non-temporal column; temporal_only:
    ``*_delta`` / ``*_pct_change``; top50_plus_temporal: top50 then temporal.
    Importance members are ordered by importance, column members by column
    position; positions are dense and come from the bucketed rank (no
    one-partition window).
    """
    from ..functions.prefix import global_rank
    avail = available.select("feature", F.col("pos").alias("_col_pos"))
    temporal = F.col("feature").endswith("_delta") | F.col("feature").endswith("_pct_change")
    not_wave = F.col("feature") != "wave"
    n8, n50 = top_n

    def by_importance(members):
        return global_rank(members.filter(not_wave), "importance", True, ["feature"])

    def by_position(members):
        return global_rank(members.filter(not_wave), "_col_pos", False, ["feature"])

    if name in ("top8", "top50", "top50_plus_temporal"):
        k = n8 if name == "top8" else n50
        head = by_importance(top_importances(imp, k).select("feature", "importance")
                             .join(avail, "feature", "left_semi"))
        ranked = head.select("feature", "pos")
        if name == "top50_plus_temporal":
            n_head = head.agg(F.count(F.lit(1)).alias("_k"), F.lit(1).alias("_one"))
            tail = by_position(avail.filter(temporal).join(head.select("feature"), "feature", "left_anti"))
            # one-row count: broadcast of bounded size
            tail = (tail.withColumn("_one", F.lit(1)).join(F.broadcast(n_head), "_one")
                    .select("feature", (F.col("pos") + F.col("_k")).alias("pos")))
            ranked = ranked.unionByName(tail)
    elif name == "min_imp_5":
        ranked = by_importance(min_importance(imp, min_imp).select("feature", "importance")
                               .join(avail, "feature", "left_semi")).select("feature", "pos")
    elif name == "all":
        bad = F.col("feature").isin("id", "wave") | F.col("feature").startswith("target_") | temporal
        ranked = by_position(avail.filter(~bad)).select("feature", "pos")
    elif name == "temporal_only":
        ranked = by_position(avail.filter(temporal)).select("feature", "pos")
    else:
        raise ValueError(f"unknown feature set: {name}")
    head_row = available.sparkSession.createDataFrame([("wave", 0)], "feature string, pos long")
    return head_row.unionByName(ranked.select("feature", F.col("pos").cast("long")))


# -- P12 --------------------------------------------------------------------
def keyword_columns(names: DataFrame, keywords=AGG_KEYWORDS, fallback_n: int = 100) -> DataFrame:
    """Columns whose lower-cased name contains a keyword, by position; when
    none match, the first ``fallback_n`` columns."""
    low = F.lower("feature")
    hit = F.lit(False)
    for k in keywords:
        hit = hit | low.contains(k.lower())
    matched = names.filter(hit)
    first = names.filter(F.col("pos") < fallback_n)
    any_hit = matched.select(F.lit(1).alias("_k")).limit(1)
    # fallback rows survive only when no keyword matched (anti join on a 1-row frame)
    fallback = first.withColumn("_k", F.lit(1)).join(any_hit, "_k", "left_anti").drop("_k")
    return matched.unionByName(fallback)


def first_columns(names: DataFrame, n: int) -> DataFrame:
    return names.filter(F.col("pos") < n)


# -- P13 --------------------------------------------------------------------
def manifest(features: DataFrame, role: str = "feature", source: str = "model_table") -> DataFrame:
    return features.select("feature", F.lit(role).alias("role"), F.lit(source).alias("source"))


# -- L6, A13 / J9 -----------------------------------------------------------
def union_features(imp: DataFrame, base_n: int = 100, other_n: int = 30,
                   base: str | None = None) -> DataFrame:
    """Top ``base_n`` of the base list plus top ``other_n`` of every other
    list, distinct.  The base list is the longest one (ties by name) unless
    given.  ``imp`` is (disease, feature, importance)."""
    # the constant bound on the rank lets every task cut its lists before the shuffle
    ranked = _ranked(imp, ["disease"]).filter(F.col("rank") <= max(base_n, other_n))
    if base is None:
        sizes = imp.groupBy("disease").agg(F.count(F.lit(1)).alias("_n"))
        chosen = (sizes.orderBy(F.desc("_n"), F.asc("disease")).limit(1)
                  .select(F.col("disease").alias("_base")))
    else:
        chosen = imp.sparkSession.createDataFrame([(base,)], "_base string")
    tagged = ranked.join(chosen, F.col("disease") == F.col("_base"), "left")
    keep = F.when(F.col("_base").isNotNull(), F.col("rank") <= base_n).otherwise(F.col("rank") <= other_n)
    return tagged.filter(keep).select("feature").distinct()


def union_summary(features: DataFrame, imp: DataFrame) -> DataFrame:
    """Per chosen feature: mean importance over the lists holding it and how
    many lists hold it; 0 / 0 when none does."""
    stats = imp.groupBy("feature").agg(F.avg("importance").alias("mean_importance"),
                                       F.count(F.lit(1)).alias("n_diseases"))
    return (features.select("feature").join(stats, "feature", "left")
            .select("feature", F.coalesce("mean_importance", F.lit(0.0)).alias("mean_importance"),
                    F.coalesce("n_diseases", F.lit(0)).cast("long").alias("n_diseases")))


# -- L7 ---------------------------------------------------------------------
def feature_overlap(a: DataFrame, b: DataFrame, col: str = "feature") -> DataFrame:
    """Every name of either side with its membership (full outer join)."""
    da = a.select(col).distinct().withColumn("in_a", F.lit(True))
    db = b.select(col).distinct().withColumn("in_b", F.lit(True))
    return (da.join(db, col, "full")
            .select(col, F.coalesce("in_a", F.lit(False)).alias("in_a"),
                    F.coalesce("in_b", F.lit(False)).alias("in_b")))


# -- D6 ---------------------------------------------------------------------
def group_round_robin(prio: DataFrame, n: int, group: str = "grp", priority: DataFrame | None = None) -> DataFrame:
    """Pick ``n`` features group by group: every group's best, then every group's
    second, ...  Groups are ordered by ``priority`` (group, priority; groups that
    it lacks come last) or else by their best importance.
    (feature, group, importance, rank, group_order, pick)."""
    # no group can give more than n of the picks; the constant bound cuts the groups before the shuffle
    ranked = _ranked(prio, [group]).filter(F.col("rank") <= n)
    best = prio.groupBy(group).agg(F.max("importance").alias("_best"))
    order = [F.desc("_best"), F.asc(group)]
    if priority is not None:
        best = best.join(priority.select(group, F.col("priority").alias("_p")), group, "left")
        order = [F.asc_nulls_last("_p"), *order]
    # the numbering runs over one row per group
    gorder = best.withColumn("group_order", F.row_number().over(Window.orderBy(*order))).select(group, "group_order")
    picks = ranked.join(gorder, group).select("feature", group, "importance", "rank", "group_order")
    # a distributed top-n, then numbering of at most n rows
    top = picks.orderBy("rank", "group_order").limit(n)
    return top.withColumn("pick", F.row_number().over(Window.orderBy("rank", "group_order")))


def group_best(prio: DataFrame, group: str = "grp") -> DataFrame:
    """The single most important feature of each group."""
    return _ranked(prio, [group]).filter(F.col("rank") == 1).select(group, "feature", "importance")

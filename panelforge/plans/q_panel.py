"""Queries: reshape, targets, joins, selection, temporal features, splits."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import columns as C
from ..operators import joins as J
from ..operators import reshape as R
from ..operators import split as S
from ..operators import temporal as TM
from ..operators.targets import lookahead
from ..session import cut_lineage
from . import fixtures as fx
from .fixtures import COND_NAMES, FEATURES, TARGETS, with_ctes
from .registry import query


def rnd(df: DataFrame, cols, nd: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), nd) for c in cols})


def oracle(ctes: list[str], body: str, round_cols=(), nd: int = 6) -> str:
    head = with_ctes(*ctes) if ctes else ""
    if not round_cols:
        return head + body
    rep = ", ".join(f"round({c}, {nd}) AS {c}" for c in round_cols)
    return head + f"SELECT * REPLACE ({rep}) FROM ({body}) q"


def _long(spark, sf):
    return R.filter_waves(fx.panel(spark, sf), 3, 14)


def _train(spark, sf):
    return S.task_split(fx.model(spark, sf), TARGETS).filter(F.col("split") == "train")


# -- reshape / targets ------------------------------------------------------
@query("wide_to_long", oracle(["panel"], "SELECT * FROM panel"))
def q_wide_to_long(spark, sf):
    return R.wide_to_long(fx.wide(spark, sf))


@query("wave_filter", oracle(["panel"], "SELECT * FROM panel WHERE wave BETWEEN 3 AND 14"))
def q_wave_filter(spark, sf):
    return _long(spark, sf)


_LA = ["URGE", "STF"]


@query("lookahead", oracle(["plong"], f"""
    SELECT b.*, {", ".join(f"t1.{c} AS {c}_t1, t2.{c} AS {c}_t2" for c in _LA)}
    FROM plong b LEFT JOIN plong t1 ON t1.id = b.id AND t1.wave = b.wave + 1
    LEFT JOIN plong t2 ON t2.id = b.id AND t2.wave = b.wave + 2"""))
def q_lookahead(spark, sf):
    return lookahead(_long(spark, sf), _LA, (1, 2))


@query("incident_targets", oracle(["model"], "SELECT * FROM model"))
def q_incident_targets(spark, sf):
    return fx.model(spark, sf)


# -- joins ------------------------------------------------------------------
@query("merge_person", oracle(["model", "person"], """
    SELECT m.*, p.ACCTBAL, p.NATION, p.SEGMENT, p.N AS N_fam
    FROM model m LEFT JOIN person p ON p.HHIDPN = m.id"""))
def q_merge_person(spark, sf):
    return J.merge_person(fx.model(spark, sf), fx.person(spark, sf))


@query("align_tasks", oracle(["model"], f"""
    SELECT id, wave, {", ".join(f"target_{c} AS {c}" for c in COND_NAMES)} FROM model
    WHERE {" OR ".join(f"target_{c} IS NOT NULL" for c in COND_NAMES)}"""))
def q_align_tasks(spark, sf):
    return J.align_targets(fx.model(spark, sf), TARGETS)


@query("union_by_name", oracle(["panel"], """
    SELECT id, wave, SPEND, NULL::BIGINT AS N FROM panel WHERE wave <= 7
    UNION ALL SELECT id, wave, NULL::DOUBLE AS SPEND, N FROM panel WHERE wave > 7"""))
def q_union_by_name(spark, sf):
    p = fx.panel(spark, sf)
    return R.union_by_name([p.filter("wave <= 7").select("id", "wave", "SPEND"),
                            p.filter("wave > 7").select("id", "wave", "N")])


# -- row / column selection -------------------------------------------------
_ALL_PRESENT = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)


@query("complete_cases", oracle(["model"], f"SELECT * FROM model WHERE {_ALL_PRESENT}"))
def q_complete_cases(spark, sf):
    return C.complete_cases(fx.model(spark, sf), FEATURES + ["BMI"])


@query("labelled_rows", oracle(["model"], "SELECT * FROM model WHERE target_URGE IS NOT NULL"))
def q_labelled_rows(spark, sf):
    return C.labelled(fx.model(spark, sf), "target_URGE")


@query("role_columns", oracle(["model"], f"SELECT wave, {', '.join(FEATURES)} FROM model"))
def q_role_columns(spark, sf):
    m = fx.model(spark, sf)
    return m.select(*C.feature_columns(m.columns, "a"))


@query("role_columns_known_targets", oracle(["model"], f"""SELECT wave, {', '.join(FEATURES)},
    {', '.join(t for t in TARGETS if t != 'target_URGE')} FROM model"""))
def q_role_columns_known_targets(spark, sf):
    m = fx.model(spark, sf)
    return m.select(*C.feature_columns(m.columns, "b", targets=["target_URGE"]))


@query("role_columns_in_place", oracle(["model"], f"SELECT wave, {', '.join(FEATURES)} FROM model WHERE wave > 5"))
def q_role_columns_in_place(spark, sf):
    m = fx.model(spark, sf).filter("wave > 5")
    return m.select(*C.feature_columns(m.columns, "c"))


@query("resolve_features", oracle(["model"], "SELECT wave, N, SPEND FROM model"))
def q_resolve_features(spark, sf):
    """Importances of the model's own columns (how often they are present) decide; threshold before top-n."""
    m = cut_lineage(fx.model(spark, sf), "model")
    one = m.agg(*[F.count(c).alias(c) for c in ("SPEND", "N")], *[F.sum(c).alias(c) for c in COND_NAMES])
    names = ["SPEND", "N", *COND_NAMES]
    imp = one.selectExpr(f"stack({len(names)}, " + ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in names)
                         + ") AS (feature, importance)")
    return m.select(*C.resolve_features(m.columns, imp=imp, top_n=2, min_importance=1.0))


@query("project_xy", oracle(["model"], f"SELECT id, wave, {', '.join(FEATURES)}, target_URGE AS target FROM model"))
def q_project_xy(spark, sf):
    return C.project_xy(fx.model(spark, sf), FEATURES + ["BMI"], ["target_DIABE"] + TARGETS)


@query("fill_zero", oracle(["model"], "SELECT * REPLACE ("
                           + ", ".join(f"coalesce({c}, 0) AS {c}" for c in FEATURES) + ") FROM model"))
def q_fill_zero(spark, sf):
    return C.fill_zero(fx.model(spark, sf), FEATURES)


@query("target_masks", oracle(["model"], "SELECT id, wave, " + ", ".join(
    f"CAST(coalesce(target_{c}, 0) AS INTEGER) AS target_{c}_value, target_{c} IS NOT NULL AS target_{c}_mask"
    for c in COND_NAMES) + " FROM model"))
def q_target_masks(spark, sf):
    return C.mask_targets(fx.model(spark, sf), TARGETS)


@query("dedup_keys", oracle(["model"], "SELECT DISTINCT id, wave FROM model WHERE "
                            + " OR ".join(f"target_{c} IS NOT NULL" for c in COND_NAMES)))
def q_dedup_keys(spark, sf):
    from ..operators.quality import dedup_keys
    from ..operators.split import unpivot_targets
    return dedup_keys(unpivot_targets(fx.model(spark, sf), TARGETS).select("id", "wave"))


# -- temporal features ------------------------------------------------------
_TF = ["SPEND", "N", "URGE"]
_W = "WINDOW w AS (PARTITION BY id ORDER BY wave)"


@query("temporal_delta", oracle(["model"], "SELECT *, " + ", ".join(
    f"{c} - lag({c}) OVER w AS {c}_delta" for c in _TF)
    + f" FROM model WHERE target_URGE IS NOT NULL {_W}"))
def q_temporal_delta(spark, sf):
    return TM.temporal_delta(C.labelled(fx.model(spark, sf), "target_URGE"), _TF)


def _pct_sql(c):
    cur = (f"last_value({c} IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    prev = (f"last_value({c} IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    return (f"CAST({cur} AS DOUBLE) / CASE WHEN {prev} = 0 THEN NULL ELSE CAST({prev} AS DOUBLE) END - 1"
            f" AS {c}_pct_change")


@query("temporal_pct_change", oracle(["model"], "SELECT *, " + ", ".join(_pct_sql(c) for c in _TF)
                                     + f" FROM model WHERE target_URGE IS NOT NULL {_W}"))
def q_temporal_pct_change(spark, sf):
    return TM.temporal_pct_change(C.labelled(fx.model(spark, sf), "target_URGE"), _TF, pad=True)


@query("temporal_features", oracle(["model"], "SELECT *, " + ", ".join(
    [f"{c} - lag({c}) OVER w AS {c}_delta" for c in _TF] + [_pct_sql(c) for c in _TF])
    + f" FROM model WHERE target_URGE IS NOT NULL {_W}"))
def q_temporal_features(spark, sf):
    return TM.build_temporal_features(C.labelled(fx.model(spark, sf), "target_URGE"), _TF)


@query("temporal_impute", oracle(["model"], "SELECT * REPLACE (" + ", ".join(
    f"coalesce(last_value({c} IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    f"first_value({c} IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
    for c in ["SPEND", "N"]) + f") FROM model {_W}"))
def q_temporal_impute(spark, sf):
    return TM.temporal_impute(fx.model(spark, sf), ["SPEND", "N"])


@query("median_impute", oracle(["model"], """
    SELECT m.* REPLACE (coalesce(m.SPEND, s.ms) AS SPEND, coalesce(CAST(m.N AS DOUBLE), s.mn) AS N)
    FROM model m, (SELECT median(SPEND) AS ms, median(N)::DOUBLE AS mn FROM model
                   WHERE wave BETWEEN 3 AND 9) s"""))
def q_median_impute(spark, sf):
    m = cut_lineage(fx.model(spark, sf), "model")   # read for the medians and to be filled
    return TM.median_impute(m, ["SPEND", "N"], fit_on=m.filter(F.col("wave").between(3, 9)))


_NMISS = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in FEATURES)


@query("missingness_features", oracle(["model"], f"""
    SELECT *, missing_change - lag(missing_change) OVER w AS missing_accel FROM (
      SELECT *, missing_pct - lag(missing_pct) OVER w AS missing_change FROM (
        SELECT *, CAST({_NMISS} AS DOUBLE) * 100 / {len(FEATURES)} AS missing_pct FROM model) x
      {_W}) y
    {_W}"""))
def q_missingness_features(spark, sf):
    return TM.missingness_features(fx.model(spark, sf), FEATURES)


# -- splits -----------------------------------------------------------------
_SPLIT = "CASE WHEN wave BETWEEN 3 AND 9 THEN 'train' WHEN wave BETWEEN 10 AND 12 THEN 'val' END"
_TASKS_SQL = " UNION ALL ".join(
    f"SELECT id, wave, '{c}' AS task, CAST(target_{c} AS INTEGER) AS label, {_SPLIT} AS split "
    f"FROM model WHERE target_{c} IS NOT NULL" for c in COND_NAMES)
CTE_TASK_SPLIT = f"""tl AS ({_TASKS_SQL}),
    ts AS (SELECT * FROM tl WHERE split IS NOT NULL AND task IN (
        SELECT task FROM tl GROUP BY task
        HAVING count(*) FILTER (WHERE split = 'train') > 0 AND count(*) FILTER (WHERE split = 'val') > 0))"""


def task_split_sql(body: str, round_cols=()) -> str:
    w = with_ctes("model").rstrip() + f",\n{CTE_TASK_SPLIT}\n"
    if not round_cols:
        return w + f"SELECT * FROM ({body}) q"
    rep = ", ".join(f"round({c}, 6) AS {c}" for c in round_cols)
    return w + f"SELECT * REPLACE ({rep}) FROM ({body}) q"


@query("temporal_split", oracle(["model"], f"SELECT *, {_SPLIT} AS split FROM model WHERE {_SPLIT} IS NOT NULL"))
def q_temporal_split(spark, sf):
    return S.temporal_split(fx.model(spark, sf))


@query("task_split", task_split_sql("SELECT * FROM ts"))
def q_task_split(spark, sf):
    return S.task_split(fx.model(spark, sf), TARGETS)


_STD = ["SPEND", "N"]


@query("standardize", oracle(["model"], """
    SELECT m.* REPLACE ((coalesce(m.SPEND, 0) - s.ms) / s.ss AS SPEND, (coalesce(m.N, 0) - s.mn) / s.sn AS N)
    FROM model m, (SELECT avg(coalesce(SPEND, 0)) AS ms,
                          CASE WHEN stddev_pop(coalesce(SPEND, 0)) > 0 THEN stddev_pop(coalesce(SPEND, 0)) ELSE 1 END AS ss,
                          avg(coalesce(N, 0)) AS mn,
                          CASE WHEN stddev_pop(coalesce(N, 0)) > 0 THEN stddev_pop(coalesce(N, 0)) ELSE 1 END AS sn
                   FROM model WHERE wave BETWEEN 3 AND 9) s""", _STD))
def q_standardize(spark, sf):
    m = fx.model(spark, sf)
    out = S.standardize(m, _STD, fit_on=m.filter(F.col("wave").between(3, 9)), fill=0)
    return rnd(out, _STD)

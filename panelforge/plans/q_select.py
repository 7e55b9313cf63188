"""Queries: importance lists, feature sets and feature-name catalogues."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..conf import AGG_KEYWORDS
from ..operators import columns as C
from ..operators import joins as J
from ..sources.files import read_table
from . import fixtures as fx
from .q_panel import oracle, rnd
from .registry import query


def _sold(spark, sf):
    """Catalogue of columns "present in the data": parts that were ordered."""
    li = read_table(spark, f"{sf}/lineitem.parquet")
    return (li.select(F.concat(F.lit("F"), F.col("l_partkey").cast("string")).alias("feature"),
                      F.col("l_partkey").alias("pos")).distinct())


_SOLD_SQL = "SELECT DISTINCT 'F' || CAST(l_partkey AS VARCHAR) AS feature, l_partkey AS pos FROM lineitem"


@query("top_importances", oracle(["importances"],
                                 "SELECT * FROM importances ORDER BY importance DESC, feature LIMIT 20"))
def q_top_importances(spark, sf):
    return C.top_importances(fx.importances(spark, sf), 20)


@query("min_importance", oracle(["importances"], "SELECT * FROM importances WHERE importance > 995"))
def q_min_importance(spark, sf):
    return C.min_importance(fx.importances(spark, sf), 995.0, strict=True)


@query("min_importance_inclusive", oracle(["importances"], """
    SELECT * FROM importances WHERE importance >= (SELECT quantile_disc(importance, 0.9) FROM importances)"""))
def q_min_importance_inclusive(spark, sf):
    imp = fx.importances(spark, sf)
    # a threshold that is itself a value of the table, so that > and >= differ
    cut = imp.agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY importance)").alias("x")).first()["x"]
    return C.min_importance(imp, cut, strict=False)


@query("feature_presence", oracle(["importances"], f"""
    SELECT i.feature, s.feature IS NOT NULL AS present
    FROM importances i LEFT JOIN ({_SOLD_SQL}) s ON s.feature = i.feature"""))
def q_feature_presence(spark, sf):
    return J.feature_presence(fx.importances(spark, sf), _sold(spark, sf))


def _fs_sql(name, k=None, thr=None):
    if k is not None:
        src = f"(SELECT * FROM importances ORDER BY importance DESC, feature LIMIT {k})"
    else:
        src = f"(SELECT * FROM importances WHERE importance > {thr})"
    return (f"SELECT '{name}' AS feature_set, 'wave' AS feature, CAST(0 AS BIGINT) AS pos UNION ALL "
            f"SELECT '{name}', t.feature, row_number() OVER (ORDER BY t.importance DESC, t.feature) "
            f"FROM {src} t WHERE t.feature IN (SELECT feature FROM sold) AND t.feature <> 'wave'")


@query("feature_sets", fx.with_ctes("importances").rstrip() + f", sold AS ({_SOLD_SQL})\n"
       + " UNION ALL ".join([_fs_sql("top8", k=8), _fs_sql("top50", k=50), _fs_sql("min_imp_5", thr=995)]))
def q_feature_sets(spark, sf):
    imp, avail = fx.importances(spark, sf), _sold(spark, sf)
    out = None
    for name in ("top8", "top50", "min_imp_5"):
        fs = C.feature_set(name, avail, imp, min_imp=995.0).select(
            F.lit(name).alias("feature_set"), "feature", "pos")
        out = fs if out is None else out.unionByName(fs)
    return out


# -- sets that depend on column names: a catalogue with keys, targets and temporal columns
_KINDS = ["", "_delta", "_pct_change"]
_NAMED_SQL = """named AS (
    SELECT CASE WHEN p_partkey % 17 = 0 THEN 'target_' ELSE '' END || 'F' || CAST(p_partkey AS VARCHAR)
             || ['', '_delta', '_pct_change'][p_partkey % 3 + 1] AS feature, p_partkey AS pos FROM part
    UNION ALL SELECT 'id', -2 UNION ALL SELECT 'wave', -1),
  nimp AS (SELECT n.feature, p_retailprice AS importance FROM part p JOIN named n ON n.pos = p.p_partkey)"""


def _named(spark, sf):
    part = read_table(spark, f"{sf}/part.parquet")
    key = F.col("p_partkey")
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (key % 3 + 1).cast("int"))
    feature = F.concat(F.when(key % 17 == 0, "target_").otherwise(""), F.lit("F"), key.cast("string"), kind)
    names = part.select(feature.alias("feature"), key.cast("long").alias("pos"))
    keys = spark.createDataFrame([("id", -2), ("wave", -1)], "feature string, pos long")
    return names.unionByName(keys), part.select(feature.alias("feature"), F.col("p_retailprice").alias("importance"))


_BY_POS = "SELECT '{name}' AS feature_set, feature, row_number() OVER (ORDER BY pos) AS pos FROM named WHERE {cond}"
_TEMPORAL = "(ends_with(feature, '_delta') OR ends_with(feature, '_pct_change'))"


@query("feature_sets_by_name", f"""
    WITH {_NAMED_SQL},
    top AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS r FROM nimp),
    t50 AS (SELECT feature, r FROM top WHERE r <= 50),
    w AS (SELECT unnest(['all', 'temporal_only', 'top50_plus_temporal']) AS feature_set, 'wave' AS feature, 0 AS pos)
    SELECT * FROM w UNION ALL
    {_BY_POS.format(name='all', cond="feature NOT IN ('id', 'wave') AND NOT starts_with(feature, 'target_') AND NOT " + _TEMPORAL)}
    UNION ALL {_BY_POS.format(name='temporal_only', cond=_TEMPORAL)}
    UNION ALL SELECT 'top50_plus_temporal', feature, r FROM t50
    UNION ALL SELECT 'top50_plus_temporal', feature, 50 + row_number() OVER (ORDER BY pos) FROM named
      WHERE {_TEMPORAL} AND feature NOT IN (SELECT feature FROM t50)""")
def q_feature_sets_by_name(spark, sf):
    avail, imp = _named(spark, sf)
    out = None
    for name in ("all", "temporal_only", "top50_plus_temporal"):
        fs = C.feature_set(name, avail, imp).select(F.lit(name).alias("feature_set"), "feature", "pos")
        out = fs if out is None else out.unionByName(fs)
    return out


# -- keyword catalogue: "<agg>_<part name>" with the aggregate picked by size
_AGGS = AGG_KEYWORDS + ["last"]


def _catalogue(spark, sf):
    part = read_table(spark, f"{sf}/part.parquet")
    agg = F.element_at(F.array(*[F.lit(a) for a in _AGGS]), (F.col("p_size") % len(_AGGS) + 1).cast("int"))
    return part.select(F.concat(agg, F.lit("_"), F.regexp_replace("p_name", " ", "_"),
                                F.lit("_"), F.col("p_partkey").cast("string")).alias("feature"),
                       F.col("p_partkey").alias("pos"))


_CAT_SQL = ("SELECT (['" + "', '".join(_AGGS) + "'])[p_size % " + str(len(_AGGS)) + " + 1] || '_' || "
            "replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) AS feature, p_partkey AS pos FROM part")


@query("keyword_columns", f"""SELECT * FROM ({_CAT_SQL}) c WHERE """
       + " OR ".join(f"contains(lower(feature), '{k}')" for k in AGG_KEYWORDS))
def q_keyword_columns(spark, sf):
    return C.keyword_columns(_catalogue(spark, sf), AGG_KEYWORDS)


@query("keyword_columns_fallback", f"SELECT * FROM ({_CAT_SQL}) c WHERE pos < 200")
def q_keyword_columns_fallback(spark, sf):
    return C.keyword_columns(_catalogue(spark, sf), ["no_such_keyword"], fallback_n=200)


@query("first_columns", f"SELECT * FROM ({_CAT_SQL}) c WHERE pos < 100")
def q_first_columns(spark, sf):
    return C.first_columns(_catalogue(spark, sf), 100)


_UF = """
    ranked AS (SELECT *, row_number() OVER (PARTITION BY disease ORDER BY importance DESC, feature) AS rk FROM imp_multi),
    base AS (SELECT disease FROM imp_multi GROUP BY disease ORDER BY count(*) DESC, disease LIMIT 1),
    uf AS (SELECT DISTINCT feature FROM ranked
           WHERE (disease IN (SELECT disease FROM base) AND rk <= 100)
              OR (disease NOT IN (SELECT disease FROM base) AND rk <= 30))"""


@query("union_features", fx.with_ctes("imp_multi").rstrip() + "," + _UF + "\nSELECT feature FROM uf")
def q_union_features(spark, sf):
    return C.union_features(fx.imp_multi(spark, sf), 100, 30)


@query("union_summary", fx.with_ctes("imp_multi").rstrip() + "," + _UF + """
    SELECT u.feature, round(coalesce(s.m, 0.0), 6) AS mean_importance, coalesce(s.n, 0) AS n_diseases
    FROM uf u LEFT JOIN (SELECT feature, avg(importance) AS m, count(*) AS n FROM imp_multi GROUP BY feature) s
      ON s.feature = u.feature""")
def q_union_summary(spark, sf):
    im = fx.imp_multi(spark, sf)
    return rnd(C.union_summary(C.union_features(im, 100, 30), im), ["mean_importance"])


@query("feature_overlap", """
    SELECT coalesce(a.feature, b.feature) AS feature, a.feature IS NOT NULL AS in_a, b.feature IS NOT NULL AS in_b
    FROM (SELECT DISTINCT replace(p_name, ' ', '_') AS feature FROM part) a
    FULL JOIN (SELECT DISTINCT replace(p.p_name, ' ', '_') AS feature
               FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
               WHERE l.l_returnflag = 'R') b ON a.feature = b.feature""")
def q_feature_overlap(spark, sf):
    part = read_table(spark, f"{sf}/part.parquet")
    li = read_table(spark, f"{sf}/lineitem.parquet").filter(F.col("l_returnflag") == "R")
    a = part.select(F.regexp_replace("p_name", " ", "_").alias("feature"))
    b = li.join(part, li.l_partkey == part.p_partkey).select(
        F.regexp_replace("p_name", " ", "_").alias("feature"))
    return C.feature_overlap(a, b)


_RR = """
    rr AS (SELECT i.*, row_number() OVER (PARTITION BY grp ORDER BY importance DESC, feature) AS rank FROM importances i),
    go AS (SELECT grp, row_number() OVER (ORDER BY max(importance) DESC, grp) AS group_order
           FROM importances GROUP BY grp)"""


@query("group_round_robin", fx.with_ctes("importances").rstrip() + "," + _RR + """
    SELECT rr.feature, rr.grp, rr.importance, rr.rank, go.group_order,
           row_number() OVER (ORDER BY rr.rank, go.group_order) AS pick
    FROM rr JOIN go ON go.grp = rr.grp ORDER BY rr.rank, go.group_order LIMIT 30""")
def q_group_round_robin(spark, sf):
    out = C.group_round_robin(fx.importances(spark, sf), 30)
    return out.withColumns({c: F.col(c).cast("long") for c in ("rank", "group_order", "pick")})


@query("group_priority", fx.with_ctes("importances").rstrip() + """,
    pr AS (SELECT p_brand AS grp, max(p_size) AS priority FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1),
    rr AS (SELECT i.*, row_number() OVER (PARTITION BY grp ORDER BY importance DESC, feature) AS rank FROM importances i),
    go AS (SELECT i.grp, row_number() OVER (ORDER BY min(pr.priority) NULLS LAST, max(importance) DESC, i.grp) AS group_order
           FROM importances i LEFT JOIN pr ON pr.grp = i.grp GROUP BY i.grp)
    SELECT rr.feature, rr.grp, rr.importance, rr.rank, go.group_order,
           row_number() OVER (ORDER BY rr.rank, go.group_order) AS pick
    FROM rr JOIN go ON go.grp = rr.grp ORDER BY rr.rank, go.group_order LIMIT 40""")
def q_group_priority(spark, sf):
    part = read_table(spark, f"{sf}/part.parquet")
    prio = part.filter("p_brand <> 'Brand#11'").groupBy(F.col("p_brand").alias("grp")).agg(F.max("p_size").alias("priority"))
    out = C.group_round_robin(fx.importances(spark, sf), 40, priority=prio)
    return out.withColumns({c: F.col(c).cast("long") for c in ("rank", "group_order", "pick")})


@query("group_best", fx.with_ctes("importances").rstrip() + "," + _RR + """
    SELECT grp, feature, importance FROM rr WHERE rank = 1""")
def q_group_best(spark, sf):
    return C.group_best(fx.importances(spark, sf))

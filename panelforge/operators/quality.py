"""Profiles and data-quality aggregates.

Each statistic is an aggregate expression; a report over many columns is
one ``agg`` (one pass, map-side partial aggregation) whose single row is
then ``stack``-ed into long form on the driver side of the plan.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)


def _q(c: str) -> str:
    return f"`{c}`"


def _stack(df: DataFrame, rows: list[list[str]], names: list[str]) -> DataFrame:
    """Turn one wide row into ``len(rows)`` rows (SQL ``stack``)."""
    body = ", ".join(", ".join(r) for r in rows)
    return df.selectExpr(f"stack({len(rows)}, {body}) AS ({', '.join(names)})")


def _unpivot(one: DataFrame, rows: list[list[str]], names: list[str]) -> DataFrame:
    """The same for rows whose last entry is a number: the values become one array, so that reports
    over very many columns stay within the code-size limit.  The labels, one row each, are joined
    by position."""
    values = F.array(*[F.expr(r[-1]).cast("double") for r in rows])
    text = [(i, *[x[1:-1].replace("\\'", "'") for x in r[:-1]]) for i, r in enumerate(rows)]
    labels = one.sparkSession.createDataFrame(text, "pos int, " + ", ".join(f"{n} string" for n in names[:-1]))
    at = one.select(F.posexplode(values).alias("pos", names[-1]))
    return at.join(labels, "pos").select(*names)


def _lit(s: str) -> str:
    return "'" + s.replace("'", "\\'") + "'"


# -- A1 ---------------------------------------------------------------------
def panel_profile(df: DataFrame, key: str = "id", time: str = "wave") -> DataFrame:
    """rows, distinct subjects, sorted distinct waves."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.count_distinct(key).alias("unique_ids"),
                  F.sort_array(F.collect_set(time)).alias("waves"))


def rows_per_wave(df: DataFrame, time: str = "wave") -> DataFrame:
    return df.groupBy(time).agg(F.count(F.lit(1)).alias("rows"))


# -- A2 ---------------------------------------------------------------------
def missingness(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per requested column: NULL count, percentage (2 places), or a
    ``column_not_present`` status for columns the table lacks."""
    present = [c for c in cols if c in df.columns]
    one = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(present)])
    counts = _unpivot(one, [[_lit(c), f"_m{i}"] for i, c in enumerate(present)] + [["''", "_n"]], ["feature", "missing_count"])
    named = df.sparkSession.createDataFrame([(c, c in present) for c in cols], "feature string, here boolean")
    n = F.max(F.when(F.col("feature") == "", F.col("missing_count"))).over(Window.partitionBy())   # one row a column
    counts = counts.select("feature", "missing_count", n.alias("_n"))
    status = F.when(F.col("here"), "ok").otherwise("column_not_present")
    return named.join(counts, "feature", "left").select(
        "feature", F.col("missing_count").cast("long").alias("missing_count"),
        F.round(F.try_divide(100 * F.col("missing_count"), F.col("_n")), 2).alias("missing_pct"), status.alias("status"))


# -- A3 ---------------------------------------------------------------------
def all_present(cols: list[str]):
    conds = [F.col(c).isNotNull() for c in cols] or [F.lit(True)]
    while len(conds) > 1:   # pairwise: a chain over hundreds of columns would be too deep
        conds = [a & b for a, b in zip(conds[::2], conds[1::2])] + conds[len(conds) // 2 * 2:]
    return conds[0]


def complete_case_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    present = [c for c in cols if c in df.columns]
    complete = F.count_if(all_present(present)) if present else F.lit(0).cast("long")
    return (df.agg(F.count(F.lit(1)).alias("rows_total"), complete.alias("complete_cases"))
            .withColumn("rows_with_any_missing_feature",
                        F.col("rows_total") - F.col("complete_cases")))


#: From so many columns on, statistics are grouped by column instead of being one expression a column:
#: plans over thousands of aggregates take longer to compile than to run.
WIDE = 64


def column_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, pos, n, present, ones, lo, hi, mean) of any number of columns in one pass: each row's values
    become one array, its entries are aggregated by position with partial sums in every task.  Values that are
    not numeric count as present only."""
    num = set(numeric_columns(df, cols))
    values = F.array(*[F.col(_q(c)).cast("double") if c in num else F.when(F.col(_q(c)).isNotNull(), F.lit(0.0)) for c in cols])
    v = F.col("v")
    stats = df.select(F.posexplode(values).alias("pos", "v")).groupBy("pos").agg(
        F.count(F.lit(1)).alias("n"), F.count(v).alias("present"), F.count_if(v == 1).alias("ones"),
        F.min(v).alias("lo"), F.max(v).alias("hi"), F.round(F.avg(v), 4).alias("mean"))
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "pos int, column string")   # a row a column
    zero = {c: F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n", "present", "ones")}
    return names.join(stats, "pos", "left").select("column", "pos", *zero.values(), "lo", "hi", "mean")


# -- A4 ---------------------------------------------------------------------
def target_columns(df: DataFrame, prefix: str = "target_") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def target_balance(df: DataFrame, targets: list[str] | None = None) -> DataFrame:
    """Per target: labelled rows, events, event rate in percent (NULL if none)."""
    targets = targets or target_columns(df)
    if len(targets) > WIDE:
        rate = F.when(F.col("present") > 0, F.round(100 * F.col("ones") / F.col("present"), 2))
        return column_stats(df, targets).select(F.col("column").alias("target"), F.col("present").alias("non_missing"),
                                                F.col("ones").alias("events"), rate.alias("event_rate_pct"))
    aggs = []
    for i, t in enumerate(targets):
        aggs += [F.count(t).alias(f"_v{i}"), F.count_if(F.col(t) == 1).alias(f"_e{i}")]
    one = df.agg(*aggs)
    rows = [[_lit(t), f"_v{i}", f"_e{i}",
             f"CASE WHEN _v{i} > 0 THEN round(100 * _e{i} / _v{i}, 2) END"]
            for i, t in enumerate(targets)]
    return _stack(one, rows, ["target", "non_missing", "events", "event_rate_pct"])


# -- A5 ---------------------------------------------------------------------
def numeric_columns(df: DataFrame, cols: list[str]) -> list[str]:
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in cols if c in types and isinstance(types[c], NUMERIC)]


def feature_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """min / max / mean (4 places) of numeric features, NULLs ignored."""
    num = numeric_columns(df, cols)
    if len(num) > WIDE:
        return column_stats(df, num).select(F.col("column").alias("feature"), F.col("lo").alias("min"), F.col("hi").alias("max"), "mean")
    aggs = []
    for i, c in enumerate(num):
        aggs += [F.min(F.col(c).cast("double")).alias(f"_lo{i}"),
                 F.max(F.col(c).cast("double")).alias(f"_hi{i}"),
                 F.round(F.avg(c), 4).alias(f"_mu{i}")]
    one = df.agg(*aggs)
    rows = [[_lit(c), f"_lo{i}", f"_hi{i}", f"_mu{i}"] for i, c in enumerate(num)]
    return _stack(one, rows, ["feature", "min", "max", "mean"])


# -- A6 ---------------------------------------------------------------------
def _report_columns(model: DataFrame, present: list[str], num: list[str], targets: list[str]) -> DataFrame:
    """The report's rows about single columns, from one pass whatever their number."""
    n, there, ones = F.col("n"), F.col("present"), F.col("ones")
    share = lambda part, whole: F.round(F.try_divide(100 * part, whole), 2)
    row = lambda section, metric, value: F.struct(F.lit(section).alias("section"), F.lit(metric).alias("metric"), value.cast("double").alias("value"))
    feature = [row("missingness", "count", n - there), row("missingness", "pct", share(n - there, n))]
    stats = [row("feature_stats", "min", F.col("lo")), row("feature_stats", "max", F.col("hi")), row("feature_stats", "mean", F.col("mean"))]
    target = [row("target_balance", "non_missing", there), row("target_balance", "events", ones),
              row("target_balance", "event_rate_pct", F.when(there > 0, share(ones, there)))]
    # a target may be among the features: by position, features first
    numeric = F.col("column").isin(num) if len(num) < len(present) else F.lit(True)
    made = F.when(F.col("pos") >= len(present), F.array(*target)).when(numeric, F.array(*feature, *stats)).otherwise(F.array(*feature))
    return (column_stats(model, [*present, *targets]).select(F.col("column").alias("item"), F.explode(made).alias("r"))
            .select("r.section", "item", "r.metric", "r.value"))


def quality_report(long: DataFrame, model: DataFrame, cols: list[str],
                   key: str = "id", time: str = "wave", target: str | None = None) -> DataFrame:
    """Everything above as (section, item, metric, value), with the waves of the
    long table and, for a ``target``, the rows of the final training set (labelled
    complete cases) as sections ``X_final`` and ``y_conditions``.

    The model-table part is a single aggregation pass; the long-table part is
    one more pass plus the rows-per-wave group-by.
    """
    present = [c for c in cols if c in model.columns]
    num = numeric_columns(model, present)
    targets = target_columns(model)
    given, wide = present, None
    if len(present) + len(targets) > WIDE:
        wide = _report_columns(model, present, num, targets)
        present, num, targets = [], [], []
    aggs = [F.count(F.lit(1)).alias("_n"), F.count_if(all_present(given)).alias("_cc")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(present)]
    if target:
        aggs.append(F.count_if(F.col(target).isNotNull() & all_present(given)).alias("_final"))
    for i, t in enumerate(targets):
        aggs += [F.count(t).alias(f"_v{i}"), F.count_if(F.col(t) == 1).alias(f"_e{i}")]
    for i, c in enumerate(num):
        aggs += [F.min(F.col(c).cast("double")).alias(f"_lo{i}"),
                 F.max(F.col(c).cast("double")).alias(f"_hi{i}"),
                 F.round(F.avg(c), 4).alias(f"_mu{i}")]
    one = model.agg(*aggs)
    rows = [["'X_final'", "''", "'rows'", "_final"], ["'y_conditions'", "''", "'rows'", "_final"]] if target else []
    rows += [["'model'", "''", "'rows'", "_n"],
            ["'step5'", "''", "'rows_total'", "_n"],
            ["'step5'", "''", "'complete_cases'", "_cc"],
            ["'step5'", "''", "'rows_with_any_missing_feature'", "_n - _cc"]]
    for i, c in enumerate(present):
        rows += [["'missingness'", _lit(c), "'count'", f"_m{i}"],
                 ["'missingness'", _lit(c), "'pct'", f"round(try_divide(100 * _m{i}, _n), 2)"]]
    for c in cols:
        if c not in given:
            rows.append(["'missingness'", _lit(c), "'column_not_present'", "NULL"])
    for i, t in enumerate(targets):
        rows += [["'target_balance'", _lit(t), "'non_missing'", f"_v{i}"],
                 ["'target_balance'", _lit(t), "'events'", f"_e{i}"],
                 ["'target_balance'", _lit(t), "'event_rate_pct'",
                  f"CASE WHEN _v{i} > 0 THEN round(100 * _e{i} / _v{i}, 2) END"]]
    for i, c in enumerate(num):
        rows += [["'feature_stats'", _lit(c), "'min'", f"_lo{i}"],
                 ["'feature_stats'", _lit(c), "'max'", f"_hi{i}"],
                 ["'feature_stats'", _lit(c), "'mean'", f"_mu{i}"]]
    names = ["section", "item", "metric", "value"]
    model_part = _unpivot(one, rows, names)
    if wide is not None:
        model_part = model_part.unionByName(wide)
    prof = long.agg(F.count(F.lit(1)).cast("double").alias("rows"),
                    F.count_distinct(key).cast("double").alias("unique_ids"))
    long_part = _stack(prof, [["'long'", "''", "'rows'", "rows"],
                              ["'long'", "''", "'unique_ids'", "unique_ids"]], names)
    per_wave = (rows_per_wave(long, time)
                .select(F.lit("long_rows_per_wave").alias("section"),
                        F.col(time).cast("string").alias("item"), F.lit("rows").alias("metric"),
                        F.col("rows").cast("double").alias("value")))
    waves = per_wave.select(F.lit("long").alias("section"), "item", F.lit("waves").alias("metric"),
                            F.col("item").cast("double").alias("value"))
    return long_part.unionByName(per_wave).unionByName(waves).unionByName(model_part)


# -- A14, A15 ---------------------------------------------------------------
def dedup_keys(df: DataFrame, keys=("id", "wave")) -> DataFrame:
    return df.dropDuplicates(list(keys))


def nonzero_importance(imp: DataFrame) -> DataFrame:
    return imp.agg(F.count(F.lit(1)).alias("n_features"),
                   F.count_if(F.col("importance") > 0).alias("n_nonzero"))

"""Forward-looking incident targets.

The original builds each target with three self-merges per condition
(current, t+1, t+2): 24 joins for eight conditions.  Here every condition
shares one window specification (partition by subject, order by wave), so
the whole target block is one shuffle and one sort.  Lookahead is by wave
*number* (a RANGE frame k..k), not by next row, so gaps stay gaps.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import SURVEY_CONDITIONS, TARGET_MAX_WAVE


def _ahead(col: str, k: int, key: str, time: str) -> Column:
    w = Window.partitionBy(key).orderBy(time).rangeBetween(k, k)
    return F.max(col).over(w)


def lookahead(df: DataFrame, cols: list[str], steps=(1, 2), key: str = "id",
              time: str = "wave") -> DataFrame:
    """Add ``<c>_t<k>``: the value of ``c`` at wave + k for the same subject."""
    return df.withColumns({f"{c}_t{k}": _ahead(c, k, key, time) for c in cols for k in steps})


def incident_rule(current: Column, ahead: list[Column]) -> Column:
    """Incident target from the current value and the next waves' values.

    at risk: current == 0; event: any later value == 1 (others may be
    missing); no event: every later value == 0 and present; otherwise NULL.
    Codes other than 0 / 1 count as neither.
    """
    at_risk = F.coalesce(current == 0, F.lit(False))
    event = reduce(lambda a, b: a | b, [F.coalesce(a == 1, F.lit(False)) for a in ahead])
    no_event = reduce(lambda a, b: a & b, [F.coalesce(a == 0, F.lit(False)) for a in ahead])
    return (F.when(at_risk & event, F.lit(1))
             .when(at_risk & no_event, F.lit(0))
             .cast("int"))


def incident_targets(df: DataFrame, conditions: list[str] | None = None, horizon: int = 2,
                     max_wave: int | None = TARGET_MAX_WAVE, key: str = "id",
                     time: str = "wave", prefix: str = "target_") -> DataFrame:
    """Add ``target_<c>`` for every condition column present in ``df``.

    Conditions absent from the table are skipped, as in the original.  Rows
    after ``max_wave`` are dropped after the lookahead (they still feed it).
    """
    wanted = conditions if conditions is not None else [s for s, _ in SURVEY_CONDITIONS]
    present = [c for c in wanted if c in df.columns]
    if not present:
        out = df
    else:
        # every lookahead value once (one Window node for all), then the rule
        ahead = {f"_{c}_t{k}": _ahead(c, k, key, time) for c in present for k in range(1, horizon + 1)}
        rules = {f"{prefix}{c}": incident_rule(F.col(c), [F.col(f"_{c}_t{k}") for k in range(1, horizon + 1)])
                 for c in present}
        out = df.withColumns(ahead).withColumns(rules).drop(*ahead)
    if max_wave is not None:
        out = out.filter(F.col(time) <= max_wave)
    return out


def build_target_one(df: DataFrame, condition: str, **kw) -> DataFrame | None:
    """Single-condition form: (id, wave, target_<c>) or None if absent."""
    if condition not in df.columns:
        return None
    key, time = kw.get("key", "id"), kw.get("time", "wave")
    out = incident_targets(df.select(key, time, condition), [condition], **kw)
    return out.select(key, time, f"{kw.get('prefix', 'target_')}{condition}")


def duplicate_keys(df: DataFrame, keys=("id", "wave")) -> DataFrame:
    """Keys that occur more than once (an empty result means the key is unique)."""
    return df.groupBy(*keys).count().filter(F.col("count") > 1)

"""Wide-to-long reshaping, wave filters and outer unions."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..conf import MAX_WAVE, PanelSpec


def columns_for_wave(columns: list[str], wave: int, prefix: str = "R") -> list[str]:
    """Columns that belong to ``wave`` in a wide file (``R1BMI`` -> wave 1).

    For waves 1-9 the character after the prefix must not be a digit, so
    ``R1BMI`` is wave 1 while ``R10BMI`` is not.  For waves >= 10 the prefix
    alone decides (the original pipeline does not test the next character).
    """
    head = f"{prefix}{wave}"
    picked = []
    for c in columns:
        if not c.startswith(head):
            continue
        rest = c[len(head):]
        if wave <= 9 and rest[:1].isdigit():
            continue
        picked.append(c)
    return picked


def nan_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Map NaN to NULL in float columns (pandas treats NaN as missing)."""
    floats = {f.name for f in df.schema.fields
              if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    todo = [c for c in (columns or df.columns) if c in floats]
    if not todo:
        return df
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in todo})


def _common_type(types: list[T.DataType]) -> T.DataType:
    first = types[0]
    if all(t == first for t in types):
        return first
    if all(isinstance(t, T.NumericType) for t in types):
        return T.DoubleType()
    return T.StringType()


def wide_to_long(df: DataFrame, key: str | None = None, prefix: str | None = None,
                 waves: range | list[int] = range(1, MAX_WAVE + 1),
                 spec: PanelSpec = PanelSpec(), nan_as_null: bool = True) -> DataFrame:
    """One row per (id, wave) from a wide table, in a single narrow pass.

    Every wave that has at least one column produces a row for every subject,
    even when all of its values are NULL.  Concepts missing from a wave are NULL
    (outer union).  The plan is a projection plus ``stack`` - no shuffle.
    """
    key = key or spec.wide_key
    prefix = prefix or spec.prefix
    types = {f.name: f.dataType for f in df.schema.fields}
    per_wave: list[tuple[int, dict[str, str]]] = []
    concepts: list[str] = []
    for w in waves:
        cols = [c for c in columns_for_wave(df.columns, w, prefix) if c != key]
        mapping = {}
        for c in cols:
            concept = c[len(f"{prefix}{w}"):]
            if not concept:          # a bare "R1" column has no concept name
                continue
            mapping[concept] = c
            if concept not in concepts:
                concepts.append(concept)
        if mapping:
            per_wave.append((w, mapping))
    if not per_wave:
        raise ValueError(f"no wave columns with prefix {prefix!r} in {df.columns[:20]}")
    ctype = {c: _common_type([types[m[c]] for _, m in per_wave if c in m]) for c in concepts}
    # SQL ``stack``: a code-generated generator, several times faster than
    # ``inline(array(struct(...)))`` on wide rows; still a single narrow pass.
    rows = []
    for w, mapping in per_wave:
        vals = [f"CAST(`{mapping[c]}` AS {ctype[c].simpleString()})" if c in mapping
                else f"CAST(NULL AS {ctype[c].simpleString()})" for c in concepts]
        rows.append(", ".join([f"CAST({w} AS INT)"] + vals))
    names = ", ".join([f"`{spec.time}`"] + [f"`{c}`" for c in concepts])
    long = df.selectExpr(f"CAST(`{key}` AS BIGINT) AS `{spec.key}`",
                         f"stack({len(rows)}, {', '.join(rows)}) AS ({names})")
    return nan_to_null(long, concepts) if nan_as_null else long


def filter_waves(df: DataFrame, lo: int, hi: int, time: str = "wave") -> DataFrame:
    """Inclusive wave range; pushed to the scan / partition filter by Catalyst."""
    return df.filter(F.col(time).between(lo, hi))


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Outer-column union: columns absent from a frame become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

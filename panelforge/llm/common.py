"""Helpers shared by the text operators."""
from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side may be broadcast when it has no more rows than this (rows of at most a few hundred bytes);
#: a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000
#: The same for the bytes of a side whose rows have no bound of their own.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS, *, size: Column | None = None) -> DataFrame:
    """``df`` with a broadcast hint if counting proves it small, else as it is.  ``size``: the bytes of
    a row, where rows may be of any length."""
    some = df.limit(rows + 1)
    if size is None:
        return F.broadcast(df) if some.count() <= rows else df
    n, total = some.agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= BROADCAST_BYTES else df


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once; a plain reference inside a lambda would be
    computed again for every element."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; NULL is the empty text."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(
        F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def same_row(a: DataFrame, b: DataFrame, *cols: str) -> Column:
    """Null-safe equality of the columns of both sides."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & a[c].eqNullSafe(b[c])
    return cond


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table below the shared checkpoint folder and read back: cuts the lineage
    and survives lost executors. The table goes when the application ends."""
    from panelforge.session import cut_lineage
    return cut_lineage(df, name)


def sum_blocks(parts: DataFrame, dtype: str, fan_in: int = 64, ordered: bool = False) -> DataFrame:
    """Sum arrays that the tasks of a job made: rows (part, block, payload), payload a zlib-packed
    array of ``dtype``, give one row (block, payload) a block.  Groups of ``fan_in`` parts are
    summed first, so no task reads the arrays of all tasks.  ``ordered`` adds them by part, so that rounding is always the same."""
    import zlib

    import numpy as np
    import pandas as pd

    def add(frame):
        total = 0
        for p in (frame.sort_values("part") if ordered else frame)["payload"]:
            total = total + np.frombuffer(zlib.decompress(p), dtype)
        return pd.DataFrame({"part": [int(frame["part"].iloc[0])], "block": [int(frame["block"].iloc[0])],
                             "payload": [zlib.compress(total.astype(dtype).tobytes(), 1)]})

    schema = "part int, block int, payload binary"
    first = parts.withColumn("part", (F.col("part") / fan_in).cast("int")).groupBy("part", "block").applyInPandas(add, schema)
    return (first if ordered else first.withColumn("part", F.lit(0))).groupBy("block").applyInPandas(add, schema)


def pack(docs: DataFrame, *named: str) -> tuple[DataFrame, list[Column]]:
    """(frame, columns): the named columns and the others as one struct ``_rest``, so that no name of
    theirs can clash with a working column; ``frame.select(columns)`` gives the columns of docs again."""
    rest = [c for c in docs.columns if c not in named]
    held = F.struct(*[docs[f"`{c}`"] for c in rest]) if rest else F.lit(0)
    return docs.select(*[docs[f"`{c}`"] for c in named], held.alias("_rest")), [
        F.col(f"`{c}`") if c in named else F.col("_rest").getField(c).alias(c) for c in docs.columns]

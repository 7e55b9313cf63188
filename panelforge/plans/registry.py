"""Named queries: a Spark builder ``(spark, sf_dir) -> DataFrame`` and, where
the semantics are SQL-expressible, the equivalent DuckDB SQL over the same
parquet tables."""
from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict[str, tuple[Callable, str | None]]:
    from . import q_panel, q_quality, q_metrics, q_runs, q_select, q_sources, q_models, q_scalars  # noqa: F401
    return QUERIES

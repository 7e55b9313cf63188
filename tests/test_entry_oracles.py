import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 8 and df.columns == ["target", "non_missing", "events", "event_rate_pct"]


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 70


def _norm(v):
    import math

    import pandas as pd
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v.is_integer() else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ["incident_targets", "wide_to_long", "quality_report", "evaluate_tasks",
                                  "classification_report", "compare_runs", "union_summary", "sample_fraction",
                                  "temporal_pct_change", "task_split", "feature_sets", "param_impact"])
def test_against_duckdb(spark, duck, name):
    sdf = E.queries()[name](spark, SF).toPandas()
    ddf = duck.execute(E.oracle_sql()[name]).df()
    assert sorted(sdf.columns) == sorted(ddf.columns)
    cols = sorted(sdf.columns)

    def rows(pdf):
        return sorted((tuple(_norm(x) for x in r) for r in pdf[cols].astype(object).itertuples(index=False)),
                      key=lambda r: tuple((x is None, str(x)) for x in r))
    assert rows(sdf) == rows(ddf)

"""Registered queries agree with their DuckDB oracles (fast subset at sf0.001), and every
double column is declared for rounding."""

import math

import duckdb
import pytest
from pyspark.sql import types as T

from tests.conftest import SF_SMALL

FAST = ["health_status", "alerts", "fleet_stats", "rul_history", "fleet_percentile", "recommendations",
        "chrono_split", "ts_folds", "strat_folds", "null_audit", "dedup_first", "impute_fit", "soc_range_rolling",
        "describe_ext", "histogram", "regime_runs", "ir_by_soc", "roc_auc", "threshold_sweep", "cls_report",
        "single_class_guard", "select_classifier", "trend_series"]


def _norm(v):
    import pandas as pd
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["events"]:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF_SMALL)
    pdf = df.toPandas()
    rel = con.sql(E.oracle_sql()[name])
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    spark_types = {f.name: names.get(f.dataType.simpleString()) for f in df.schema.fields}
    assert spark_types == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    odf = rel.fetchdf()
    cols = sorted(pdf.columns)
    assert cols == sorted(odf.columns)
    a = sorted((tuple(_norm(r[c]) for c in cols) for _, r in pdf.iterrows()), key=repr)
    b = sorted((tuple(_norm(r[c]) for c in cols) for _, r in odf.iterrows()), key=repr)
    assert a == b


@pytest.mark.parametrize("name", FAST)
def test_doubles_declared(spark, name):
    from cellscope.plans.registry import REGISTRY
    q = REGISTRY[name]
    df = q.build(spark, SF_SMALL)
    dbl = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    assert dbl <= set(q.digits), dbl - set(q.digits)


def test_every_oracle_has_a_query():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["battery_id", "seq", "health_score", "status", "n_alerts"]
    assert df.count() > 0

"""Model layer on the smallest fixture: prepared data, scoring, early stopping, RFE."""

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def test_predict_batch_keeps_raw_columns(spark):
    from cellscope.plans import model_queries as mq
    from cellscope.sources import telemetry
    out = mq.scored(spark, SF_SMALL)
    t = telemetry(spark, SF_SMALL)
    assert out.count() == t.count()
    j = out.select("battery_id", "seq", "SOC", "pred_internal_resistance", "pred_over_temp_prob") \
        .join(t.select("battery_id", "seq", F.col("SOC").alias("SOC_raw")), ["battery_id", "seq"])
    assert j.where(~F.col("SOC").eqNullSafe(F.col("SOC_raw"))).count() == 0
    assert j.where(F.col("pred_internal_resistance").isNull() | F.col("pred_over_temp_prob").isNull()).count() == 0
    assert "over_temp_flag" not in out.columns and "internal_resistance" in out.columns


def test_early_stop_patience(spark):
    from cellscope.plans import model_queries as mq
    from cellscope.operators import train
    tr, va, _ = mq.parts(spark, SF_SMALL)
    c = train.early_stop_curve(tr, va, mq.REG_FEATURES, mq.Y, max_iter=15, patience=3, maxDepth=2).collect()
    best = min(range(len(c)), key=lambda i: c[i].val_rmse)
    assert c[0].best_round == best + 1
    assert c[0].stopped_at <= len(c)


def test_rfe_keeps_fifteen(spark):
    from cellscope.plans import model_queries as mq
    from cellscope.operators import train
    tr, _, _ = mq.parts(spark, SF_SMALL)
    feats = [c for c in mq.ALL_FEATURES if c != "internal_resistance"]
    r = train.rfe(tr, feats, mq.Y, keep=15, step=4).collect()
    assert sum(1 for x in r if x.rank == 1) == 15 and len(r) == len(feats)


def test_registered_boosting_runs_the_rounds_of_the_reference(spark, monkeypatch):
    from cellscope.operators import train
    from cellscope.plans import model_queries as mq

    class Seen(Exception):
        pass

    def stop(*a, **k):
        raise Seen(k.get("max_iter", k.get("maxIter")))
    for name, query, rounds in (("early_stop_curve", mq.q_early_stop_curve, 500), ("fit_gbt_cls", mq.q_fit_gbt_cls, 300)):
        monkeypatch.setattr(train, name, stop)
        try:
            query(spark, SF_SMALL)
        except Seen as e:
            assert e.args[0] == rounds
        else:
            raise AssertionError(name)


def test_registered_searches_run_the_grids_of_the_reference(spark, monkeypatch):
    from cellscope.operators import train
    from cellscope.plans import model_queries as mq

    class Seen(Exception):
        pass

    def stop(data, features, label, grid, **k):
        raise Seen(grid)
    for name, query, points in (("grid_search_reg", mq.q_grid_search_reg, 24), ("grid_search_cls", mq.q_grid_search_cls, 18)):
        monkeypatch.setattr(train, name, stop)
        try:
            query(spark, SF_SMALL)
        except Seen as e:
            assert len(train.grid_points(e.args[0])) == points
        else:
            raise AssertionError(name)


def test_trend_series_is_whole_without_points(spark):
    import __spark_entry__ as E
    import duckdb
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{SF_SMALL}/events.parquet')")
    want = con.sql(E.oracle_sql()["trend_series_full"]).df()
    got = E.queries()["trend_series_full"](spark, SF_SMALL).toPandas()[list(want.columns)]
    assert len(got) == len(want) > 200
    import pandas as pd
    pd.testing.assert_frame_equal(got.sort_values("point", ignore_index=True), want.sort_values("point", ignore_index=True), check_dtype=False)

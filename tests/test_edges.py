"""Edge frames (FIXTURES section 3)."""

import pytest
from pyspark.sql import functions as F

from cellscope.functions.exprs import over_voltage, soc_bin
from cellscope.operators import evaluate as ev
from cellscope.operators import fleet as fl
from cellscope.operators.features import soc_range_rolling


def test_cls_metrics_reference_vector(spark):
    conf = spark.createDataFrame([(1264, 9, 22, 35)], "tp long, fp long, fn long, tn long")
    m = ev.cls_metrics(conf).first()
    assert round(m.precision, 4) == 0.9929 and round(m.recall, 4) == 0.9829 and round(m.f1, 4) == 0.9879


def test_single_class_auc_is_null(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.6)], "label int, prob double")
    r = ev.roc_auc(df).first()
    assert r.roc_auc is None and r.reason.startswith("single class")


def test_auc_equals_rank_statistic_with_ties(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (1, 0.1), (0, 0.3)]
    df = spark.createDataFrame(rows, "label int, prob double")
    pos = [p for l, p in rows if l == 1]
    neg = [p for l, p in rows if l == 0]
    u = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg) / (len(pos) * len(neg))
    assert ev.roc_auc(df).first().roc_auc == pytest.approx(u)


def test_voltage_rule_strict_and_null(spark):
    df = spark.createDataFrame([(4.15, 4.0), (4.16, None), (None, 4.18), (None, 4.19), (float("nan"), 1.0)],
                               "action_voltage double, terminal_voltage double")
    from cellscope.sources.telemetry import nan_to_null
    got = [r[0] for r in nan_to_null(df).select(over_voltage()).collect()]
    assert got == [0, 1, 0, 1, 0]


def test_soc_bin_constant_is_the_middle_bin(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "SOC double")
    assert [r[0] for r in df.select(soc_bin("SOC", F.lit(5.0), F.lit(5.0), 20)).collect()] == [9, 9]


def _fleet(spark):
    return spark.createDataFrame([(0.05, 0.01, 0.02, 0.12, 100.0, 10.0, 1.0, 0.85, 100, 3)],
                                 ",".join(f"{c} {'long' if c in ('total_rows', 'n_batteries') else 'double'}"
                                          for c in fl.FLEET_COLS))


def test_health_above_100_and_end_of_life(spark):
    df = spark.createDataFrame([(0.01, 0, 0), (0.12, 1, 1)], "internal_resistance double, over_temp_flag int, "
                                                             "over_voltage_flag int")
    h = fl.health(df, _fleet(spark)).orderBy("internal_resistance").collect()
    assert h[0].ir_health > 100 and h[0].status == "HEALTHY"
    assert h[1].health_score == pytest.approx(24.0) and h[1].status == "END_OF_LIFE"


def test_rul_flat_history_is_null_and_short_history_uses_fleet(spark):
    rows = [(1, i, 0.05) for i in range(5)] + [(2, 0, 0.05), (2, 1, 0.06)]
    df = spark.createDataFrame(rows, "battery_id long, seq long, internal_resistance double")
    r = {x.battery_id: x for x in fl.rul_history(df, _fleet(spark)).collect()}
    assert r[1].rate_source == "history" and r[1].cycles_remaining is None
    assert r[2].rate_source == "fleet" and r[2].cycles_remaining == int((0.15 - 0.06) / (0.01 / 100))


@pytest.mark.parametrize("n", [1, 9, 10])
def test_rolling_short_frames(spark, n):
    rows = [(1, i, "train", float(i)) for i in range(n)]
    df = spark.createDataFrame(rows, "battery_id long, seq long, split string, SOC double")
    got = soc_range_rolling(df, pos_col=None).orderBy("seq").collect()
    if n < 10:
        assert all(r.soc_range_rolling is None for r in got)
    else:
        assert all(r.soc_range_rolling == 9.0 for r in got)


def test_correlation_does_not_depend_on_the_number_of_columns(spark):
    from cellscope.operators.profile import corr_matrix
    rows = [(float(i), float(i * i % 17), None if i % 5 == 0 else float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    r = lambda wide: {(x.feature_a, x.feature_b): round(x.r, 9) for x in corr_matrix(df, ["a", "b", "c"], wide).collect()}
    assert r(40) == r(0)
    full = lambda wide: {(x.feature_a, x.feature_b): round(x.r, 9) for x in corr_matrix(df, ["a", "b"], wide).collect()}
    assert full(40) == full(0)


def test_csv_is_read_by_name_and_without_ids(spark, tmp_path):
    from cellscope.sources import read_batch, read_csv, telemetry
    from tests.conftest import SF_SMALL
    t = telemetry(spark, SF_SMALL)
    cols = [c for c in t.columns if c not in ("battery_id", "seq")]
    turned = t.orderBy("seq").coalesce(1).select(*reversed(cols), t.seq.alias("timestamp"))
    turned.write.option("header", True).csv(f"{tmp_path}/own")
    got = read_csv(spark, f"{tmp_path}/own")
    assert got.columns == t.columns and got.where("battery_id is not null").count() == 0
    want = {r.seq: (r.SOC, r.SOH) for r in t.collect()}
    assert {r.seq: (r.SOC, r.SOH) for r in got.collect()} == want
    t.select("SOC", "SOH").write.option("header", True).csv(f"{tmp_path}/part")
    assert read_batch(spark, f"{tmp_path}/part").where("seq is null or terminal_voltage != 0").count() == 0
    try:
        read_csv(spark, f"{tmp_path}/part")
        raise AssertionError("a missing column must fail")
    except ValueError as e:
        assert "terminal_voltage" in str(e)


def test_batch_without_ids_is_scored(spark, tmp_path):
    from cellscope.plans import model_queries as mq
    from cellscope.operators import score
    from cellscope.sources import read_batch, telemetry
    from tests.conftest import SF_SMALL
    telemetry(spark, SF_SMALL).drop("battery_id", "seq").write.option("header", True).csv(f"{tmp_path}/batch")
    params, _ = mq.prepared(spark, SF_SMALL)
    reg, cls = mq._models(spark, SF_SMALL)
    out = score.predict_batch(read_batch(spark, f"{tmp_path}/batch"), params, reg, cls, mq.REG_FEATURES, mq.CLS_FEATURES)
    assert out.count() == 1000 and out.where("pred_internal_resistance is null").count() == 0


def test_absent_voltage_column_counts_as_zero(spark):
    from cellscope.functions.exprs import over_voltage_of
    df = spark.createDataFrame([(4.2,), (1.0,)], "action_voltage double")
    assert [r[0] for r in df.select(over_voltage_of(df)).collect()] == [1, 0]
    assert spark.range(1).select(over_voltage_of(spark.range(1))).first()[0] == 0


def test_learning_curve_prefix(spark):
    """Fractions are of each battery's own part of the first fold's train rows."""
    from cellscope.operators.train import curve_prefix
    rows = [(b, i, n) for b, n in ((1, 60), (2, 13)) for i in range(n)]
    df = spark.createDataFrame(rows, "b int, split_pos long, split_rows long")
    got = {r.b: r.n for r in df.where(curve_prefix(0.5)).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {1: 5, 2: 1}


def test_prep_leaves_an_empty_feature_out_or_fails(spark, tmp_path):
    """A feature without any train value: not among the fitted columns; asking for it fails."""
    from cellscope.operators import prep, splits
    from cellscope.sources import telemetry
    from tests.conftest import SF_SMALL
    t = splits.chrono_split(telemetry(spark, SF_SMALL).where("seq < 300").withColumn("charging_time", F.lit(None).cast("double")))
    params, x = prep.prep_fit_transform(t, ["SOC", "soc_range_rolling"])
    assert "charging_time" not in params.columns and "SOC" in params.columns
    assert x.where("SOC is null or soc_range_rolling is null").count() == 0
    with pytest.raises(ValueError, match="charging_time"):
        prep.prep_fit_transform(t, ["SOC", "charging_time"])
    with pytest.raises(ValueError, match="charging_time"):
        prep.prep_transform(t, params, ["charging_time"])
    params.save(str(tmp_path))
    back = prep.PrepParams.load(spark, str(tmp_path))
    assert back.columns == params.columns
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(prep.prep_transform(t, back, ["SOC"])) == rows(prep.prep_transform(t, params, ["SOC"]))

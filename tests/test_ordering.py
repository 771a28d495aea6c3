"""Order primitives equal plain windows / pandas, for any bucket count and chunk size."""

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cellscope.operators import ordering
from cellscope.operators.ordering import exact_quantiles, rolling_frame, with_position
from cellscope.sources import telemetry
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("buckets", [1, 4, 16])
def test_position_matches_row_number(spark, buckets):
    t = telemetry(spark, SF_SMALL).select("battery_id", "seq")
    p = with_position(t, n_buckets=buckets)
    w = Window.partitionBy("battery_id").orderBy("seq")
    ref = t.select("battery_id", "seq", (F.row_number().over(w) - 1).alias("p2"),
                   F.count(F.lit(1)).over(Window.partitionBy("battery_id")).alias("n2"))
    j = p.join(ref, ["battery_id", "seq"])
    assert j.count() == t.count()
    assert j.where((F.col("pos") != F.col("p2")) | (F.col("n_rows") != F.col("n2"))).count() == 0


def test_halo_rolling_equals_window(spark):
    t = telemetry(spark, SF_SMALL).select("battery_id", "seq", "SOC")
    p = with_position(t)
    rng = {"r": lambda w: F.when(F.count("SOC").over(w) == 10, F.max("SOC").over(w) - F.min("SOC").over(w))}
    got = rolling_frame(p, rng, 10, "pos", ["battery_id"], chunk_rows=11)
    w = Window.partitionBy("battery_id").orderBy("seq").rowsBetween(-9, 0)
    ref = t.select("battery_id", "seq", F.when(F.count("SOC").over(w) == 10,
                                               F.max("SOC").over(w) - F.min("SOC").over(w)).alias("r2"))
    j = got.join(ref, ["battery_id", "seq"])
    assert j.count() == t.count()
    assert j.where(~F.col("r").eqNullSafe(F.col("r2"))).count() == 0


def test_exact_quantiles_equal_pandas(spark):
    t = telemetry(spark, SF_SMALL)
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    q = {(r.feature, r.p): r.value for r in exact_quantiles(t, ["SOC", "charging_time"], probs, n_buckets=8).collect()}
    pdf = t.select("SOC", "charging_time").toPandas()
    for (f, p), v in q.items():
        assert v == pytest.approx(pdf[f].quantile(p), rel=1e-12)


@pytest.mark.parametrize("by", [(), ("battery_id",)])
def test_row_level_window_is_keyed_by_bucket(spark, by, monkeypatch):
    """With a group too large for one task: The row-level window is fed by a hash exchange on (group..., bucket); the only
    single-partition exchanges merge partial aggregates (K bounds) or the K-row bucket table."""
    import re
    monkeypatch.setattr(ordering, "GROUP_ROWS", 0)
    t = telemetry(spark, SF_SMALL)
    df = with_position(t, by=by).select("seq", "pos")
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    key = r"Exchange hashpartitioning\(" + "".join(f"{c}#\\d+L, " for c in by) + r"_bk#\d+"
    assert re.search(key, plan), plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = " ".join(lines[i + 1:i + 3])
            assert "partial_" in below or "_s_rows" in below or "HashAggregate" in below, below


def test_small_groups_take_one_window(spark, monkeypatch):
    """Groups that fit a task need no bounds and no join, and give the same positions."""
    t = telemetry(spark, SF_SMALL).select(F.when(F.col("seq") % 11 != 0, F.col("battery_id")).alias("battery_id"), "seq")
    plain = with_position(t)
    assert "Join" not in plain._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ordering, "GROUP_ROWS", 0)
    bucketed = with_position(t)
    rows = lambda df: sorted(map(str, df.select("battery_id", "seq", "pos", "n_rows").collect()))
    assert rows(plain) == rows(bucketed) and len(rows(plain)) == t.count()


def _frame_of_all_kinds(spark, n=12_000):
    """Continuous, heavily tied, constant, short and empty columns; a group key with NULL."""
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 != 0, F.col("id") % 3).alias("g"), (F.hash("id") / 7.0).alias("wide"), (F.hash("id") % 4).alias("tied"),
        F.lit(2.5).alias("flat"), F.when(F.col("id") < 5, F.col("id")).alias("short"), F.lit(None).cast("double").alias("none"))
    return rows, ["wide", "tied", "flat", "short", "none"]


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("group_rows", [1_000_000, 5])
def test_bracketed_quantiles_of_all_kinds(spark, by, group_rows, monkeypatch):
    monkeypatch.setattr(ordering, "GROUP_ROWS", group_rows)
    df, cols = _frame_of_all_kinds(spark)
    probs = [0.0, 0.01, 0.5, 0.505, 0.99, 1.0]
    got = {(r["g"] if by else None, r.feature, r.p): r.value for r in exact_quantiles(df, cols, probs, by).collect()}
    pdf = df.toPandas()
    groups = [(g if g == g else None, x) for g, x in pdf.groupby("g", dropna=False)] if by else [(None, pdf)]
    want = {(g, c, p): x[c].quantile(p) for g, x in groups for c in cols for p in probs if x[c].notna().any()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_bracketed_quantiles_shuffle_few_values(spark):
    df, _ = _frame_of_all_kinds(spark, 200_000)
    r = df.agg(F.percentile_approx("wide", [0.499, 0.501], 2_000)).first()[0]
    counts = ordering._bracketed_counts(df.select("wide"), ["wide"], [], {(): [list(r)]}, 1)
    assert counts.agg(F.sum("c")).first()[0] == 200_000
    assert 100 < counts.count() < 0.01 * 200_000


def test_a_missed_bracket_is_counted_whole(spark, monkeypatch):
    """Segments that do not hold the quantile give the same numbers by the second way."""
    df, _ = _frame_of_all_kinds(spark)
    right = exact_quantiles(df, ["wide"], [0.5]).first()["value"]
    monkeypatch.setattr(ordering, "_segments", lambda bounds, n: [1e18, 2e18])
    assert exact_quantiles(df, ["wide"], [0.5]).first()["value"] == right


def test_quantiles_of_many_groups_and_of_none(spark, monkeypatch):
    df, cols = _frame_of_all_kinds(spark)
    rows = lambda x: sorted(map(str, x.collect()))
    few = rows(exact_quantiles(df, cols, [0.5], ["g"]))
    monkeypatch.setattr(ordering, "BRACKET_GROUPS", 2)
    assert rows(exact_quantiles(df, cols, [0.5], ["g"])) == few
    for by in ([], ["g"]):
        empty = exact_quantiles(df.where("false"), cols, [0.5], by)
        assert empty.columns == [*by, "feature", "p", "value"] and empty.count() == 0

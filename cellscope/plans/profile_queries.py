"""Registered queries: profiling and SOC-binned analytics (2.7)."""

from __future__ import annotations

from itertools import combinations

from cellscope.operators import profile as pr
from cellscope.operators import soc
from cellscope.operators.project import SELECTED_FEATURES
from cellscope.plans.registry import register
from cellscope.sources.telemetry import RAW_FEATURES, TARGETS, TELEMETRY_SCHEMA, telemetry

KEYS = ["battery_id", "seq"]
NUM = RAW_FEATURES + TARGETS
GROUP_FEATS = ["internal_resistance", "thermal_stress_index", "charging_efficiency", "SOH"]
TREND_COLS = ["battery_temp", "SOC", "SOH", "cycle_degradation"]
P = pr.DESCRIBE_PERCENTILES


def _union(parts):
    return "\nunion all\n".join(parts)


@register("table_shape", ", n as (select count(*) as n_rows from telemetry)\n" + _union(
    [f"select {i} as position, '{f.name}' as column_name, '{f.dataType.simpleString()}' as dtype, n_rows, "
     f"{len(TELEMETRY_SCHEMA.fields)} as n_cols from n" for i, f in enumerate(TELEMETRY_SCHEMA.fields)]))
def q_table_shape(spark, sf_dir):
    return pr.table_shape(telemetry(spark, sf_dir))


DESCRIBE_SQL = _union([
    f"select '{c}' as feature, count({c}) as count, avg({c}) as mean, stddev_samp({c}) as std, "
    f"cast(min({c}) as double) as min, "
    + ", ".join(f"quantile_cont({c}, {p}) as {pr._pname(p)}" for p in P)
    + f", cast(max({c}) as double) as max, cast(max({c}) as double) - cast(min({c}) as double) as range from telemetry"
    for c in NUM])


@register("describe_ext", DESCRIBE_SQL,
          doubles=["mean", "std", "min", "max", "range"] + [pr._pname(p) for p in P],
          special={"mean": 7})  # one mean is an exact tie at six digits, which either engine may round up or down
def q_describe_ext(spark, sf_dir):
    return pr.describe_ext(telemetry(spark, sf_dir), NUM)


@register("skewness", _union([f"select '{c}' as feature, skewness({c}) as skew from telemetry" for c in NUM]),
          doubles=["skew"])
def q_skewness(spark, sf_dir):
    return pr.skewness(telemetry(spark, sf_dir), NUM)


@register("value_counts", _union([
    f"select '{c}' as feature, cast({c} as double) as value, count(*) as count from telemetry group by {c}"
    for c in ["over_temp_flag", "over_voltage_flag"]]), doubles=["value"])
def q_value_counts(spark, sf_dir):
    return pr.value_counts(telemetry(spark, sf_dir), ["over_temp_flag", "over_voltage_flag"])


HIST_SQL = """, mm as (select cast(min(internal_resistance) as double) as lo, cast(max(internal_resistance) as double) as hi
  from telemetry)
, c as (
  select cast(least(29, floor((internal_resistance - lo) / (hi - lo) * 30)) as integer) as bin, count(*) as n
  from telemetry cross join mm where internal_resistance is not null group by 1)
select cast(g.bin as integer) as bin, lo + (hi - lo) * g.bin / 30 as bin_lo, lo + (hi - lo) * (g.bin + 1) / 30 as bin_hi,
  coalesce(n, 0) as count
from range(30) g(bin) cross join mm left join c on c.bin = g.bin"""


@register("histogram", HIST_SQL, doubles=["bin_lo", "bin_hi"])
def q_histogram(spark, sf_dir):
    return pr.histogram(telemetry(spark, sf_dir), "internal_resistance", 30)


BOX_COLS = RAW_FEATURES[:8]
BOX_SQL = """, q as (""" + _union([
    f"select '{c}' as feature, quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from telemetry"
    for c in BOX_COLS]) + """)
, w as (select feature, q1, q3, q3 - q1 as iqr, q1 - 1.5e0 * (q3 - q1) as lower, q3 + 1.5e0 * (q3 - q1) as upper from q)
, o as (""" + _union([
    f"select '{c}' as feature, count_if({c} < lower or {c} > upper) as n_outliers from telemetry "
    f"cross join (select * from w where feature = '{c}') x" for c in BOX_COLS]) + """)
select w.*, n_outliers from w join o using (feature)"""


@register("box_stats", BOX_SQL, doubles=["q1", "q3", "iqr", "lower", "upper"])
def q_box_stats(spark, sf_dir):
    return pr.box_stats(telemetry(spark, sf_dir), BOX_COLS)


GROUP_SQL = _union([
    f"select over_temp_flag, '{c}' as feature, avg({c}) as mean, cast(min({c}) as double) as min, "
    f"cast(max({c}) as double) as max, quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.5) as median, "
    f"quantile_cont({c}, 0.75) as q3 from telemetry group by over_temp_flag" for c in GROUP_FEATS])


@register("group_dist", GROUP_SQL, doubles=["mean", "min", "max", "q1", "median", "q3"])
def q_group_dist(spark, sf_dir):
    return pr.group_dist(telemetry(spark, sf_dir), "over_temp_flag", GROUP_FEATS)


PAIRS = list(combinations(NUM, 2))
CORR_CTE = ", a as (select " + ", ".join(f"corr({x}, {y}) as r{i}" for i, (x, y) in enumerate(PAIRS)) + \
    " from telemetry)\n, cm as (" + _union(
        [f"select '{x}' as feature_a, '{y}' as feature_b, r{i} as r from a" for i, (x, y) in enumerate(PAIRS)]) + ")"


@register("corr_matrix", CORR_CTE + "\nselect * from cm", doubles=["r"])
def q_corr_matrix(spark, sf_dir):
    return pr.corr_matrix(telemetry(spark, sf_dir), NUM)


@register("high_corr_pairs", CORR_CTE + "\nselect * from cm where abs(r) > 0.85e0", doubles=["r"])
def q_high_corr_pairs(spark, sf_dir):
    return pr.high_corr_pairs(pr.corr_matrix(telemetry(spark, sf_dir), NUM))


PAIR_SQL = _union([f"select '{a}' as feature_a, '{b}' as feature_b, corr({a}, {b}) as r from telemetry"
                   for a, b in pr.CHOSEN_PAIRS])


@register("pair_corr", PAIR_SQL, doubles=["r"])
def q_pair_corr(spark, sf_dir):
    return pr.pair_corr(telemetry(spark, sf_dir))


@register("redundancy_rule", "select *, case when abs(r) > 0.95e0 then feature_a end as drop_feature from (\n"
          + PAIR_SQL + ") x", doubles=["r"])
def q_redundancy_rule(spark, sf_dir):
    return pr.redundancy_rule(pr.pair_corr(telemetry(spark, sf_dir)))


FEATS_NO_TARGET = [c for c in RAW_FEATURES if c != "internal_resistance"]
CWT_CTE = ", c as (" + _union([f"select '{c}' as feature, abs(corr({c}, internal_resistance)) as abs_r from telemetry"
                               for c in FEATS_NO_TARGET]) + """)
, rk as (select feature, abs_r, cast(row_number() over (order by round(abs_r, 12) desc nulls last, feature) as integer) as rank from c)"""


@register("corr_with_target", CWT_CTE + "\nselect * from rk", doubles=["abs_r"])
def q_corr_with_target(spark, sf_dir):
    return pr.corr_with_target(telemetry(spark, sf_dir), RAW_FEATURES, "internal_resistance")


@register("weak_features", CWT_CTE + "\nselect * from rk where abs_r < 0.03e0", doubles=["abs_r"])
def q_weak_features(spark, sf_dir):
    return pr.weak_features(pr.corr_with_target(telemetry(spark, sf_dir), RAW_FEATURES, "internal_resistance"))


TREND_SQL = """, p as (select *, row_number() over (order by seq) - 1 as pos, count(*) over () as n_rows from telemetry)
select cast(floor(pos * 200 / n_rows) as bigint) as point, min(seq) as seq_from, max(seq) as seq_to, count(*) as n, """ + \
    ", ".join(f"avg({c}) as {c}" for c in TREND_COLS) + " from p group by 1"


@register("trend_series", TREND_SQL, doubles=TREND_COLS)
def q_trend_series(spark, sf_dir):
    return pr.trend_series(telemetry(spark, sf_dir), TREND_COLS, 200)


TREND_FULL_SQL = """
select cast(row_number() over (order by seq) - 1 as bigint) as point, seq as seq_from, seq as seq_to, cast(1 as bigint) as n, """ + \
    ", ".join(f"cast({c} as double) as {c}" for c in TREND_COLS) + " from telemetry"


@register("trend_series_full", TREND_FULL_SQL, doubles=TREND_COLS)
def q_trend_series_full(spark, sf_dir):
    return pr.trend_series(telemetry(spark, sf_dir), TREND_COLS)


REGIME_SQL = """, p as (
  select battery_id, seq, over_temp_flag,
    row_number() over (partition by battery_id order by seq) - 1 as p,
    row_number() over (partition by battery_id, over_temp_flag order by seq) - 1 as pf
  from telemetry)
select battery_id, over_temp_flag as flag, min(seq) as start_seq, max(seq) as end_seq, min(p) as start_pos,
  count(*) as length
from p group by battery_id, over_temp_flag, p - pf"""


@register("regime_runs", REGIME_SQL)
def q_regime_runs(spark, sf_dir):
    return pr.regime_runs(telemetry(spark, sf_dir), "over_temp_flag")


def _bin_cte(k):
    return f""", mm as (select cast(min(SOC) as double) as mn, cast(max(SOC) as double) as mx from telemetry)
, b as (select t.*, case when mx > mn then greatest(0, cast(ceil((SOC - mn) / nullif((mx - mn) / {k}e0, 0)) - 1 as integer)) when mx = mn and SOC is not null then {(k + 1) // 2 - 1} end as soc_bin
  from telemetry t cross join mm)"""


@register("soc_bin", _bin_cte(20) + "\nselect battery_id, seq, SOC, soc_bin from b", doubles=["SOC"])
def q_soc_bin(spark, sf_dir):
    return soc.soc_bin(telemetry(spark, sf_dir), 20).select(*KEYS, "SOC", "soc_bin")


@register("ir_by_soc", _bin_cte(20) + """
select soc_bin, avg(internal_resistance) as ir_mean, stddev_samp(internal_resistance) as ir_std,
  count(internal_resistance) as ir_count
from b where soc_bin is not null group by soc_bin""", doubles=["ir_mean", "ir_std"])
def q_ir_by_soc(spark, sf_dir):
    return soc.ir_by_soc(telemetry(spark, sf_dir))


@register("soc_profile", _bin_cte(10) + "\nselect soc_bin, " + ", ".join(f"avg({c}) as {c}" for c in soc.PROFILE_COLS)
          + " from b where soc_bin is not null group by soc_bin", doubles=soc.PROFILE_COLS)
def q_soc_profile(spark, sf_dir):
    return soc.soc_profile(telemetry(spark, sf_dir))


@register("feature_ranges", _union([
    f"select '{c}' as feature, cast(min({c}) as double) as min, cast(max({c}) as double) as max, avg({c}) as mean "
    f"from telemetry" for c in soc.RANGE_COLS]), doubles=["min", "max", "mean"])
def q_feature_ranges(spark, sf_dir):
    return soc.feature_ranges(telemetry(spark, sf_dir))


@register("feature_limits", _union([
    (f"select {i} as position, '{c}' as feature, cast(min({c}) as double) as lo, cast(max({c}) as double) as hi "
     f"from telemetry") if c in RAW_FEATURES else
    f"select {i} as position, '{c}' as feature, 0e0 as lo, 1e0 as hi"
    for i, c in enumerate(SELECTED_FEATURES)]), doubles=["lo", "hi"])
def q_feature_limits(spark, sf_dir):
    return soc.feature_limits(telemetry(spark, sf_dir), SELECTED_FEATURES)

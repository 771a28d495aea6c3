"""Registered queries: feature engineering and preprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellscope.operators import features as fe
from cellscope.operators import prep, project
from cellscope.operators import splits as sp
from cellscope.plans.registry import register
from cellscope.plans.split_queries import SPLIT_CTE
from cellscope.sources.telemetry import RAW_FEATURES, telemetry

KEYS = ["battery_id", "seq"]
RAW_NO_TEMP = [c for c in RAW_FEATURES if c != "battery_temp"]
ENG_COLS = RAW_NO_TEMP + fe.ENGINEERED

ENGINEERED_CTE = SPLIT_CTE + """
, b as (select arg_min(internal_resistance, seq) as baseline_ir from sp where split = 'train')
, r0 as (
  select sp.*, case when count(SOC) over w = 10 then max(SOC) over w - min(SOC) over w end as rr
  from sp window w as (partition by battery_id, split order by seq rows between 9 preceding and current row))
, m as (select split, quantile_cont(rr, 0.5) as med from r0 group by split)
, e as (
  select r0.battery_id, r0.seq, r0.split, """ + ", ".join(f"r0.{c}" for c in RAW_NO_TEMP) + """,
    r0.over_temp_flag, r0.over_voltage_flag, r0.cycle_degradation,
    internal_resistance - baseline_ir as delta_internal_resistance,
    coalesce(rr, med) as soc_range_rolling,
    dT_dt * battery_temp as thermal_acceleration,
    action_voltage / (terminal_voltage + 1e-6) as voltage_efficiency,
    internal_resistance * internal_resistance as internal_resistance_sq,
    thermal_stress_index * thermal_stress_index as thermal_stress_index_sq,
    aging_indicator * aging_indicator as aging_indicator_sq
  from r0 join m on r0.split = m.split cross join b)"""


def split_frame(spark, sf_dir):
    return sp.chrono_split(telemetry(spark, sf_dir))


def engineered(spark, sf_dir):
    s = split_frame(spark, sf_dir)
    return prep.engineer(s, fe.ir_baseline(s))


@register("ir_baseline", SPLIT_CTE + """
select arg_min(internal_resistance, seq) as baseline_ir from sp where split = 'train'""", doubles=["baseline_ir"])
def q_ir_baseline(spark, sf_dir):
    return fe.ir_baseline(split_frame(spark, sf_dir))


@register("delta_ir", ENGINEERED_CTE + "\nselect battery_id, seq, delta_internal_resistance from e",
          doubles=["delta_internal_resistance"])
def q_delta_ir(spark, sf_dir):
    s = split_frame(spark, sf_dir)
    return fe.delta_ir(s, fe.ir_baseline(s)).select(*KEYS, "delta_internal_resistance")


@register("soc_range_rolling", ENGINEERED_CTE + "\nselect battery_id, seq, split, soc_range_rolling from e",
          doubles=["soc_range_rolling"])
def q_soc_range_rolling(spark, sf_dir):
    return fe.soc_range_rolling(split_frame(spark, sf_dir)).select(*KEYS, "split", "soc_range_rolling")


@register("thermal_accel", "select battery_id, seq, dT_dt * battery_temp as thermal_acceleration from telemetry",
          doubles=["thermal_acceleration"])
def q_thermal_accel(spark, sf_dir):
    return fe.thermal_accel(telemetry(spark, sf_dir)).select(*KEYS, "thermal_acceleration")


@register("voltage_eff", """select battery_id, seq, action_voltage / (terminal_voltage + 1e-6) as voltage_efficiency
from telemetry""", doubles=["voltage_efficiency"])
def q_voltage_eff(spark, sf_dir):
    return fe.voltage_eff(telemetry(spark, sf_dir)).select(*KEYS, "voltage_efficiency")


SQ = ["internal_resistance_sq", "thermal_stress_index_sq", "aging_indicator_sq"]


@register("poly_sq", """select battery_id, seq, internal_resistance * internal_resistance as internal_resistance_sq,
  thermal_stress_index * thermal_stress_index as thermal_stress_index_sq,
  aging_indicator * aging_indicator as aging_indicator_sq from telemetry""", doubles=SQ)
def q_poly_sq(spark, sf_dir):
    return fe.poly_sq(telemetry(spark, sf_dir)).select(*KEYS, *SQ)


@register("engineer_all", ENGINEERED_CTE + "\nselect battery_id, seq, " + ", ".join(ENG_COLS) + " from e",
          doubles=ENG_COLS)
def q_engineer_all(spark, sf_dir):
    return engineered(spark, sf_dir).select(*KEYS, *ENG_COLS)


@register("select_features", ENGINEERED_CTE + "\nselect battery_id, seq, " + ", ".join(project.SELECTED_FEATURES)
          + " from e", doubles=project.SELECTED_FEATURES)
def q_select_features(spark, sf_dir):
    return project.select_features(engineered(spark, sf_dir), project.SELECTED_FEATURES, KEYS)


NO_LEAK = project.exclude_target(project.SELECTED_FEATURES, "internal_resistance")


@register("exclude_target", ENGINEERED_CTE + "\nselect battery_id, seq, " + ", ".join(NO_LEAK) + " from e",
          doubles=NO_LEAK)
def q_exclude_target(spark, sf_dir):
    return project.select_features(engineered(spark, sf_dir), NO_LEAK, KEYS)


def _union(parts):
    return "\nunion all\n".join(parts)


TRAIN_E = ENGINEERED_CTE.replace("from sp window w", "from sp where split = 'train' window w")
PREP_FIT_CTE = TRAIN_E + """
, med as (""" + _union([f"select '{c}' as feature, quantile_cont({c}, 0.5) as median from e" for c in ENG_COLS]) + """)
, wm as (select """ + ", ".join(f"max(case when feature = '{c}' then median end) as m_{c}" for c in ENG_COLS) + """ from med)
, imp as (select """ + ", ".join(f"coalesce({c}, m_{c}) as {c}" for c in ENG_COLS) + """ from e cross join wm)
, st as (""" + _union([f"select '{c}' as feature, avg({c}) as mean, stddev_pop({c}) as std from imp" for c in ENG_COLS]) + """)
, params as (select feature, median, mean, std from med join st using (feature))"""


def _prep_params(spark, sf_dir):
    s = split_frame(spark, sf_dir)
    return s, prep.prep_fit(s)


@register("prep_fit", PREP_FIT_CTE + "\nselect * from params", doubles=["median", "mean", "std"])
def q_prep_fit(spark, sf_dir):
    _, p = _prep_params(spark, sf_dir)
    return p.medians.join(p.stats, "feature").select("feature", "median", "mean", "std")


# transform: the whole table (all splits) engineered with the train baseline, imputed and
# scaled with train parameters, then the 15 selected features.
PREP_TRANSFORM_SQL = PREP_FIT_CTE + """
, e_all as (
  select r0.battery_id, r0.seq, """ + ", ".join(f"r0.{c}" for c in RAW_NO_TEMP) + """,
    internal_resistance - baseline_ir as delta_internal_resistance,
    coalesce(rr, med) as soc_range_rolling,
    dT_dt * battery_temp as thermal_acceleration,
    action_voltage / (terminal_voltage + 1e-6) as voltage_efficiency,
    internal_resistance * internal_resistance as internal_resistance_sq,
    thermal_stress_index * thermal_stress_index as thermal_stress_index_sq,
    aging_indicator * aging_indicator as aging_indicator_sq
  from r_all r0 join m_all m on r0.split = m.split cross join b)
, ws as (select """ + ", ".join(f"max(case when feature = '{c}' then mean end) as a_{c}, "
                                f"max(case when feature = '{c}' then std end) as s_{c}" for c in ENG_COLS) + """ from params)
select battery_id, seq, """ + ", ".join(
    f"(coalesce({c}, m_{c}) - a_{c}) / coalesce(nullif(s_{c}, 0), 1e0) as {c}" for c in project.SELECTED_FEATURES) + """
from e_all cross join wm cross join ws"""
PREP_TRANSFORM_SQL = PREP_TRANSFORM_SQL.replace(
    "\n, e_all as (", """
, r_all as (
  select sp.*, case when count(SOC) over w = 10 then max(SOC) over w - min(SOC) over w end as rr
  from sp window w as (partition by battery_id, split order by seq rows between 9 preceding and current row))
, m_all as (select split, quantile_cont(rr, 0.5) as med from r_all group by split)
, e_all as (""", 1)


@register("prep_transform", PREP_TRANSFORM_SQL, doubles=project.SELECTED_FEATURES)
def q_prep_transform(spark, sf_dir):
    s = split_frame(spark, sf_dir)
    _, x = prep.prep_fit_transform(s, project.SELECTED_FEATURES)
    return x.select(*KEYS, *project.SELECTED_FEATURES)

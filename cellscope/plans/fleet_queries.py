"""Registered queries: scoring rules and fleet insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellscope.functions.exprs import over_voltage, temp_flag
from cellscope.operators import fleet as fl
from cellscope.plans.registry import register
from cellscope.sources.telemetry import scores_view, telemetry

KEYS = ["battery_id", "seq"]

# SQL fragments shared by the oracles below.
FLEET_CTE = """, f as (
  select avg(internal_resistance) as ir_mean, stddev_samp(internal_resistance) as ir_std,
    min(internal_resistance) as ir_min, max(internal_resistance) as ir_max,
    avg(battery_temp) as temp_mean,
    sum(over_temp_flag) / count(*) * 100 as over_temp_rate,
    sum(over_voltage_flag) / count(*) * 100 as over_voltage_rate,
    avg(charging_efficiency) as avg_charging_efficiency,
    count(*) as total_rows, count(distinct battery_id) as n_batteries
  from telemetry)"""

READINGS_CTE = """, r as (
  select t.*, case when coalesce(action_voltage > 4.15e0 or terminal_voltage > 4.18e0, false)
    then 1 else 0 end as pred_over_voltage_flag
  from telemetry t)"""

HEALTH_CTE = FLEET_CTE + READINGS_CTE + """, h0 as (
  select r.*, f.*,
    greatest(0e0, 100e0 - (internal_resistance - ir_min) / (ir_max - ir_min) * 100) as ir_health,
    case when over_temp_flag = 0 then 100e0 else 40e0 end as thermal_health,
    case when pred_over_voltage_flag = 0 then 100e0 else 40e0 end as voltage_health
  from r cross join f)
, h as (
  select h0.*, (ir_health * 0.4e0 + thermal_health * 0.35e0 + voltage_health * 0.25e0) / 1e0 as health_score
  from h0)
, hs as (
  select h.*, case when health_score >= 80 then 'HEALTHY' when health_score >= 60 then 'DEGRADING'
    when health_score >= 40 then 'CRITICAL' else 'END_OF_LIFE' end as status
  from h)"""


def readings(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return t.withColumn("pred_over_voltage_flag", over_voltage())


def assessed(spark, sf_dir):
    """Readings with fleet-relative health (measured IR, over-temp flag, voltage rule)."""
    t = telemetry(spark, sf_dir)
    fleet = fl.fleet_stats(t, batteries=False)
    r = t.withColumn("pred_over_voltage_flag", over_voltage())
    h = fl.health(r, fleet, volt_flag_col="pred_over_voltage_flag", keep_fleet=True)
    return fl.alerts(h, fleet, volt_flag_col="pred_over_voltage_flag", keep_fleet=True), fleet


@register("over_voltage_rule", """select battery_id, seq, action_voltage, terminal_voltage,
  case when coalesce(action_voltage > 4.15e0 or terminal_voltage > 4.18e0, false) then 1 else 0 end
    as pred_over_voltage_flag
from telemetry""", doubles=["action_voltage", "terminal_voltage"])
def q_over_voltage_rule(spark, sf_dir):
    return readings(spark, sf_dir).select(*KEYS, "action_voltage", "terminal_voltage", "pred_over_voltage_flag")


@register("temp_threshold", """select battery_id, seq, prob,
  case when prob >= 0.2e0 then 1 else 0 end as pred_over_temp_flag
from scores""", views=("scores",), doubles=["prob"])
def q_temp_threshold(spark, sf_dir):
    s = scores_view(spark, sf_dir)
    return s.select(*KEYS, "prob", temp_flag("prob", 0.2).alias("pred_over_temp_flag"))


@register("fleet_stats", FLEET_CTE + "\nselect * from f",
          doubles=["ir_mean", "ir_std", "ir_min", "ir_max", "temp_mean", "over_temp_rate",
                   "over_voltage_rate", "avg_charging_efficiency"])
def q_fleet_stats(spark, sf_dir):
    return fl.fleet_stats(telemetry(spark, sf_dir))


@register("health_components", HEALTH_CTE + """
select battery_id, seq, ir_health, thermal_health, voltage_health from hs""",
          doubles=["ir_health", "thermal_health", "voltage_health"])
def q_health_components(spark, sf_dir):
    h, _ = assessed(spark, sf_dir)
    return h.select(*KEYS, "ir_health", "thermal_health", "voltage_health")  # _fleet dropped by select


@register("health_score", HEALTH_CTE + "\nselect battery_id, seq, health_score from hs",
          doubles=["health_score"])
def q_health_score(spark, sf_dir):
    h, _ = assessed(spark, sf_dir)
    return h.select(*KEYS, "health_score")


@register("health_status", HEALTH_CTE + """
select battery_id, seq, health_score, status,
  (case when internal_resistance > ir_mean + ir_std then 1 else 0 end
   + over_temp_flag + pred_over_voltage_flag) as n_alerts
from hs""", doubles=["health_score"])
def q_health_status(spark, sf_dir):
    h, _ = assessed(spark, sf_dir)
    return h.select(*KEYS, "health_score", "status", F.size("alerts").alias("n_alerts"))


def quoted(text: str) -> str:
    """A fixed text of ``operators/fleet.py`` as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def quoted_list(texts: list[str]) -> str:
    return "[" + ", ".join(quoted(t) for t in texts) + "]"


ALERTS_SQL = HEALTH_CTE + f"""
, a as (
  select battery_id, seq, internal_resistance, (internal_resistance / ir_mean - 1) * 100 as pct,
    case when internal_resistance > ir_mean + 2 * ir_std then 2
         when internal_resistance > ir_mean + ir_std then 1 else 0 end as ir_level,
    over_temp_flag, pred_over_voltage_flag
  from hs)
select battery_id, seq, cast(0 as bigint) as alert_idx,
  case when ir_level = 2 then {quoted(fl.ALERT_HIGH_DEGRADATION[0])} else {quoted(fl.ALERT_DEGRADATION_WARNING[0])} end as alert_type,
  case when ir_level = 2 then {quoted(fl.ALERT_HIGH_DEGRADATION[1])} else {quoted(fl.ALERT_DEGRADATION_WARNING[1])} end as severity,
  case when ir_level = 2 then printf({quoted(fl.ALERT_HIGH_DEGRADATION[2])}, pct)
       else printf({quoted(fl.ALERT_DEGRADATION_WARNING[2])}, pct) end as message,
  internal_resistance as value_num
from a where ir_level > 0
union all
select battery_id, seq, cast(case when ir_level > 0 then 1 else 0 end as bigint), {quoted(fl.ALERT_OVER_TEMP[0])}, {quoted(fl.ALERT_OVER_TEMP[1])},
  {quoted(fl.ALERT_OVER_TEMP[2])}, null
from a where over_temp_flag = 1
union all
select battery_id, seq, cast((case when ir_level > 0 then 1 else 0 end) + over_temp_flag as bigint),
  {quoted(fl.ALERT_OVER_VOLTAGE[0])}, {quoted(fl.ALERT_OVER_VOLTAGE[1])}, {quoted(fl.ALERT_OVER_VOLTAGE[2])}, null
from a where pred_over_voltage_flag = 1"""


@register("alerts", ALERTS_SQL, doubles=["value_num"])
def q_alerts(spark, sf_dir):
    h, _ = assessed(spark, sf_dir)
    return fl.alert_table(h).withColumn("alert_idx", F.col("alert_idx").cast("long"))


RUL_HIST_SQL = """, p as (
  select battery_id, internal_resistance as ir,
    row_number() over (partition by battery_id order by seq) - 1 as pos
  from telemetry)
, per as (
  select battery_id, count(ir) as history_len, regr_slope(ir, pos) as slope, arg_max(ir, pos) as current_ir
  from p group by battery_id)
, g as (select stddev_samp(internal_resistance) as ir_std, count(*) as total_rows from telemetry)
, x as (
  select battery_id, history_len, current_ir, 0.15e0 as ir_threshold, greatest(0e0, 0.15e0 - current_ir) as ir_remaining,
    case when history_len > 2 then slope else ir_std / total_rows end as degradation_rate,
    case when history_len > 2 then 'Ω per cycle' else 'Ω per cycle (fleet avg)' end as degradation_rate_unit,
    case when history_len > 2 then 'history' else 'fleet' end as rate_source
  from per cross join g)
select x.*,
  case when degradation_rate > 0 then greatest(0, cast(trunc(ir_remaining / degradation_rate) as bigint)) end
    as cycles_remaining,
  case when degradation_rate > 0 then greatest(0, cast(trunc(ir_remaining / degradation_rate * 0.7e0) as bigint)) end
    as cycles_remaining_conservative
from x"""


@register("rul_history", RUL_HIST_SQL, doubles=["current_ir", "ir_threshold", "ir_remaining"],
          special={"degradation_rate": 12})
def q_rul_history(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return fl.rul_history(t, fl.fleet_stats(t))


RUL_LAST_N = 20


@register("rul_history_last_n", RUL_HIST_SQL.replace("from p group by battery_id", f"""from (
    select p.*, count(*) over (partition by battery_id) as n from p) l where pos >= n - {RUL_LAST_N} group by battery_id"""),
          doubles=["current_ir", "ir_threshold", "ir_remaining"], special={"degradation_rate": 12})
def q_rul_history_last_n(spark, sf_dir):
    """The trend of each battery's last readings only."""
    t = telemetry(spark, sf_dir)
    return fl.rul_history(t, fl.fleet_stats(t), last_n=RUL_LAST_N)


RUL_FLEET_SQL = FLEET_CTE + """
, x as (
  select battery_id, seq, 0.15e0 as ir_threshold, greatest(0e0, 0.15e0 - internal_resistance) as ir_remaining,
    ir_std / total_rows as degradation_rate, 'Ω per cycle (fleet avg)' as degradation_rate_unit
  from telemetry cross join f)
select x.*,
  case when degradation_rate > 0 then greatest(0, cast(trunc(ir_remaining / degradation_rate) as bigint)) end
    as cycles_remaining,
  case when degradation_rate > 0 then greatest(0, cast(trunc(ir_remaining / degradation_rate * 0.7e0) as bigint)) end
    as cycles_remaining_conservative
from x"""


@register("rul_fleet", RUL_FLEET_SQL, doubles=["ir_threshold", "ir_remaining"], special={"degradation_rate": 12})
def q_rul_fleet(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    r = fl.rul_fleet(t, fl.fleet_stats(t, batteries=False))
    return r.select(*KEYS, "ir_threshold", "ir_remaining", "degradation_rate", "degradation_rate_unit", "cycles_remaining",
                    "cycles_remaining_conservative")


COMPARE_SQL = FLEET_CTE + """
, s as (
  select t.*, (seq * 37 % 1000) * 0.0007e0 + over_temp_flag * 0.3e0 as prob from telemetry t)
select battery_id, seq, ir_mean as fleet_ir_average, ir_std as fleet_ir_std,
  avg_charging_efficiency as fleet_efficiency_average, over_temp_rate as fleet_over_temp_rate,
  (internal_resistance - ir_min) / (ir_max - ir_min) * 100 as ir_position_pct,
  case when internal_resistance < ir_mean then 'BETTER' else 'WORSE' end as ir_status,
  (internal_resistance - ir_mean) / ir_std as ir_deviation_sigmas,
  charging_efficiency / avg_charging_efficiency * 100 as efficiency_pct_of_mean,
  case when charging_efficiency > avg_charging_efficiency then 'ABOVE_AVERAGE' else 'BELOW_AVERAGE' end
    as efficiency_status,
  prob * 100 as over_temp_prob_pct,
  case when prob * 100 > over_temp_rate then 'HIGH' else 'LOW' end as risk_level
from s cross join f"""


@register("fleet_compare", COMPARE_SQL,
          doubles=["fleet_ir_average", "fleet_ir_std", "fleet_efficiency_average", "fleet_over_temp_rate", "ir_position_pct",
                   "ir_deviation_sigmas", "efficiency_pct_of_mean", "over_temp_prob_pct"])
def q_fleet_compare(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    s = t.withColumn("prob", ((F.col("seq") * 37) % 1000) * F.lit(0.0007) + F.col("over_temp_flag") * F.lit(0.3))
    c = fl.fleet_compare(s, fl.fleet_stats(t, batteries=False))
    return c.select(*KEYS, "fleet_ir_average", "fleet_ir_std", "fleet_efficiency_average", "fleet_over_temp_rate", "ir_position_pct", "ir_status", "ir_deviation_sigmas", "efficiency_pct_of_mean",
                    "efficiency_status", "over_temp_prob_pct", "risk_level")


@register("fleet_percentile", """select battery_id, seq,
  cume_dist() over (order by internal_resistance) * 100 as ir_percentile_rank
from telemetry""", doubles=["ir_percentile_rank"])
def q_fleet_percentile(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return fl.fleet_percentile(t.select(*KEYS, "internal_resistance")).select(*KEYS, "ir_percentile_rank")


RECS_SQL = HEALTH_CTE + f"""
, x as (
  select battery_id, seq, health_score,
    (internal_resistance > ir_mean + 2 * ir_std) or over_temp_flag = 1 or pred_over_voltage_flag = 1 as any_critical,
    case when ir_std / total_rows > 0
      then greatest(0, cast(trunc(greatest(0e0, 0.15e0 - internal_resistance) / (ir_std / total_rows) * 0.7e0) as bigint))
    end as cyc
  from hs)
, y as (
  select battery_id, seq, list_concat(
    case when health_score >= 80 then {quoted_list(fl.REC_HEALTHY)} when health_score >= 60 then {quoted_list(fl.REC_DEGRADING)}
         when health_score >= 40 then {quoted_list(fl.REC_CRITICAL)} else {quoted_list(fl.REC_END_OF_LIFE)} end,
    list_filter([
      case when cyc < 10 then printf({quoted(fl.REC_RUL_IMMINENT)}, cyc)
           when cyc < 50 then printf({quoted(fl.REC_RUL_SOON)}, cyc)
           when cyc is not null then printf({quoted(fl.REC_RUL_MONITOR)}, cyc) end,
      case when any_critical then {quoted(fl.REC_CRITICAL_ALERTS)} end], lambda v: v is not null)) as recs
  from x)
select battery_id, seq, unnest(range(0, len(recs))) as rec_idx, unnest(recs) as recommendation from y"""


@register("recommendations", RECS_SQL)
def q_recommendations(spark, sf_dir):
    h, fleet = assessed(spark, sf_dir)
    r = fl.rul_fleet(h, fleet)  # reuses the attached fleet row
    rec = fl.recommendations(r)
    return rec.select(*KEYS, F.posexplode("recommendations").alias("rec_idx", "recommendation")) \
        .withColumn("rec_idx", F.col("rec_idx").cast("long"))


@register("fleet_summary", FLEET_CTE + """
select total_rows, n_batteries, ir_mean as avg_ir, ir_min, ir_max,
  printf('%.1f%%', over_temp_rate) as over_temp_occurrence_rate,
  printf('%.1f%%', over_voltage_rate) as over_voltage_occurrence_rate,
  printf('%.1f%%', avg_charging_efficiency * 100) as avg_efficiency
from f""", doubles=["avg_ir", "ir_min", "ir_max"])
def q_fleet_summary(spark, sf_dir):
    return fl.fleet_summary(fl.fleet_stats(telemetry(spark, sf_dir)))


@register("ir_ratio_check", """select battery_id, seq,
  case when y > 0 then yhat / y else 1e0 end as ir_ratio,
  case when (case when y > 0 then yhat / y else 1e0 end) > 1.15e0 then 'AGING'
       when (case when y > 0 then yhat / y else 1e0 end) < 0.85e0 then 'RECHECK' else 'ALIGNED' end
    as ir_interpretation
from scores""", views=("scores",), doubles=["ir_ratio"])
def q_ir_ratio_check(spark, sf_dir):
    s = scores_view(spark, sf_dir)
    return fl.ir_ratio_check(s, "yhat", "y").select(*KEYS, "ir_ratio", "ir_interpretation")

"""SQL text of the test views (FIXTURES.md section 2), runnable unchanged by Spark SQL and
DuckDB over the base tables, and the helper that prefixes them to an oracle query."""

TELEMETRY_SQL = """select user_id as battery_id, event_id as seq,
  cast(regexp_extract(props, '[0-9]+', 0) as int) * 1e0 as SOC,
  0.86e0 + (event_id % 13) * 0.01e0 as SOH,
  2.8e0 + (event_id * 7 % 101) * 0.014e0 as terminal_voltage,
  5e0 + event_id % 29 as battery_current,
  30e0 + event_id % 1100 as battery_temp,
  10e0 + user_id % 30 as ambient_temp,
  0.019e0 + value * 0.00026e0 as internal_resistance,
  4e0 + event_id * 3 % 30 as action_current,
  2.8e0 + (event_id * 11 % 97) * 0.0145e0 as action_voltage,
  0.03e0 + (event_id % 204) * 0.01e0 as dT_dt,
  (event_id * 5 % 79) * 0.001e0 - 0.046e0 as dV_dt,
  0.012e0 + (event_id % 71) * 0.001e0 as soc_delta,
  least((30e0 + event_id % 1100) / 1129e0, 1e0) as thermal_stress_index,
  0.14e0 - (event_id % 13) * 0.01e0 as aging_indicator,
  0.811e0 + (event_id % 88) * 0.001e0 as charging_efficiency,
  1848e0 + event_id * 17 % 2300 as charging_time,
  0.0001e0 + (event_id * 19 % 91) * 0.00001e0 as cycle_degradation,
  case when event_type = 'error' then 1 else 0 end as over_temp_flag,
  case when event_id % 150 = 0 then 1 else 0 end as over_voltage_flag,
  2.35e0 + (event_id % 37) * 1e0 as balancing_time
from events"""

SCORES_SQL = """select battery_id, seq, over_temp_flag as label,
  (seq * 37 % 1000) * 0.0007e0 + over_temp_flag * 0.3e0 as prob,
  internal_resistance as y,
  internal_resistance + (seq % 21 - 10) * 0.0001e0 as yhat
from telemetry"""

DIRTY_SQL = """select * from (
  select battery_id, seq,
    case when seq % 17 = 0 then null else SOC end as SOC,
    case when seq % 23 = 0 then null else terminal_voltage end as terminal_voltage,
    action_voltage, internal_resistance, over_temp_flag
  from telemetry
  union all
  select battery_id, seq + 100000000 as seq,
    case when seq % 17 = 0 then null else SOC end as SOC,
    case when seq % 23 = 0 then null else terminal_voltage end as terminal_voltage,
    action_voltage, internal_resistance, over_temp_flag
  from telemetry where seq % 50 = 0
) d"""

# Holes where keys, flags and scores may be missing, a battery of a few rows, a constant column.
HOLES_SQL = """select
  case when seq % 11 = 0 then null when seq % 2003 = 7 then -5 else battery_id end as battery_id, seq,
  case when seq % 17 = 0 then null else SOC end as SOC,
  case when seq % 23 = 0 then null else terminal_voltage end as terminal_voltage,
  internal_resistance, battery_temp, 5e0 as flat, over_temp_flag as label,
  case when seq % 13 = 0 then null else over_temp_flag end as over_temp_flag,
  case when seq % 19 = 0 then null else (seq * 37 % 1000) * 0.0007e0 end as prob
from telemetry"""

VIEWS = {"telemetry": TELEMETRY_SQL, "scores": SCORES_SQL, "telemetry_dirty": DIRTY_SQL, "telemetry_holes": HOLES_SQL}
_DEPS = {"telemetry": [], "scores": ["telemetry"], "telemetry_dirty": ["telemetry"], "telemetry_holes": ["telemetry"]}


def with_views(body: str, views=("telemetry",)) -> str:
    """Prefix the needed views as CTEs. ``body`` is either a SELECT or starts with
    ``, name as (...)`` to add more CTEs."""
    need: list[str] = []
    for v in views:
        for d in _DEPS[v] + [v]:
            if d not in need:
                need.append(d)
    ctes = ",\n".join(f"{v} as (\n{VIEWS[v]}\n)" for v in need)
    body = body.strip()
    sep = "\n" if body.startswith(",") else "\n"
    return f"with {ctes}{sep}{body}"


def rounded(sql: str, cols: dict[str, int]) -> str:
    """Wrap ``sql`` so the listed double columns are rounded (digits per column)."""
    if not cols:
        return sql
    # + 0e0 turns a rounded -0.0 into 0.0 (DuckDB keeps the sign of tiny negatives)
    rep = ", ".join(f"round({c}, {d}) + 0e0 as {c}" for c, d in cols.items())
    return f"select * replace ({rep}) from (\n{sql}\n) q"

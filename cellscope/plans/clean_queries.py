"""Registered queries: cleaning, imputation, scaling, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellscope.operators import clean, project
from cellscope.operators import splits as sp
from cellscope.plans.registry import register
from cellscope.plans.split_queries import SPLIT_CTE
from cellscope.sources import files
from cellscope.sources.telemetry import RAW_FEATURES, TARGETS, scores_view, telemetry, telemetry_dirty

KEYS = ["battery_id", "seq"]
DIRTY_COLS = ["SOC", "terminal_voltage", "action_voltage", "internal_resistance"]
DIRTY_ALL = ["battery_id", "seq", "SOC", "terminal_voltage", "action_voltage", "internal_resistance",
             "over_temp_flag"]


def _union(parts):
    return "\nunion all\n".join(parts)


@register("null_audit", """, a as (
  select count(*) as n, """ + ", ".join(f"count_if({c} is null) as {c}__nulls" for c in DIRTY_ALL) + """
  from telemetry_dirty)
, l as (""" + _union([f"select '{c}' as column_name, {c}__nulls as null_count, n, "
                       + " + ".join(f"{d}__nulls" for d in DIRTY_ALL) + " as total_nulls from a"
                       for c in DIRTY_ALL]) + """)
select column_name, null_count, null_count / n * 100 as null_pct, total_nulls from l where null_count > 0""",
          views=("telemetry_dirty",), doubles=["null_pct"])
def q_null_audit(spark, sf_dir):
    return clean.null_audit(telemetry_dirty(spark, sf_dir))


@register("dup_count", """select cast(sum(c) as bigint) as n_rows, cast(sum(c - 1) as bigint) as n_duplicates from (
  select count(*) as c from telemetry_dirty group by """ + ", ".join(c for c in DIRTY_ALL if c != "seq") + ") g",
          views=("telemetry_dirty",))
def q_dup_count(spark, sf_dir):
    return clean.dup_count(telemetry_dirty(spark, sf_dir))


@register("dedup_first", "select " + ", ".join(c for c in DIRTY_ALL if c != "seq") + ", min(seq) as seq "
          "from telemetry_dirty group by " + ", ".join(c for c in DIRTY_ALL if c != "seq"),
          views=("telemetry_dirty",), doubles=DIRTY_COLS)
def q_dedup_first(spark, sf_dir):
    return clean.dedup_first(telemetry_dirty(spark, sf_dir))


# copies go before the slice, so that none of them lies in another split than its original
DIRTY_SPLIT_CTE = SPLIT_CTE.replace("from telemetry t", """from (
    select battery_id, min(seq) as seq, SOC, terminal_voltage, action_voltage, internal_resistance, over_temp_flag
    from telemetry_dirty group by all) t""")
IMPUTE_FIT_SQL = DIRTY_SPLIT_CTE + """
, med as (""" + _union([f"select '{c}' as feature, quantile_cont({c}, 0.5) as median from sp where split = 'train'"
                        for c in DIRTY_COLS]) + ")"


def dirty_split(spark, sf_dir):
    return sp.chrono_split(clean.dedup_first(telemetry_dirty(spark, sf_dir)))


@register("impute_fit", IMPUTE_FIT_SQL + "\nselect * from med", views=("telemetry_dirty",), doubles=["median"])
def q_impute_fit(spark, sf_dir):
    s = dirty_split(spark, sf_dir)
    return clean.impute_fit(s.where(F.col("split") == "train"), DIRTY_COLS)


@register("impute_apply", IMPUTE_FIT_SQL + """
, w as (select """ + ", ".join(f"max(case when feature = '{c}' then median end) as m_{c}" for c in DIRTY_COLS)
          + """ from med)
select battery_id, seq, """ + ", ".join(f"coalesce({c}, m_{c}) as {c}" for c in DIRTY_COLS)
          + " from sp cross join w", views=("telemetry_dirty",), doubles=DIRTY_COLS)
def q_impute_apply(spark, sf_dir):
    s = dirty_split(spark, sf_dir)
    med = clean.impute_fit(s.where(F.col("split") == "train"), DIRTY_COLS)
    return clean.impute_apply(s.select(*KEYS, *DIRTY_COLS), med, DIRTY_COLS)


SCALE_FIT_SQL = SPLIT_CTE + """
, st as (""" + _union([f"select '{c}' as feature, avg({c}) as mean, stddev_pop({c}) as std from sp where split = 'train'"
                       for c in RAW_FEATURES]) + ")"
SCALED_CTE = SCALE_FIT_SQL + """
, w as (select """ + ", ".join(f"max(case when feature = '{c}' then mean end) as m_{c}, "
                               f"max(case when feature = '{c}' then std end) as s_{c}" for c in RAW_FEATURES) + """ from st)
, z as (select battery_id, seq, split, """ + ", ".join(
    f"({c} - m_{c}) / coalesce(nullif(s_{c}, 0), 1e0) as {c}" for c in RAW_FEATURES) + " from sp cross join w)"


def scaled(spark, sf_dir):
    s = sp.chrono_split(telemetry(spark, sf_dir))
    stats = clean.scale_fit(s.where(F.col("split") == "train"), RAW_FEATURES)
    return clean.scale_apply(s.select(*KEYS, "split", *RAW_FEATURES), stats, RAW_FEATURES), stats


@register("scale_fit", SCALE_FIT_SQL + "\nselect * from st", doubles=["mean", "std"])
def q_scale_fit(spark, sf_dir):
    return scaled(spark, sf_dir)[1]


@register("scale_apply", SCALED_CTE + "\nselect battery_id, seq, " + ", ".join(RAW_FEATURES) + " from z",
          doubles=RAW_FEATURES)
def q_scale_apply(spark, sf_dir):
    return scaled(spark, sf_dir)[0].drop("split")


@register("scale_check", SCALED_CTE + "\n" + _union(
    [f"select '{c}' as feature, avg({c}) as mean from z where split = 'train'" for c in RAW_FEATURES]),
    doubles=["mean"])
def q_scale_check(spark, sf_dir):
    z, _ = scaled(spark, sf_dir)
    return clean.scale_check(z.where(F.col("split") == "train"), RAW_FEATURES)


@register("log1p_target", """select battery_id, seq, ln(1 + internal_resistance) as log1p_internal_resistance
from telemetry""", doubles=["log1p_internal_resistance"])
def q_log1p_target(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return clean.log1p_target(t, "internal_resistance").select(*KEYS, "log1p_internal_resistance")


@register("expm1_inverse", """select battery_id, seq, exp(ln(1 + internal_resistance)) - 1 as internal_resistance_back
from telemetry""", doubles=["internal_resistance_back"])
def q_expm1_inverse(spark, sf_dir):
    t = clean.log1p_target(telemetry(spark, sf_dir), "internal_resistance", "lg")
    return clean.expm1_inverse(t, "lg", "internal_resistance_back").select(*KEYS, "internal_resistance_back")


RAW_SQL = ", ".join(RAW_FEATURES)


@register("drop_cols", "select battery_id, seq, " + RAW_SQL + ", " + ", ".join(TARGETS) + " from telemetry",
          doubles=RAW_FEATURES + ["cycle_degradation"])
def q_drop_cols(spark, sf_dir):
    # the reference drops its integer ``timestamp``; our order key is kept as metadata
    return project.drop_cols(telemetry(spark, sf_dir).withColumn("timestamp", F.col("seq")), ["timestamp"])


@register("drop_redundant", "select * exclude (battery_temp) from telemetry",
          doubles=[c for c in RAW_FEATURES if c != "battery_temp"] + ["cycle_degradation"])
def q_drop_redundant(spark, sf_dir):
    from cellscope.operators.features import drop_redundant
    return drop_redundant(telemetry(spark, sf_dir))


@register("feature_target_split", "select battery_id, seq, " + RAW_SQL + ", over_temp_flag as y from telemetry", doubles=RAW_FEATURES)
def q_feature_target_split(spark, sf_dir):
    """Both sides, put together by their keys again."""
    x, y = project.feature_target_split(telemetry(spark, sf_dir), "over_temp_flag")
    return x.join(y.withColumnRenamed("over_temp_flag", "y"), KEYS)


@register("default_fill", "select battery_id, seq, " + ", ".join(
    c if c not in ("dT_dt", "dV_dt", "soc_delta") else f"0e0 as {c}" for c in RAW_FEATURES) + " from telemetry",
    doubles=RAW_FEATURES)
def q_default_fill(spark, sf_dir):
    t = telemetry(spark, sf_dir).select(*KEYS, *[c for c in RAW_FEATURES if c not in ("dT_dt", "dV_dt", "soc_delta")])
    return files.default_fill(t).select(*KEYS, *RAW_FEATURES)


DERIVED = ["thermal_stress_index", "aging_indicator", "dT_dt", "dV_dt", "soc_delta", "balancing_time"]


@register("derive_indicators", """select battery_id, seq, SOC, SOH, battery_temp,
  least(battery_temp / 1129e0, 1e0) as thermal_stress_index, 1e0 - SOH as aging_indicator,
  0e0 as dT_dt, 0e0 as dV_dt, 0e0 as soc_delta, 15e0 as balancing_time
from telemetry""", doubles=["SOC", "SOH", "battery_temp"] + DERIVED)
def q_derive_indicators(spark, sf_dir):
    t = telemetry(spark, sf_dir).select(*KEYS, "SOC", "SOH", "battery_temp")
    return files.derive_indicators(t)


@register("pred_only", """select battery_id, seq, case when prob >= 0.2e0 then 1 else 0 end as pred_over_temp_flag,
  prob as pred_over_temp_prob, yhat as pred_internal_resistance from scores""", views=("scores",),
          doubles=["pred_over_temp_prob", "pred_internal_resistance"])
def q_pred_only(spark, sf_dir):
    s = scores_view(spark, sf_dir).select(
        *KEYS, "label", "y", F.when(F.col("prob") >= 0.2, 1).otherwise(0).alias("pred_over_temp_flag"),
        F.col("prob").alias("pred_over_temp_prob"), F.col("yhat").alias("pred_internal_resistance"))
    return project.pred_only(s, keys=KEYS)


@register("class_filter", "select battery_id, seq, internal_resistance from telemetry where over_temp_flag = 1",
          doubles=["internal_resistance"])
def q_class_filter(spark, sf_dir):
    return project.class_filter(telemetry(spark, sf_dir), "over_temp_flag", 1).select(*KEYS, "internal_resistance")


@register("preview", "select battery_id, seq, SOC, internal_resistance from telemetry order by seq limit 5",
          doubles=["SOC", "internal_resistance"])
def q_preview(spark, sf_dir):
    return files.preview(telemetry(spark, sf_dir), 5).select(*KEYS, "SOC", "internal_resistance")

"""Fleet insights: fleet statistics, health, alerts, remaining useful life, fleet
comparison, percentile rank, recommendations and summary.

Fleet statistics are one aggregation pass producing a one-row table; every per-reading
operator joins that row with a broadcast (its size is one row by construction).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscope.functions.exprs import (
    flag_health, health_status, ir_health, safe_div, weighted_health,
)
from cellscope.operators.ordering import attach_row, running_totals, with_position

FLEET_COLS = ["ir_mean", "ir_std", "ir_min", "ir_max", "temp_mean", "over_temp_rate",
              "over_voltage_rate", "avg_charging_efficiency", "total_rows", "n_batteries"]

# Alert texts and the RUL threshold of the reference.
ALERT_HIGH_DEGRADATION = ("HIGH_DEGRADATION", "CRITICAL",
                          "IR is %.1f%% above fleet average. Severe degradation detected.")
ALERT_DEGRADATION_WARNING = ("DEGRADATION_WARNING", "WARNING",
                             "IR is %.1f%% above fleet average. Monitor closely.")
ALERT_OVER_TEMP = ("OVER_TEMP", "CRITICAL",
                   "Battery temperature exceeds safe threshold. Risk of thermal damage.")
ALERT_OVER_VOLTAGE = ("OVER_VOLTAGE", "CRITICAL",
                      "Battery voltage exceeds safe threshold. Risk of cell damage.")
RUL_IR_THRESHOLD = 0.15
RUL_CONSERVATIVE_FACTOR = 0.7
RATE_UNIT = "Ω per cycle"
RATE_UNIT_FLEET = "Ω per cycle (fleet avg)"

# Recommendation texts of the reference, by health band, RUL band and alerts.
REC_HEALTHY = ["✅ Battery is in good condition. Continue normal operation with routine monitoring."]
REC_DEGRADING = ["⚠️ Battery shows signs of degradation. Increase monitoring frequency to weekly.",
                 "💡 Consider scheduling maintenance within the next 2-3 weeks."]
REC_CRITICAL = ["🔴 Battery is degrading rapidly. Daily monitoring required.",
                "⚡ Reduce charging power if possible to slow degradation.",
                "📞 Contact maintenance team for urgent assessment."]
REC_END_OF_LIFE = ["🚨 Battery has reached end-of-life. STOP charging immediately.",
                   "📞 Replace battery as soon as possible."]
REC_RUL_IMMINENT = "⏰ RUL estimate: %d cycles. Battery retirement imminent."
REC_RUL_SOON = "📊 RUL estimate: %d cycles. Plan replacement soon."
REC_RUL_MONITOR = "📈 RUL estimate: %d cycles. Monitor degradation trend."
REC_CRITICAL_ALERTS = "🚨 CRITICAL ALERTS ACTIVE: Take immediate action."

# Interpretation of predicted / measured IR (assessment form).
IR_RATIO_HIGH = 1.15
IR_RATIO_LOW = 0.85
IR_RATIO_TEXT = {
    "AGING": "Predicted IR is significantly higher than measured — potential rapid aging detected.",
    "RECHECK": "Predicted IR is lower than measured — measurement noise possible, recheck sensor.",
    "ALIGNED": "Predicted IR aligns with measurement — battery aging is within expected range.",
}


def fleet_stats(df: DataFrame, ir_col: str = "internal_resistance", batteries: bool = True) -> DataFrame:
    """One-row fleet baseline: IR mean / sample std / min / max, mean temperature, flag
    rates in %, mean charging efficiency, row count and (``batteries``) distinct batteries.
    Per-reading scoring does not need the distinct count, which costs an extra expand."""
    n = F.count(F.lit(1))
    nb = F.count_distinct("battery_id") if batteries else F.lit(None).cast("long")
    return df.agg(
        F.avg(ir_col).alias("ir_mean"),
        F.stddev_samp(ir_col).alias("ir_std"),
        F.min(ir_col).alias("ir_min"),
        F.max(ir_col).alias("ir_max"),
        F.avg("battery_temp").alias("temp_mean"),
        (F.sum("over_temp_flag") / n * 100).alias("over_temp_rate"),
        (F.sum("over_voltage_flag") / n * 100).alias("over_voltage_rate"),
        F.avg("charging_efficiency").alias("avg_charging_efficiency"),
        n.alias("total_rows"),
        nb.alias("n_batteries"),
    )


def with_fleet(df: DataFrame, fleet: DataFrame) -> DataFrame:
    """Attach the one-row fleet table to every row (scalar subquery, computed once). A frame
    that already carries it (``keep_fleet=True`` upstream) is used as is."""
    return df if "_fleet" in df.columns else attach_row(df, fleet, "_fleet")


def _drop_fleet(df: DataFrame, keep: bool = False) -> DataFrame:
    return df if keep else df.drop("_fleet")


def _f(c: str) -> Column:
    return F.col("_fleet")[c]


def health(df: DataFrame, fleet: DataFrame, ir_col: str = "internal_resistance",
           temp_flag_col: str = "over_temp_flag", volt_flag_col: str = "over_voltage_flag",
           keep_fleet: bool = False) -> DataFrame:
    """Adds ``ir_health``, ``thermal_health``, ``voltage_health``, ``component_scores``
    (array of (name, score, weight)), ``health_score`` and ``status``."""
    x = with_fleet(df, fleet)
    irh = ir_health(F.col(ir_col), _f("ir_min"), _f("ir_max"))
    th = flag_health(temp_flag_col)
    vh = flag_health(volt_flag_col)
    comps = F.array(
        F.struct(F.lit("IR Condition").alias("name"), irh.alias("score"), F.lit(0.4).alias("weight")),
        F.struct(F.lit("Thermal Safety").alias("name"), th.alias("score"), F.lit(0.35).alias("weight")),
        F.struct(F.lit("Voltage Safety").alias("name"), vh.alias("score"), F.lit(0.25).alias("weight")),
    )
    score = weighted_health(irh, th, vh)
    out = x.select("*", irh.alias("ir_health"), th.alias("thermal_health"), vh.alias("voltage_health"),
                   comps.alias("component_scores"), score.alias("health_score"))
    return _drop_fleet(out.withColumn("status", health_status("health_score")), keep_fleet)


def alerts(df: DataFrame, fleet: DataFrame, ir_col: str = "internal_resistance",
           temp_flag_col: str = "over_temp_flag", volt_flag_col: str = "over_voltage_flag",
           keep_fleet: bool = False) -> DataFrame:
    """Adds ``ir_pct_above_mean`` and ``alerts``: array<struct<type, severity, message,
    value, value_num>>. Thresholds are strict (``>``); ``value`` is the IR or ``ACTIVE``."""
    x = with_fleet(df, fleet)
    ir = F.col(ir_col)
    pct = (safe_div(ir, _f("ir_mean")) - 1) * 100

    def alert(spec, value_num: Column, value_txt: Column, fmt_arg: Column | None = None):
        typ, sev, msg = spec
        m = F.format_string(msg, fmt_arg) if fmt_arg is not None else F.lit(msg)
        return F.struct(F.lit(typ).alias("type"), F.lit(sev).alias("severity"), m.alias("message"),
                        value_txt.alias("value"), value_num.alias("value_num"))

    ir_alert = (F.when(ir > _f("ir_mean") + 2 * _f("ir_std"),
                       alert(ALERT_HIGH_DEGRADATION, ir, ir.cast("string"), pct))
                .when(ir > _f("ir_mean") + _f("ir_std"),
                      alert(ALERT_DEGRADATION_WARNING, ir, ir.cast("string"), pct)))
    none = F.lit(None).cast("double")
    t_alert = F.when(F.col(temp_flag_col) == 1, alert(ALERT_OVER_TEMP, none, F.lit("ACTIVE")))
    v_alert = F.when(F.col(volt_flag_col) == 1, alert(ALERT_OVER_VOLTAGE, none, F.lit("ACTIVE")))
    out = x.select("*", pct.alias("ir_pct_above_mean"),
                   F.array_compact(F.array(ir_alert, t_alert, v_alert)).alias("alerts"))
    return _drop_fleet(out, keep_fleet)


def alert_table(df: DataFrame, keys: list[str] = ("battery_id", "seq")) -> DataFrame:
    """One row per alert: keys, alert_idx, alert_type, severity, message, value_num."""
    return df.select(*keys, F.posexplode("alerts").alias("alert_idx", "a")).select(
        *keys, "alert_idx", F.col("a.type").alias("alert_type"), F.col("a.severity").alias("severity"),
        F.col("a.message").alias("message"), F.col("a.value_num").alias("value_num"))


def _cycles(remaining: Column, rate: Column, factor: float = 1.0) -> Column:
    """int(remaining / rate * factor) for rate > 0; NULL otherwise. remaining >= 0, so the
    cast truncates like Python's int(); try_cast keeps absurd rates from failing the job."""
    v = F.try_divide(remaining, rate) * F.lit(factor)
    return F.when(rate > 0, F.greatest(F.lit(0), v.try_cast("bigint")))


def rul_fleet(df: DataFrame, fleet: DataFrame, ir_col: str = "internal_resistance",
              threshold: float = RUL_IR_THRESHOLD, keep_fleet: bool = False) -> DataFrame:
    """RUL with no history: degradation rate = fleet IR std / fleet row count."""
    x = with_fleet(df, fleet)
    remaining = F.greatest(F.lit(0.0), F.lit(threshold) - F.col(ir_col))
    rate = _f("ir_std") / _f("total_rows")
    out = x.select("*", F.lit(float(threshold)).alias("ir_threshold"), remaining.alias("ir_remaining"),
                   rate.alias("degradation_rate"), F.lit(RATE_UNIT_FLEET).alias("degradation_rate_unit"),
                   F.lit("fleet").alias("rate_source"),
                   _cycles(remaining, rate).alias("cycles_remaining"),
                   _cycles(remaining, rate, RUL_CONSERVATIVE_FACTOR).alias("cycles_remaining_conservative"))
    return _drop_fleet(out, keep_fleet)


def rul_history(df: DataFrame, fleet: DataFrame, ir_col: str = "internal_resistance",
                by: str = "battery_id", order_col: str = "seq", last_n: int | None = None,
                threshold: float = RUL_IR_THRESHOLD, pos_col: str | None = None,
                count_col: str | None = None) -> DataFrame:
    """Per battery RUL from its own IR history (the last ``last_n`` readings, or all).

    With more than 2 points the rate is the least-squares slope of IR over the step index
    (``regr_slope``, equal to a degree-1 polyfit); a rising IR gives cycles =
    int(max(0, threshold - current) / slope) and a conservative int(0.7 x); a flat or falling
    IR gives NULL cycles. With 2 points or fewer the fleet rate (IR std / rows) is used.
    The slope is an aggregate (partial per task), so a hot battery never sits in one task.
    """
    if pos_col is None or count_col is None:
        df = with_position(df, order_col, [by], pos_col="_pos", count_col="_n")
        pos_col, count_col = "_pos", "_n"
    if last_n is not None:
        df = df.where(F.col(pos_col) >= F.col(count_col) - last_n)
    per = df.groupBy(by).agg(
        F.count(F.col(ir_col)).alias("history_len"),
        F.regr_slope(F.col(ir_col), F.col(pos_col).cast("double")).alias("_slope"),
        F.max_by(F.col(ir_col), F.col(pos_col)).alias("current_ir"),
    )
    x = with_fleet(per, fleet)
    remaining = F.greatest(F.lit(0.0), F.lit(threshold) - F.col("current_ir"))
    use_hist = F.col("history_len") > 2
    rate = F.when(use_hist, F.col("_slope")).otherwise(_f("ir_std") / _f("total_rows"))
    out = x.select(by, "history_len", "current_ir", F.lit(float(threshold)).alias("ir_threshold"),
                   remaining.alias("ir_remaining"), rate.alias("degradation_rate"),
                   F.when(use_hist, RATE_UNIT).otherwise(RATE_UNIT_FLEET).alias("degradation_rate_unit"),
                   F.when(use_hist, "history").otherwise("fleet").alias("rate_source"))
    return out.select("*", _cycles(F.col("ir_remaining"), F.col("degradation_rate")).alias("cycles_remaining"),
                      _cycles(F.col("ir_remaining"), F.col("degradation_rate"),
                              RUL_CONSERVATIVE_FACTOR).alias("cycles_remaining_conservative"))


def fleet_compare(df: DataFrame, fleet: DataFrame, ir_col: str = "internal_resistance",
                  eff_col: str = "charging_efficiency", prob_col: str = "prob", keep_fleet: bool = False) -> DataFrame:
    """Position against the fleet: IR min-max position (the reference calls it percentile),
    BETTER/WORSE vs the mean, deviation in sigmas; efficiency as % of the fleet mean,
    ABOVE/BELOW_AVERAGE; over-temperature risk HIGH when prob*100 > fleet rate. The fleet's own
    figures stand beside each comparison."""
    x = with_fleet(df, fleet)
    ir, eff, prob = F.col(ir_col), F.col(eff_col), F.col(prob_col)
    out = x.select(
        "*",
        _f("ir_mean").alias("fleet_ir_average"), _f("ir_std").alias("fleet_ir_std"),
        _f("avg_charging_efficiency").alias("fleet_efficiency_average"),
        _f("over_temp_rate").alias("fleet_over_temp_rate"),
        (safe_div(ir - _f("ir_min"), _f("ir_max") - _f("ir_min")) * 100).alias("ir_position_pct"),
        F.when(ir < _f("ir_mean"), "BETTER").otherwise("WORSE").alias("ir_status"),
        safe_div(ir - _f("ir_mean"), _f("ir_std")).alias("ir_deviation_sigmas"),
        (safe_div(eff, _f("avg_charging_efficiency")) * 100).alias("efficiency_pct_of_mean"),
        F.when(eff > _f("avg_charging_efficiency"), "ABOVE_AVERAGE").otherwise("BELOW_AVERAGE")
        .alias("efficiency_status"),
        (prob * 100).alias("over_temp_prob_pct"),
        F.when(prob * 100 > _f("over_temp_rate"), "HIGH").otherwise("LOW").alias("risk_level"),
    )
    return _drop_fleet(out, keep_fleet)


def fleet_percentile(df: DataFrame, ir_col: str = "internal_resistance",
                     fleet_df: DataFrame | None = None, by: list[str] = ()) -> DataFrame:
    """True percentile rank: 100 * share of fleet readings with IR <= this reading's IR
    (``cume_dist``). Distinct IR values are counted first, the running count comes from
    ``running_totals`` (no single-partition window), and the rank is joined back by value."""
    fleet_df = fleet_df if fleet_df is not None else df
    by = list(by)
    counts = fleet_df.where(F.col(ir_col).isNotNull()).groupBy(*by, ir_col).agg(F.count(F.lit(1)).alias("c"))
    cum = running_totals(counts, ir_col, by, {"c": "c"})
    rank = cum.select(*by, ir_col, (F.col("cum_c") / F.col("tot_c") * 100).alias("ir_percentile_rank"))
    return df.join(rank, on=[*by, ir_col], how="left")


def recommendations(df: DataFrame, score_col: str = "health_score",
                    cycles_col: str = "cycles_remaining_conservative",
                    alerts_col: str = "alerts") -> DataFrame:
    """Adds ``recommendations``: texts by health band, RUL band (conservative cycles) and a
    line when any CRITICAL alert is active."""
    s = F.col(score_col)

    def lits(xs):
        return F.array(*[F.lit(x) for x in xs])

    band = (F.when(s >= 80, lits(REC_HEALTHY)).when(s >= 60, lits(REC_DEGRADING))
            .when(s >= 40, lits(REC_CRITICAL)).otherwise(lits(REC_END_OF_LIFE)))
    c = F.col(cycles_col)
    rul = (F.when(c < 10, F.format_string(REC_RUL_IMMINENT, c))
           .when(c < 50, F.format_string(REC_RUL_SOON, c))
           .when(c.isNotNull(), F.format_string(REC_RUL_MONITOR, c)))
    crit = F.when(F.exists(alerts_col, lambda a: a["severity"] == "CRITICAL"), F.lit(REC_CRITICAL_ALERTS))
    return df.withColumn("recommendations", F.concat(band, F.array_compact(F.array(rul, crit))))


def fleet_summary(fleet: DataFrame) -> DataFrame:
    """Formatted fleet summary (one row). ``total_rows`` counts readings; ``n_batteries``
    counts distinct batteries."""
    return fleet.select(
        "total_rows", "n_batteries", F.col("ir_mean").alias("avg_ir"), "ir_min", "ir_max",
        F.format_string("%.1f%%", "over_temp_rate").alias("over_temp_occurrence_rate"),
        F.format_string("%.1f%%", "over_voltage_rate").alias("over_voltage_occurrence_rate"),
        F.format_string("%.1f%%", F.col("avg_charging_efficiency") * 100).alias("avg_efficiency"),
    )


def ir_ratio_check(df: DataFrame, pred_col: str = "pred_internal_resistance",
                   measured_col: str = "internal_resistance") -> DataFrame:
    """predicted / measured IR (1.0 when measured <= 0): > 1.15 AGING, < 0.85 RECHECK, else ALIGNED."""
    m = F.col(measured_col)
    ratio = F.when(m > 0, F.try_divide(F.col(pred_col), m)).otherwise(F.lit(1.0))
    label = (F.when(ratio > IR_RATIO_HIGH, "AGING").when(ratio < IR_RATIO_LOW, "RECHECK")
             .otherwise("ALIGNED"))
    text = F.create_map(*[x for k, v in IR_RATIO_TEXT.items() for x in (F.lit(k), F.lit(v))])
    return df.select("*", ratio.alias("ir_ratio"), label.alias("ir_interpretation")) \
        .withColumn("ir_interpretation_text", text[F.col("ir_interpretation")])

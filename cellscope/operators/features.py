"""Feature engineering. Engineering runs per split after slicing, so the rolling window
restarts at every (battery, split) boundary and its fill median is that split's median."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscope.operators.ordering import (
    DEFAULT_CHUNK_ROWS, attach_row, exact_quantiles, join_null_safe, rolling_frame, with_position,
)

# Engineering constants of the reference.
SOC_WINDOW = 10
VOLTAGE_EPS = 1e-6
SQUARED_DEFAULT = ["internal_resistance", "thermal_stress_index", "aging_indicator"]
REDUNDANT_DEFAULT = ["battery_temp"]
ENGINEERED = ["delta_internal_resistance", "soc_range_rolling", "thermal_acceleration",
              "voltage_efficiency", "internal_resistance_sq", "thermal_stress_index_sq",
              "aging_indicator_sq"]


def ir_baseline(df: DataFrame, split_col: str = "split", order_col: str = "seq",
                per: Sequence[str] = ()) -> DataFrame:
    """IR of the first training row (``min_by``; partial aggregation). ``per`` = ("battery_id",)
    gives one baseline per battery."""
    t = df.where(F.col(split_col) == "train")
    return t.groupBy(*per).agg(F.min_by("internal_resistance", order_col).alias("baseline_ir"))


def delta_ir(df: DataFrame, baseline: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """IR minus the training baseline (always the train baseline, also at inference)."""
    if per:
        x = join_null_safe(df, baseline, list(per), "left")
    else:
        x = attach_row(df, baseline, "_base").withColumn("baseline_ir", F.col("_base.baseline_ir")).drop("_base")
    return x.withColumn("delta_internal_resistance", F.col("internal_resistance") - F.col("baseline_ir")) \
        .drop("baseline_ir")


def soc_range_rolling(df: DataFrame, window: int = SOC_WINDOW,
                      by: Sequence[str] = ("battery_id", "split"), order_col: str = "seq",
                      pos_col: str | None = "split_pos", fill_by: Sequence[str] = ("split",),
                      chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """max(SOC) - min(SOC) over the trailing ``window`` rows; NULL until the frame holds
    ``window`` non-NULL SOC values; then NULLs are filled with the median of the same frame
    (per ``fill_by`` group, i.e. per split)."""
    by = list(by)
    if pos_col is None or pos_col not in df.columns:
        df = with_position(df, order_col, by, pos_col="_rpos", count_col="_rn").drop("_rn")
        pos_col = "_rpos"

    def rng(w):
        return F.when(F.count("SOC").over(w) == window, F.max("SOC").over(w) - F.min("SOC").over(w))

    r = rolling_frame(df, {"_soc_rng": rng}, window, pos_col, by, chunk_rows)
    med = exact_quantiles(r, ["_soc_rng"], [0.5], by=list(fill_by)).select(*fill_by, F.col("value").alias("_med"))
    if not fill_by:
        out = attach_row(r, med, "_m").withColumn("_med", F.col("_m._med")).drop("_m")
    else:
        out = join_null_safe(r, med, list(fill_by), "left")
    out = out.withColumn("soc_range_rolling", F.coalesce("_soc_rng", "_med")).drop("_soc_rng", "_med")
    return out.drop("_rpos") if "_rpos" in out.columns else out


def thermal_accel(df: DataFrame) -> DataFrame:
    return df.withColumn("thermal_acceleration", F.col("dT_dt") * F.col("battery_temp"))


def voltage_eff(df: DataFrame) -> DataFrame:
    return df.withColumn("voltage_efficiency",
                         F.try_divide(F.col("action_voltage"), F.col("terminal_voltage") + F.lit(VOLTAGE_EPS)))


def poly_sq(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = [c for c in (cols or SQUARED_DEFAULT) if c in df.columns]
    return df.select("*", *[(F.col(c) * F.col(c)).alias(f"{c}_sq") for c in cols])


def drop_redundant(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.drop(*[c for c in (cols or REDUNDANT_DEFAULT) if c in df.columns])


def engineer_all(df: DataFrame, baseline: DataFrame, drop: Sequence[str] | None = None,
                 chunk_rows: int = DEFAULT_CHUNK_ROWS, per: Sequence[str] = ()) -> DataFrame:
    """delta IR -> rolling SOC range -> thermal acceleration -> voltage efficiency ->
    squares -> drop redundant, as one lazy plan (one shuffle for the rolling frame)."""
    x = delta_ir(df, baseline, per)
    x = soc_range_rolling(x, chunk_rows=chunk_rows)
    x = voltage_eff(thermal_accel(x))
    return drop_redundant(poly_sq(x), drop)

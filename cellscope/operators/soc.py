"""SOC-binned analytics: equal-width right-closed SOC bins and per-bin profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscope.functions.exprs import soc_bin as soc_bin_expr
from cellscope.operators.ordering import attach_row

# The reference's bin counts and profiled columns.
IR_BINS = 20
PROFILE_BINS = 10
PROFILE_COLS = ["terminal_voltage", "battery_temp", "battery_current", "internal_resistance", "charging_efficiency"]
RANGE_COLS = ["SOC", "SOH", "terminal_voltage", "battery_current", "battery_temp", "ambient_temp",
              "internal_resistance", "charging_efficiency"]


def soc_bin(df: DataFrame, k: int = IR_BINS, col: str = "SOC", out: str = "soc_bin") -> DataFrame:
    """Adds the bin index of ``col`` (min/max from one aggregate, broadcast as one row)."""
    mm = df.agg(F.min(col).cast("double").alias("_smin"), F.max(col).cast("double").alias("_smax"))
    x = attach_row(df, mm, "_mm")
    return x.withColumn(out, soc_bin_expr(col, F.col("_mm._smin"), F.col("_mm._smax"), k)).drop("_mm")


def ir_by_soc(df: DataFrame, k: int = IR_BINS) -> DataFrame:
    """Mean, sample std and count of IR per SOC bin."""
    b = soc_bin(df, k)
    return b.where(F.col("soc_bin").isNotNull()).groupBy("soc_bin").agg(
        F.avg("internal_resistance").alias("ir_mean"), F.stddev_samp("internal_resistance").alias("ir_std"),
        F.count("internal_resistance").alias("ir_count"))


def soc_profile(df: DataFrame, k: int = PROFILE_BINS, cols: Sequence[str] = PROFILE_COLS) -> DataFrame:
    """Mean of each profiled column per non-empty SOC bin."""
    b = soc_bin(df, k)
    return b.where(F.col("soc_bin").isNotNull()).groupBy("soc_bin").agg(*[F.avg(c).alias(c) for c in cols])


def feature_ranges(df: DataFrame, cols: Sequence[str] = RANGE_COLS) -> DataFrame:
    """min, max, mean of each column present."""
    cols = [c for c in cols if c in df.columns]
    row = df.agg(*[a for c in cols for a in (F.min(c).cast("double").alias(f"{c}__min"),
                                              F.max(c).cast("double").alias(f"{c}__max"),
                                              F.avg(c).alias(f"{c}__mean"))])
    structs = [F.struct(F.lit(c).alias("feature"), *[F.col(f"{c}__{n}").alias(n) for n in ("min", "max", "mean")])
               for c in cols]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def feature_limits(df: DataFrame, selected: Sequence[str]) -> DataFrame:
    """(min, max) of each selected feature found in the table; (0, 1) for engineered ones."""
    have = [c for c in selected if c in df.columns]
    row = df.agg(*[a for c in have for a in (F.min(c).cast("double").alias(f"{c}__min"),
                                              F.max(c).cast("double").alias(f"{c}__max"))])
    structs = []
    for i, c in enumerate(selected):
        lo = F.col(f"{c}__min") if c in have else F.lit(0.0)
        hi = F.col(f"{c}__max") if c in have else F.lit(1.0)
        structs.append(F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), lo.alias("lo"), hi.alias("hi")))
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")

"""Telemetry schema and the telemetry views derived from the ``events`` table.

A reading is one row: ``battery_id`` (entity / partition key), ``seq`` (order key,
metadata only, never a feature), 17 raw features and 3 targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The reference's column names.
RAW_FEATURES = [
    "SOC", "SOH", "terminal_voltage", "battery_current", "battery_temp", "ambient_temp",
    "internal_resistance", "action_current", "action_voltage", "dT_dt", "dV_dt",
    "soc_delta", "thermal_stress_index", "aging_indicator", "charging_efficiency",
    "charging_time", "balancing_time",
]
TARGETS = ["cycle_degradation", "over_temp_flag", "over_voltage_flag"]
FLAGS = ["over_temp_flag", "over_voltage_flag"]

TELEMETRY_SCHEMA = T.StructType(
    [T.StructField("battery_id", T.LongType()), T.StructField("seq", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in RAW_FEATURES if c != "balancing_time"]
    + [T.StructField("cycle_degradation", T.DoubleType())]
    + [T.StructField(c, T.IntegerType()) for c in FLAGS]
    + [T.StructField("balancing_time", T.DoubleType())]
)


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Turn NaN into NULL once, at the source, so later steps are NULL-based.

    Spark's avg/max over a NaN return NaN and ``NaN > x`` is true, unlike pandas.
    """
    dbl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    cols = [c for c in (cols or df.columns) if c in dbl]
    return df.select(*[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _d(x: float) -> Column:
    return F.lit(float(x))


def telemetry_from_events(events: DataFrame) -> DataFrame:
    """Map ``events`` onto the 21-column telemetry schema (the FIXTURES ``telemetry`` view)."""
    e, u = F.col("event_id"), F.col("user_id")
    temp = _d(30) + (e % 1100)
    cols = [
        u.alias("battery_id"),
        e.alias("seq"),
        F.regexp_extract("props", "[0-9]+", 0).cast("int") * _d(1),
        _d(0.86) + (e % 13) * _d(0.01),
        _d(2.8) + ((e * 7) % 101) * _d(0.014),
        _d(5) + e % 29,
        temp,
        _d(10) + u % 30,
        _d(0.019) + F.col("value") * _d(0.00026),
        _d(4) + (e * 3) % 30,
        _d(2.8) + ((e * 11) % 97) * _d(0.0145),
        _d(0.03) + (e % 204) * _d(0.01),
        ((e * 5) % 79) * _d(0.001) - _d(0.046),
        _d(0.012) + (e % 71) * _d(0.001),
        F.least(temp / _d(1129), _d(1)),
        _d(0.14) - (e % 13) * _d(0.01),
        _d(0.811) + (e % 88) * _d(0.001),
        _d(1848) + (e * 17) % 2300,
        _d(0.0001) + ((e * 19) % 91) * _d(0.00001),
        F.when(F.col("event_type") == "error", 1).otherwise(0),
        F.when(e % 150 == 0, 1).otherwise(0),
        _d(2.35) + (e % 37) * _d(1),
    ]
    names = ["battery_id", "seq", "SOC", "SOH", "terminal_voltage", "battery_current",
             "battery_temp", "ambient_temp", "internal_resistance", "action_current",
             "action_voltage", "dT_dt", "dV_dt", "soc_delta", "thermal_stress_index",
             "aging_indicator", "charging_efficiency", "charging_time", "cycle_degradation",
             "over_temp_flag", "over_voltage_flag", "balancing_time"]
    out = events.select(*[c.alias(n) for c, n in zip(cols, names)])
    return nan_to_null(out.select(*[F.col(f.name).cast(f.dataType) for f in TELEMETRY_SCHEMA.fields]))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_from_events(read_table(spark, sf_dir, "events"))


def telemetry_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry with NULL holes and exact repeats (FIXTURES ``telemetry_dirty``)."""
    t = telemetry(spark, sf_dir)
    s = F.col("seq")
    base = t.select(
        "battery_id", "seq",
        F.when(s % 17 == 0, F.lit(None)).otherwise(F.col("SOC")).alias("SOC"),
        F.when(s % 23 == 0, F.lit(None)).otherwise(F.col("terminal_voltage")).alias("terminal_voltage"),
        "action_voltage", "internal_resistance", "over_temp_flag",
    )
    dup = base.where(s % 50 == 0).withColumn("seq", s + F.lit(100000000))
    return base.unionByName(dup)


def scores_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-free scores for evaluation operators (FIXTURES ``scores``)."""
    t = telemetry(spark, sf_dir)
    s = F.col("seq")
    return t.select(
        "battery_id", "seq", F.col("over_temp_flag").alias("label"),
        (((s * 37) % 1000) * _d(0.0007) + F.col("over_temp_flag") * _d(0.3)).alias("prob"),
        F.col("internal_resistance").alias("y"),
        (F.col("internal_resistance") + ((s % 21) - 10) * _d(0.0001)).alias("yhat"),
    )


def telemetry_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry with NULL keys, flags and scores, a battery of a few rows and a constant column."""
    t = telemetry(spark, sf_dir)
    s = F.col("seq")
    hole = lambda n, c: F.when(s % n != 0, F.col(c)).alias(c)
    return t.select(
        F.when(s % 11 == 0, F.lit(None)).when(s % 2003 == 7, F.lit(-5)).otherwise(F.col("battery_id")).cast("long").alias("battery_id"),
        "seq", hole(17, "SOC"), hole(23, "terminal_voltage"), "internal_resistance", "battery_temp", _d(5).alias("flat"),
        F.col("over_temp_flag").alias("label"), hole(13, "over_temp_flag"),
        F.when(s % 19 != 0, ((s * 37) % 1000) * _d(0.0007)).alias("prob"))

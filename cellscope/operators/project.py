"""Projections and predicates: drop / select / split columns, filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscope.sources.telemetry import TARGETS

# The reference's 15 selected features (order matters for the vector).
SELECTED_FEATURES = [
    "SOH", "battery_current", "ambient_temp", "action_current", "action_voltage", "dV_dt",
    "soc_delta", "charging_efficiency", "charging_time", "balancing_time", "soc_range_rolling",
    "thermal_acceleration", "voltage_efficiency", "internal_resistance_sq", "aging_indicator_sq",
]


def drop_cols(df: DataFrame, cols: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Drop columns (absent ones are ignored). The order key ``seq`` is metadata and kept."""
    return df.drop(*cols)


def feature_target_split(df: DataFrame, target: str, keys: Sequence[str] = ("battery_id", "seq"),
                         targets: Sequence[str] = TARGETS) -> tuple[DataFrame, DataFrame]:
    """X = keys + every column that is not a target; y = keys + the target."""
    x_cols = [c for c in df.columns if c not in targets]
    return df.select(*x_cols), df.select(*keys, target)


def exclude_target(features: Sequence[str], target: str, faithful: bool = False) -> list[str]:
    """Remove the target from a feature list; unless ``faithful``, also remove columns derived
    from it (``{target}_sq``, ``delta_{target}``), which would leak it."""
    leak = {target} if faithful else {target, f"{target}_sq", f"delta_{target}"}
    return [f for f in features if f not in leak]


def select_features(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, *features)


def pred_only(df: DataFrame, prefix: str = "pred_", keys: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, *[c for c in df.columns if c.startswith(prefix)])


def class_filter(df: DataFrame, flag_col: str, value: int) -> DataFrame:
    return df.where(F.col(flag_col) == value)

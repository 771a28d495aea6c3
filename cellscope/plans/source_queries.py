"""Registered queries: CSV sources. The CSV files are written by Spark from the
given tables into the shared scratch folder, then read back with the fixed schema."""

from __future__ import annotations

from cellscope.plans.registry import register
from cellscope.session import scratch_path
from cellscope.sources import files
from cellscope.sources.telemetry import RAW_FEATURES, TELEMETRY_SCHEMA, telemetry

KEYS = ["battery_id", "seq"]
DBL = [f.name for f in TELEMETRY_SCHEMA.fields if f.dataType.simpleString() == "double"]


@register("src_csv", "select * from telemetry", doubles=DBL)
def q_src_csv(spark, sf_dir):
    path = scratch_path(spark, "telemetry-csv")
    telemetry(spark, sf_dir).write.option("header", True).csv(path)
    return files.read_csv(spark, path)


PART = [c for c in RAW_FEATURES if c not in ("dT_dt", "dV_dt", "soc_delta")]


@register("src_batch", "select battery_id, seq, " + ", ".join(
    c if c in PART else f"0e0 as {c}" for c in RAW_FEATURES) + " from telemetry", doubles=RAW_FEATURES)
def q_src_batch(spark, sf_dir):
    path = scratch_path(spark, "batch-csv")
    telemetry(spark, sf_dir).select(*KEYS, *PART).write.option("header", True).csv(path)
    return files.read_batch(spark, path).select(*KEYS, *RAW_FEATURES)

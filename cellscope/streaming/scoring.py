"""Structured Streaming use of the stateless operators: readings arrive as a stream, the
voltage rule, health, status and alerts are computed per micro-batch against fleet
statistics computed once from the historical table (a one-row static side, broadcast)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscope.functions.exprs import over_voltage
from cellscope.operators import fleet as fl
from cellscope.operators.ordering import materialize_small
from cellscope.sources.telemetry import telemetry_from_events


def stream_assess(stream_events: DataFrame, fleet: DataFrame) -> DataFrame:
    """Streaming events -> telemetry -> rule -> health / status / alerts (no state needed)."""
    t = telemetry_from_events(stream_events).withColumn("pred_over_voltage_flag", over_voltage())
    h = fl.health(t, fleet, volt_flag_col="pred_over_voltage_flag", keep_fleet=True)
    a = fl.alerts(h, fleet, volt_flag_col="pred_over_voltage_flag")
    return a.select("battery_id", "seq", "health_score", "status", F.size("alerts").alias("n_alerts"))


def start_assessment(spark: SparkSession, events_dir: str, history: DataFrame, sink: str,
                     query_name: str = "assessed", checkpoint: str | None = None, glob: str = "*.parquet",
                     **sink_opts):
    """Start the streaming assessment over parquet files (matching ``glob``) arriving in
    ``events_dir``. ``sink`` is named by the caller: "memory" keeps all rows in the driver."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(events_dir).schema
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", glob)
           .parquet(events_dir))
    fleet = materialize_small(fl.fleet_stats(history))  # one row, fixed for the stream
    out = stream_assess(src, fleet)
    w = out.writeStream.outputMode("append").format(sink).queryName(query_name)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    for k, v in sink_opts.items():
        w = w.option(k, v)
    return w.start()

"""cellscope: battery-charging telemetry analytics on Spark.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, windows and aggregations. Fitted values (medians, means, fleet
statistics, thresholds) are small DataFrames joined back with a broadcast, and
model fits use MLlib estimators.
"""

from cellscope.session import get_spark, scratch_path

__all__ = ["get_spark", "scratch_path"]

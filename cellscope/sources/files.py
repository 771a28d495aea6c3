"""File sources and sinks: CSV tables and batches, parameter tables, fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellscope.sources.telemetry import RAW_FEATURES, TELEMETRY_SCHEMA, nan_to_null


ORDER_ALIASES = ("timestamp",)  # a file's own name for the order of its rows


def _with_ids(raw: DataFrame) -> DataFrame:
    """Adds the metadata a file may lack: ``seq`` from its order column, else from the place of
    the rows in the file, and ``battery_id`` as NULL, which makes the file one sequence."""
    for name in ORDER_ALIASES:
        if name in raw.columns:
            raw = raw.withColumnRenamed(name, "seq") if "seq" not in raw.columns else raw.drop(name)
    if "seq" not in raw.columns:
        raw = raw.withColumn("seq", F.monotonically_increasing_id())
    if "battery_id" not in raw.columns:
        raw = raw.withColumn("battery_id", F.lit(None).cast("long"))
    return raw


def read_csv(spark: SparkSession, path: str, schema: T.StructType = TELEMETRY_SCHEMA) -> DataFrame:
    """Training table from CSV: columns are found by the names in the header, in any order, and
    cast to the fixed schema (no inference; a value that cannot be cast fails). A missing column
    fails; ``timestamp`` may stand for ``seq`` and ids may be absent. NaN -> NULL."""
    raw = _with_ids(spark.read.option("header", True).csv(path))
    missing = [f.name for f in schema.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    return nan_to_null(raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]))


def default_fill(df: DataFrame, required: list[str] = RAW_FEATURES, value: float = 0.0) -> DataFrame:
    """Add every absent required column as a literal (0.0). NULLs in present columns stay
    NULL and are left to the imputer."""
    have = set(df.columns)
    missing = [F.lit(float(value)).alias(c) for c in required if c not in have]
    return df.select("*", *missing) if missing else df


def read_batch(spark: SparkSession, path: str, required: list[str] = RAW_FEATURES) -> DataFrame:
    """A user-supplied CSV batch to score: columns by name (header), all numeric columns read
    as double, absent required columns filled with 0.0, absent ids as in ``read_csv``."""
    raw = _with_ids(spark.read.option("header", True).csv(path))
    cast = [F.col(c).cast("long").alias(c) if c in ("battery_id", "seq") else
            F.col(c).cast("double").alias(c) for c in raw.columns]
    return default_fill(nan_to_null(raw.select(*cast)), required)


def derive_indicators(df: DataFrame) -> DataFrame:
    """Fill the derived columns a bare reading lacks, as the assessment form does:
    thermal_stress_index = min(battery_temp/1129, 1), aging_indicator = 1 - SOH,
    dT_dt = dV_dt = soc_delta = 0, balancing_time = 15. Present columns are kept."""
    # The form's defaults for readings without derived columns.
    derived = {
        "thermal_stress_index": F.least(F.col("battery_temp") / F.lit(1129.0), F.lit(1.0)),
        "aging_indicator": F.lit(1.0) - F.col("SOH"),
        "dT_dt": F.lit(0.0),
        "dV_dt": F.lit(0.0),
        "soc_delta": F.lit(0.0),
        "balancing_time": F.lit(15.0),
    }
    add = [e.alias(c) for c, e in derived.items() if c not in df.columns]
    return df.select("*", *add) if add else df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Scored table -> CSV with a header, no index column. Written in parallel, one file per task."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def preview(df: DataFrame, n: int = 5, order_by: str = "seq") -> DataFrame:
    """First n rows in the explicit order (Spark has no implicit row order)."""
    return df.orderBy(order_by).limit(n)


def save_params(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Persist a small fitted-parameter table (medians, means, thresholds, split bounds)."""
    df.coalesce(1).write.mode("overwrite").format(fmt).save(path)
    return path


def load_params(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def save_model(model, path: str) -> str:
    """Persist a fitted MLlib model / PipelineModel."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)

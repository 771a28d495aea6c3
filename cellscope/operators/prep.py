"""Preprocessing fit/transform: engineer -> impute (all engineered features) -> scale (all)
-> select the chosen features. Parameters are fitted on train rows only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscope.operators import clean, features
from cellscope.operators.ordering import DEFAULT_CHUNK_ROWS, checkpointed, materialize_small, written
from cellscope.sources.telemetry import RAW_FEATURES, TARGETS

META = ["battery_id", "seq", "pos", "n_rows", "split", "split_pos", "split_rows"]


def engineered_columns(df: DataFrame) -> list[str]:
    """The engineered feature list in frame order (targets and metadata excluded)."""
    return [c for c in df.columns if c not in META and c not in TARGETS and not c.startswith(("y_", "_orig_"))]


@dataclass
class PrepParams:
    baseline: DataFrame   # one row: baseline_ir
    medians: DataFrame    # feature, median
    stats: DataFrame      # feature, mean, std
    columns: list[str]    # all engineered features (imputed and scaled)

    def save(self, path: str) -> None:
        """One table each for the baseline, medians and moments, and one for the columns in their order."""
        spark = self.medians.sparkSession
        spark.createDataFrame(list(enumerate(self.columns)), "position int, feature string") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")
        self.baseline.coalesce(1).write.mode("overwrite").parquet(f"{path}/baseline")
        self.medians.coalesce(1).write.mode("overwrite").parquet(f"{path}/medians")
        self.stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "PrepParams":
        columns = [r["feature"] for r in spark.read.parquet(f"{path}/columns").orderBy("position").collect()]  # one row a feature
        return cls(spark.read.parquet(f"{path}/baseline"), spark.read.parquet(f"{path}/medians"),
                   spark.read.parquet(f"{path}/stats"), columns)


def engineer(df: DataFrame, baseline: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS,
             passthrough: Sequence[str] = ()) -> DataFrame:
    raw = [c for c in RAW_FEATURES if c in df.columns]
    keep = [c for c in META if c in df.columns] + raw + [c for c in TARGETS if c in df.columns] + list(passthrough)
    return features.engineer_all(df.select(*keep), baseline, chunk_rows=chunk_rows)


def _medians(train: DataFrame, cols: Sequence[str], selected: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Medians, and the features that have one. A feature without any train value is left out of the
    fitted parameters; asking for it fails here, not as NaN in a later fit."""
    med = materialize_small(clean.impute_fit(train, cols))
    empty = clean.empty_features(med)
    if set(empty) & set(selected):
        raise ValueError(f"features without any train value: {sorted(set(empty) & set(selected))}")
    return med.where(F.col("median").isNotNull()), [c for c in cols if c not in empty]


def prep_fit(split_df: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> PrepParams:
    """Fit on the train rows of a chrono-split frame: IR baseline, medians, then mean/std of
    the imputed values (engineering runs on the train slice alone)."""
    baseline = materialize_small(features.ir_baseline(split_df))
    train = split_df.where(F.col("split") == "train")
    # the engineered train slice feeds two passes (medians, then moments): cut its lineage once
    eng = checkpointed(engineer(train, baseline, chunk_rows))
    cols = engineered_columns(eng)
    med, cols = _medians(eng, cols)
    imputed = clean.impute_apply(eng, med, cols)
    stats = materialize_small(clean.scale_fit(imputed, cols))
    return PrepParams(baseline, med, stats, cols)


def prep_fit_transform(split_df: DataFrame, selected: Sequence[str], keys: Sequence[str] = ("battery_id", "seq"),
                       chunk_rows: int = DEFAULT_CHUNK_ROWS, passthrough: Sequence[str] = ()):
    """Fit on train rows and transform every row of a chrono-split frame, engineering once.

    Engineering is per (battery, split) with per-split fill medians and the train baseline,
    so the train rows of the engineered whole frame equal the engineered train slice; the
    engineered frame is written once and feeds the medians, the moments and the output."""
    baseline = materialize_small(features.ir_baseline(split_df))
    eng = written(engineer(split_df, baseline, chunk_rows, passthrough), "engineered")
    cols = [c for c in engineered_columns(eng) if c not in passthrough]
    train = eng.where(F.col("split") == "train")
    med, cols = _medians(train, cols, selected)
    stats = materialize_small(clean.scale_fit(clean.impute_apply(train, med, cols), cols))
    params = PrepParams(baseline, med, stats, cols)
    sc = clean.scale_apply(clean.impute_apply(eng, med, cols), stats, cols)
    extra = [c for c in TARGETS + ["split", "split_pos", "split_rows"] + list(passthrough) if c in sc.columns]
    return params, sc.select(*keys, *selected, *extra)


def prep_transform(df: DataFrame, params: PrepParams, selected: Sequence[str],
                   keys: Sequence[str] = ("battery_id", "seq"),
                   chunk_rows: int = DEFAULT_CHUNK_ROWS, passthrough: Sequence[str] = ()) -> DataFrame:
    """Engineer with the train baseline, impute and scale all engineered features with the
    train parameters, then keep ``keys`` + ``selected`` (+ targets present + passthrough)."""
    lost = sorted(set(selected) - set(params.columns))
    if lost:
        raise ValueError(f"features without fitted parameters: {lost}")
    if "split" not in df.columns:  # a batch to score is one frame
        df = df.withColumn("split", F.lit("batch"))
    eng = engineer(df, params.baseline, chunk_rows, passthrough)
    imp = clean.impute_apply(eng, params.medians, params.columns)
    sc = clean.scale_apply(imp, params.stats, params.columns)
    extra = [c for c in TARGETS + ["split", "split_pos", "split_rows"] + list(passthrough) if c in sc.columns]
    return sc.select(*keys, *selected, *extra)

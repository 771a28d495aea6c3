from cellscope.sources.telemetry import (
    RAW_FEATURES, TARGETS, TELEMETRY_SCHEMA, nan_to_null, read_table, telemetry,
    telemetry_dirty, telemetry_holes, scores_view,
)
from cellscope.sources.files import (
    read_csv, read_batch, default_fill, derive_indicators, write_csv, preview,
    save_params, load_params, save_model, load_model,
)

__all__ = [
    "RAW_FEATURES", "TARGETS", "TELEMETRY_SCHEMA", "nan_to_null", "read_table", "telemetry",
    "telemetry_dirty", "telemetry_holes", "scores_view", "read_csv", "read_batch", "default_fill",
    "derive_indicators", "write_csv", "preview", "save_params", "load_params",
    "save_model", "load_model",
]

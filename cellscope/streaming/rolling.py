"""Stateful streaming SOC range: the trailing 10-reading max - min of SOC per battery over a
live stream. Each battery keeps its last ``window - 1`` readings as state, so a frame that
spans micro-batches is still exact; readings are assumed to arrive in ``seq`` order per
battery. The batch operator fills the first frames with the frame's median; a stream has no
whole frame, so NULLs are filled with a given (train) median instead."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

OUTPUT_SCHEMA = "battery_id long, seq long, SOC double, soc_range_rolling double"
STATE_SCHEMA = "seqs array<long>, socs array<double>"


def _rolling_state_fn(window: int, fill: float | None):
    def fn(key, batches, state):
        pdf = pd.concat(list(batches), ignore_index=True).sort_values("seq")
        if state.exists:
            seqs, socs = state.get
            prev = pd.DataFrame({"seq": list(seqs), "SOC": list(socs)})
        else:
            prev = pd.DataFrame({"seq": pd.Series([], dtype="int64"), "SOC": pd.Series([], dtype="float64")})
        allv = pd.concat([prev, pdf[["seq", "SOC"]]], ignore_index=True)
        r = allv["SOC"].rolling(window=window)
        rng = (r.max() - r.min()).to_numpy()[len(prev):]
        if fill is not None:
            rng = np.where(np.isnan(rng), fill, rng)
        tail = allv.iloc[-(window - 1):] if window > 1 else allv.iloc[0:0]
        state.update((tail["seq"].astype("int64").tolist(), tail["SOC"].astype("float64").tolist()))
        out = pd.DataFrame({"battery_id": np.full(len(pdf), key[0], dtype="int64"),
                            "seq": pdf["seq"].to_numpy(dtype="int64"), "SOC": pdf["SOC"].to_numpy(dtype="float64"),
                            "soc_range_rolling": rng})
        yield out
    return fn


def stream_soc_range(readings: DataFrame, window: int = 10, fill: float | None = None) -> DataFrame:
    """Streaming (or batch) readings (battery_id, seq, SOC) -> trailing SOC range per battery,
    with per-battery state of the last ``window - 1`` readings."""
    return readings.select("battery_id", "seq", "SOC").groupBy("battery_id").applyInPandasWithState(
        _rolling_state_fn(window, fill), OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)

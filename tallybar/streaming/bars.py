"""Streaming bars with a watermark, and recursive averages with constant state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bars(rows: DataFrame, key: str, time: str, value: str, tie: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """sym, ts, open, high, low, close, volume of finished windows; rows later than ``late`` are dropped."""
    at = F.struct(time, tie)
    v = F.col(value).cast("double")
    grouped = rows.withWatermark(time, late).groupBy(F.col(key).alias("sym"), F.window(time, width).alias("w"))
    bars = grouped.agg(F.min_by(v, at).alias("open"), F.max(v).alias("high"), F.min(v).alias("low"), F.max_by(v, at).alias("close"), F.count("*").cast("double").alias("volume"))
    return bars.select("sym", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_average(bars: DataFrame, length: int, alpha: float | None = None) -> DataFrame:
    """sym, ts, close and an exponential average seeded by the mean of the first ``length`` closes.

    Bars must come in order within an instrument; the state is (count, sum or average).
    """
    weight = 2 / (length + 1) if alpha is None else alpha

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, value = state.get if state.exists else (0, 0.0)
        frame = pd.concat(list(frames)).sort_values("ts", kind="stable")
        out = []
        for close in frame["close"]:
            n += 1
            if n <= length:
                value += close
                if n == length:
                    value /= length
            else:
                value += weight * (close - value)
            out.append(value if n >= length else None)
        state.update((min(n, length + 1), value))
        yield pd.DataFrame({"sym": key[0], "ts": frame["ts"], "close": frame["close"], "average": pd.array(out, dtype="Float64")})

    schema = "sym string, ts timestamp, close double, average double"
    return bars.select("sym", "ts", "close").groupBy("sym").applyInPandasWithState(run, schema, "n bigint, value double", "append", GroupStateTimeout.NoTimeout)

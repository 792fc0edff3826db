"""Streams of ticks: bars by event time with late rows dropped, sessions, and indicators with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bars(ticks: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(symbol, ts, open, high, low, close, volume) of ticks (symbol, ts, seq, value); rows later than ``late`` are dropped."""
    at = F.struct("ts", "seq")
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = ticks.withWatermark("ts", late).groupBy("symbol", w.alias("w")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(symbol, start, end, ticks, total): runs of ticks without a gap."""
    out = ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("ticks"), F.sum("value").alias("total"))
    return out.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "ticks", "total")


def stream_ema(bars: DataFrame, length: int = 20) -> DataFrame:
    """(symbol, ts, close, ema): one number of state a symbol; a micro-batch's bars are taken in order of time."""
    gain = 2 / (length + 1)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        y = state.get[0] if state.exists else None
        got = pd.concat(list(frames)).sort_values("ts")
        out = []
        for x in got["close"]:
            if x is not None and x == x:
                y = float(x) if y is None else y + gain * (x - y)
            out.append(y)
        if y is not None:
            state.update((y,))
        yield pd.DataFrame({"symbol": key[0], "ts": got["ts"].to_numpy(), "close": got["close"].to_numpy(), "ema": out})

    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, close double, ema double", "y double", "append", GroupStateTimeout.NoTimeout)

"""Multi-timeframe columns: longer bars, their features, and the last finished one of each at every bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeloom.operators import base
from tapeloom.sources import bars as source

#: suffix -> interval
FRAMES = {"_4H": "4 hours", "_D": "1 day", "_W": "7 days"}
NAMES = {"ma.ema": {"length": 50}, "momentum.rsi": {}, "momentum.roc": {}, "momentum.momentum": {}, "momentum.macd": {}, "momentum.adx": {}, "volume.obv": {}, "volume.chaikin_money_flow": {}, "volume.vwap": {}}
KEPT = ["open", "close", "volume", "ema", "rsi", "roc", "momentum", "macd_histogram", "adx_adx", "obv", "chaikin_money_flow", "vwap"]


def with_timeframes(bars: DataFrame, frames: dict[str, str] = FRAMES, digits: int | None = None) -> DataFrame:
    """``bars`` with <name><suffix> columns. A longer bar is known from its end on: no look-ahead."""
    out = bars
    for suffix, interval in frames.items():
        longer = base.compute(source.resample(bars, interval), NAMES, digits).withColumn("ready", F.col("ts") + F.expr(f"INTERVAL {interval}"))
        out = source.asof(out, longer, KEPT, suffix=suffix, ready="ready")
    return out


def timeframes_sql(bars: str, frames: dict[str, str] = FRAMES, digits: int | None = None) -> str:
    steps, last = [f"b0 AS ({bars})"], "b0"
    for k, (suffix, interval) in enumerate(frames.items()):
        bucket = f"time_bucket(INTERVAL '{interval}', ts, TIMESTAMP '1970-01-01')"
        longer = f"SELECT symbol, {bucket} AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM ({bars}) GROUP BY 1, 2"
        steps.append(f"t{k} AS (SELECT *, ts + INTERVAL '{interval}' AS ready FROM ({base.sql(longer, NAMES, digits)}))")
        cols = ", ".join(f"t.{c} AS {c}{suffix}" for c in KEPT)
        steps.append(f"b{k + 1} AS (SELECT a.*, {cols} FROM {last} a ASOF LEFT JOIN t{k} t ON a.symbol = t.symbol AND a.ts >= t.ready)")
        last = f"b{k + 1}"
    return f"WITH {', '.join(steps)} SELECT * FROM {last}"

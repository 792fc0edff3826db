"""Indicators of a stream of bars by event time: bars wait for the watermark, then keyed state is moved on in order of time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeloom.functions.scratch import Scratch
from tapeloom.operators.volume import histogram, profile

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PRICES = ("open", "high", "low", "close", "volume")
MEASURES = ("rsi", "atr", "poc", "vah", "val")
OUT = "symbol string, start long, " + ", ".join(f"{c} double" for c in (*PRICES, *MEASURES))


def number(x: float | None) -> float | None:
    return None if x is None or x != x else float(x)


class Wilder:
    """The mean of the first n values in a row, then 1/n of each new one; missing values carry it on."""

    def __init__(self, n: int, y: float | None = None, seen: list | None = None):
        self.n, self.y, self.seen = n, y, list(seen or [])

    def push(self, x: float | None) -> float | None:
        if self.y is not None:
            self.y += (x - self.y) / self.n if x is not None else 0.0
        else:
            self.seen = [*self.seen, x][-self.n :]
            if len(self.seen) == self.n and None not in self.seen:
                self.y, self.seen = sum(self.seen) / self.n, []
        return self.y


class Session:
    """The prices and volumes of the day so far; its profile between the lowest and the highest of them."""

    def __init__(self, bins: int, day: int | None, prices: list, volumes: list):
        self.bins, self.day, self.prices, self.volumes = bins, day, list(prices), list(volumes)

    def push(self, day: int, price: float | None, volume: float | None) -> tuple:
        if day != self.day:
            self.day, self.prices, self.volumes = day, [], []
        if price is not None:
            self.prices.append(price)
            self.volumes.append(volume or 0.0)
        if not self.prices:
            return None, None, None
        low, high = min(self.prices), max(self.prices)
        if low == high:
            return (self.prices[-1],) * 3
        return profile(*histogram(np.array(self.prices), np.array(self.volumes), low, high, self.bins))[:3]


class Indicators(StatefulProcessor):
    """Held: the bars that the watermark hasn't passed. Kept: the last close, three means, and the session so far."""

    def __init__(self, length: int, bins: int):
        self.length, self.bins = length, bins

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, start long, day long, " + ", ".join(f"{c} double" for c in PRICES))
        means = ", ".join(f"{c} double, {c}_seen array<double>" for c in ("gain", "loss", "range"))
        self.kept = handle.getValueState("kept", f"close double, {means}, day long, prices array<double>, volumes array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            whole = zip(*(part[c].tolist() for c in ("at", "start", "day")))
            prices = zip(*(map(number, part[c].tolist()) for c in PRICES))
            self.held.appendList([(*(int(v) for v in a), *b) for a, b in zip(whole, prices)])
            least = int(part["at"].min())
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.held.get()]
        due = [r for r in held if r[0] < until]
        if not due:
            return
        rest = [r for r in held if r[0] >= until]
        if rest:
            self.held.put(rest)
            self.handle.registerTimer(min(r[0] for r in rest) // 1000 + 1)
        else:
            self.held.clear()
        due.sort(key=lambda r: (r[0], *((v is not None, v or 0.0) for v in r[3:])))
        yield self.moved(key[0], due)

    def moved(self, symbol: str, bars: list[tuple]) -> pd.DataFrame:
        """The measures at each of these bars, from the state they are the next of; moves the state on."""
        last = tuple(self.kept.get()) if self.kept.exists() else (None,) * 10
        close, day, prices, volumes = last[0], *last[7:]
        gain, loss, spread = (Wilder(self.length, last[i], last[i + 1]) for i in (1, 3, 5))
        session = Session(self.bins, day, prices or [], volumes or [])
        out = []
        for _, start, day, o, h, lo, c, v in bars:
            step = c - close if c is not None and close is not None else None
            up = gain.push(max(step, 0.0) if step is not None else None)
            down = loss.push(max(-step, 0.0) if step is not None else None)
            gaps = [abs(x - close) for x in (h, lo) if x is not None and close is not None]
            if len(gaps) == 2:
                gaps.append(h - lo)
            atr = spread.push(max(gaps, default=None))
            rsi = None
            if up is not None and down is not None:
                rsi = 100 - 100 / (1 + up / down) if down else 100.0 if up else 50.0
            price = (h + lo + c) / 3 if None not in (h, lo, c) else None
            out.append((symbol, start, o, h, lo, c, v, rsi, atr, *session.push(day, price, v)))
            close = c
        means = [x for w in (gain, loss, spread) for x in (w.y, w.seen)]
        self.kept.update((close, *means, session.day, session.prices, session.volumes))
        got = pd.DataFrame(out, columns=["symbol", "start", *PRICES, *MEASURES])
        return got.astype(dict.fromkeys((*PRICES, *MEASURES), "float64"))


def stream_indicators(bars: DataFrame, length: int = 14, bins: int = 10, closes: str = "ts", session: Column | None = None) -> DataFrame:
    """(symbol, ts, open .. volume, rsi, atr, poc, vah, val) of a stream of bars, each once the watermark passes ``closes``.

    ``closes`` is the event time of ``bars`` and has the watermark. Bars may come in any order and any batch: they are held
    until the watermark is past them and then taken by time, ties by prices and volume, so the rows are those of the whole
    table. Bars later than the watermark are dropped by the engine. A symbol keeps three means, its last close, the
    prices and volumes of its last ``session`` (a whole number; the day of ts by default) and the bars that wait. A missing price leaves its measures as a missing value of the
    whole table does; a null symbol is a symbol; bars without a time are dropped; an empty stream gives no rows. Other columns
    aren't kept. The session's state store must be RocksDB (``replay`` sets it).
    """
    known = bars.where(F.col(closes).isNotNull() & F.col("ts").isNotNull())
    named = {"at": F.unix_micros(F.col(closes)), "start": F.unix_micros("ts"), "day": F.unix_date(F.to_date("ts")) if session is None else session}
    rows = known.select("symbol", closes, *(e.cast("long").alias(c) for c, e in named.items()), *(F.col(c).cast("double").alias(c) for c in PRICES))
    got = rows.groupBy("symbol").transformWithStateInPandas(Indicators(length, bins), OUT, "Append", "eventTime")
    nan_free = (F.when(~F.isnan(c), F.col(c)).alias(c) for c in (*PRICES, *MEASURES))
    return got.select("symbol", F.timestamp_micros("start").alias("ts"), *nan_free)


def closed_bars(ticks: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of ticks (symbol, ts, seq, value), with their end ``closes`` as event time; combined before the shuffle."""
    at = F.struct("ts", "seq")
    grouped = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", size).alias("w"))
    found = grouped.agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )
    return found.select("symbol", F.col("w.start").alias("ts"), F.window_time("w").alias("closes"), *PRICES)


def replay(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """The rows of a stream over what is there now: run to its end into Parquet in the shared folder, and read."""
    scratch = Scratch(spark, name)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        rows = f"{scratch.folder}/rows"
        writer = stream.writeStream.format("parquet").outputMode("append").option("path", rows)
        writer.option("checkpointLocation", f"{scratch.folder}/progress").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(rows)

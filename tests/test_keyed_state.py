"""Keyed event-time state: bars in any order over several micro-batches against the indicators of the whole table."""

import datetime as dt
import random

import numpy as np

from tapeloom.operators import base
from tapeloom.plans import registry  # noqa: F401 (fills the catalogue)
from tapeloom.streaming import state

T0 = dt.datetime(2024, 3, 1)
KIND = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, more string"


def _bars(rng, symbol, n):
    out, p = [], 100.0
    for i in range(n):
        o, p = p, round(p + rng.uniform(-2, 2), 2)
        row = [symbol, T0 + dt.timedelta(hours=i), o, max(o, p) + 1, min(o, p) - 1, p, float(rng.randrange(5)), "x"]
        if i % 17 == 5:
            row[rng.choice([3, 4, 5, 6])] = None
        out.append(tuple(row))
    return [*out[:40], out[39], *out[40:]]  # a repeated row


def test_bars_in_any_order_equal_the_whole_table(spark, tmp_path):
    rng = random.Random(4)
    bars = [*_bars(rng, "A", 90), *_bars(rng, "B", 90), *_bars(rng, None, 60)]
    late = ("A", T0 + dt.timedelta(hours=2), 1.0, 1.0, 1.0, 1.0, 1.0, "late")
    shaken = sorted(bars, key=lambda r: r[1] + dt.timedelta(hours=rng.uniform(-4, 4)))
    timeless = ("B", None, 1.0, 1.0, 1.0, 1.0, 1.0, "no time")
    cuts = [shaken[:90], [*shaken[90:170], timeless], [*shaken[170:], late], [("end", T0 + dt.timedelta(hours=200), 1.0, 1.0, 1.0, 1.0, 1.0, "")]]
    for i, part in enumerate(cuts):
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part={i}")
    read = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = state.replay(state.stream_indicators(read.withWatermark("ts", "9 hours")), spark, "test-state")
    want = base.compute(spark.createDataFrame(bars, KIND), {"momentum.rsi": {}, "volatility.atr": {}, "volume.session_volume_profile": {}})
    names = {"session_volume_profile_poc": "poc", "session_volume_profile_vah": "vah", "session_volume_profile_val": "val"}
    keys = ["symbol", "ts", "open", "high", "low", "close", "volume"]
    a, b = (d.toPandas().sort_values(keys).reset_index(drop=True) for d in (got, want.withColumnsRenamed(names)))
    assert len(a) == len(b) == len(bars)
    assert (a.symbol.fillna("-") == b.symbol.fillna("-")).all() and (a.ts == b.ts).all()
    for c in (*state.PRICES, *state.MEASURES):
        assert b[c].notna().sum() > 150
        np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=c)


def test_an_empty_stream_has_no_rows_and_the_store_is_put_back(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/in")
    before = spark.conf.get(state.PROVIDER)
    read = spark.readStream.schema(KIND).parquet(f"{tmp_path}/in")
    got = state.replay(state.stream_indicators(read.withWatermark("ts", "1 hour")), spark, "test-state")
    assert got.count() == 0 and spark.conf.get(state.PROVIDER) == before

"""Time slices against whole symbols, and their parts against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import slices
from tapeloom.functions.sheet import Sheet
from tapeloom.operators import base
from tapeloom.plans import registry
from tapeloom.sources import bars as source

SF = "/root/testdata/sf0.001"


def plain(seed, gain, x, y=None):
    out = []
    for s, g, v in zip(seed, gain, x):
        if y is None:
            y = None if np.isnan(s) else s
        elif not (np.isnan(g) or np.isnan(v)):
            y += g * (v - y)
        out.append(np.nan if y is None else y)
    return out


def test_maps_compose_to_the_recursion():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 50, 1000):
        x, gain, seed = rng.normal(100, 5, n), rng.uniform(0, 1, n), rng.normal(100, 5, n)
        x[rng.random(n) < 0.2], gain[rng.random(n) < 0.2], seed[rng.random(n) < 0.7] = np.nan, np.nan, np.nan
        np.testing.assert_allclose(slices.values(seed, gain, x, np.nan), plain(seed, gain, x), rtol=1e-9)
        np.testing.assert_allclose(slices.values(seed, gain, x, 3.0), plain(seed, gain, x, 3.0), rtol=1e-9)
        keep, add = slices.maps(gain, x)
        np.testing.assert_allclose(keep * 3.0 + add, plain(seed, gain, x, 3.0), rtol=1e-9)


def same(a, b):
    order = ["symbol", "ts", "open", "high", "low", "close", "volume"]
    a, b = (d.toPandas().sort_values(order).reset_index(drop=True) for d in (a, b))
    assert list(a.columns) == list(b.columns) and len(a) == len(b) > 0
    for c in a.columns:
        if pd.api.types.is_numeric_dtype(a[c]):
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=c)
        else:
            assert a[c].equals(b[c]), c


@pytest.mark.parametrize("names", [["ma.ema", "ma.tema", "ma.smma", "ma.kama"], ["momentum.rsi", "momentum.macd", "momentum.stochastic"], ["volume.obv", "volatility.atr"]])
def test_slices_equal_whole_symbols_on_bars_with_gaps_ties_and_a_hot_symbol(spark, names):
    names = [n for n in names if n in base.CATALOGUE]
    rng, rows = np.random.default_rng(2), []
    for symbol, n in (("hot", 400), ("b", 30), (None, 25), ("one", 1)):
        for i in range(n):
            p = float(rng.normal(100, 3))
            close = None if rng.random() < 0.05 else p
            rows.append((symbol, f"2024-01-{1 + i // 24 % 28:02d} {i % 24:02d}:00:00", p, p + 1, p - 1, close, float(rng.integers(1, 9)), i))
    rows += rows[10:13]  # bars that repeat
    bars = spark.createDataFrame(rows, "symbol string, ts string, open double, high double, low double, close double, volume double, extra int").withColumn("ts", F.to_timestamp("ts")).repartition(5)
    same(base.compute(bars.drop("extra"), names), base.compute(bars.drop("extra"), names, slice_rows=40))
    got = base.compute(bars, names, slice_rows=40)
    assert "extra" in got.columns and got.count() == len(rows)
    assert base.compute(bars.limit(0), names, slice_rows=40).count() == 0


def test_no_task_gets_more_than_its_slices(spark):
    bars = source.delivery_ticks(spark, SF, each=2)
    sheet = Sheet({f.name: f.dataType.simpleString() for f in bars.schema})
    scratch = slices.Scratch(spark, "test")
    placed = slices.ranked(bars, sheet, scratch)
    hot = placed.groupBy("symbol").agg(F.count("*").alias("n"), F.min("rn_").alias("a"), F.max("rn_").alias("b"), F.countDistinct("rn_").alias("d")).collect()
    assert all(r.a == 0 and r.b == r.n - 1 and r.d == r.n for r in hot)
    each = max(r.n for r in hot) // 16
    sizes = placed.groupBy("key_", F.expr(f"rn_ div {each}")).count()
    assert sizes.agg(F.max("count")).first()[0] == each


def test_places_follow_the_order_of_the_bars(spark):
    bars = source.event_bars(spark, SF)
    sheet = Sheet({f.name: f.dataType.simpleString() for f in bars.schema})
    rows = slices.ranked(bars, sheet, slices.Scratch(spark, "test")).toPandas().sort_values(["symbol", "rn_"])
    assert (rows.groupby("symbol").ts.diff().dropna() > pd.Timedelta(0)).all()


def test_what_needs_whole_symbols_is_named(spark):
    with pytest.raises(slices.NotSliceable, match="all bars of a symbol"):
        base.compute(source.event_bars(spark, SF), ["ma.mcginley_dynamic"], slice_rows=50)
    assert base.sliceable("ma.ema") and not base.sliceable("ma.hma")


def test_hot_symbol_query_equals_whole_symbols(spark, monkeypatch):
    compute = base.compute
    got = {r.symbol: r for r in registry.QUERIES["hot_symbol_folds"](spark, SF).collect()}
    monkeypatch.setattr(base, "compute", lambda bars, names, slice_rows=None: compute(bars, names))
    want = registry.QUERIES["hot_symbol_folds"](spark, SF).collect()
    assert len(got) == len(want) > 1
    for r in want:
        assert r.bars == got[r.symbol].bars and r.known == got[r.symbol].known
        np.testing.assert_allclose([r.ema, r.smma, r.rsi], [got[r.symbol][c] for c in ("ema", "smma", "rsi")], atol=2e-4)

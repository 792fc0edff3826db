"""Recursions over bars that tasks make of shorter rows, against plain loops and against the sheet over the bars themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import grown, scratch
from tapeloom.operators import base
from tapeloom.plans import registry
from tapeloom.sources import bars as source

SF = "/root/testdata/sf0.001"
MEASURES = {"ema": grown.ema(20), "smma": grown.smma(14), "rsi": grown.rsi(14)}
NAMES = {"ma.ema": {"length": 20}, "ma.smma": {"length": 14}, "momentum.rsi": {}}


def plain(x, fold, y, least):
    out, run = [], 0
    for i, v in enumerate(x):
        run = 0 if np.isnan(v) else run + 1
        if i >= least:
            if np.isnan(y):
                y = np.mean(x[i - fold.seed + 1 : i + 1]) if run >= fold.seed else y
            elif not np.isnan(v):
                y += fold.gain * (v - y)
            out.append(y)
    return out


@pytest.mark.parametrize("fold", [grown.Fold(2 / 21), grown.Fold(1 / 14, 14), grown.Fold(1.0), grown.Fold(0.001, 3)])
def test_states_and_maps_are_those_of_a_plain_loop(fold):
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 13, 14, 15, 100, 3000):
        for gaps in (0, 0.03, 0.5, 1):
            x = np.where(rng.random(n) < gaps, np.nan, rng.normal(100, 5, n))
            for least in (0, 5, 14):
                if n < least:
                    continue
                for y in (np.nan, 42.0):
                    np.testing.assert_allclose(grown.walk(x, fold, y, least), plain(x, fold, y, least), rtol=1e-9)
                keep, add, fresh = grown.body_map(x, fold, least)
                np.testing.assert_allclose(keep * 42.0 + add, [42.0, *plain(x, fold, 42.0, least)][-1], rtol=1e-9)
                np.testing.assert_allclose(fresh, [np.nan, *plain(x, fold, np.nan, least)][-1], rtol=1e-9)


def of_bars(bars):
    got = base.compute(bars, NAMES)
    return {r.symbol: r for r in got.groupBy("symbol").agg(F.count("*").alias("bars"), F.count("rsi").alias("known"), *(F.avg(c).alias(c) for c in MEASURES)).collect()}


@pytest.mark.parametrize(("each", "slice_rows"), [(16, 1), (16, 40), (3, 1), (1, 10), (16, 1 << 18)])
def test_odd_rows_give_what_their_bars_give(spark, each, slice_rows, monkeypatch):
    rng, rows = np.random.default_rng(each), []
    for symbol, n in (("hot", 400), ("b", 9), (None, 40), ("", 1), ("none", 12)):
        for _ in range(n):
            value = None if rng.random() < 0.1 or symbol == "none" else float(rng.integers(1000, 1020))
            rows.append((symbol, None if rng.random() < 0.03 else int(rng.integers(-3000, 3000)) * 60, value))
    rows += rows[:5]  # rows that repeat
    rows += [("edge", k * grown.CELL + d * 60, 1000.0 + d) for k in range(-2, 3) for d in range(-9, 9)]  # bars over the edges of cells
    few = spark.createDataFrame(rows, "symbol string, at long, value double").withColumn("volume", F.lit(1.0)).repartition(3)
    want = of_bars(source.ticks(few, each))
    for most in (grown.FEW_CELLS, 0):  # with cells at all tasks, and by a join of both sides
        monkeypatch.setattr(grown, "FEW_CELLS", most)
        got = {r.symbol: r for r in grown.summed(few, source.delivery_growth(each), MEASURES, slice_rows).collect()}
        assert got.keys() == want.keys() == {"hot", "b", None, "", "none", "edge"}
        for symbol, w in want.items():
            g = got[symbol]
            assert (g.bars, g.n_rsi) == (w.bars, w.known), symbol
            for c in MEASURES:
                assert (g[f"n_{c}"] == 0) == (w[c] is None), (symbol, c)
                if w[c] is not None:
                    np.testing.assert_allclose(g[f"sum_{c}"] / g[f"n_{c}"], w[c], rtol=1e-9, err_msg=f"{symbol} {c}")
    assert grown.summed(few.limit(0), source.delivery_growth(each), MEASURES).count() == 0


def test_the_hot_symbol_query_writes_no_bars_and_equals_whole_symbols(spark, monkeypatch):
    cut, written = scratch.Scratch.cut, []

    def counted(self, df, tag):
        out = cut(self, df, tag)
        written.append(out.count())
        return out

    monkeypatch.setattr(scratch.Scratch, "cut", counted)
    got = registry.QUERIES["hot_symbol_folds"](spark, SF).collect()
    rows = source.deliveries(spark, SF).count()
    assert max(written) < rows  # one row stands for 16 bars
    want = of_bars(source.delivery_ticks(spark, SF))
    assert sum(r.bars for r in got) == 16 * rows and {r.symbol for r in got} == want.keys()
    for r in got:
        w = want[r.symbol]
        assert (r.bars, r.known) == (w.bars, w.known)
        np.testing.assert_allclose([r.ema, r.smma, r.rsi], [w.ema, w.smma, w.rsi], atol=6e-5)

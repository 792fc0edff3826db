"""Order statistics of sliding windows against NumPy, and their cost against the window's length."""

import time

import numpy as np
import pytest

from tapeloom.functions import ordered
from tapeloom.operators import base
from tapeloom.plans import registry  # noqa: F401 (fills the catalogue)
from tapeloom.sources import bars as source

MEASURES = (("quantile", 0.3), ("quantile", 1.0), ("below",), ("same",), ("deviation",))


@pytest.mark.parametrize("n", [1, 2, 3, 8, 70])
def test_windows_equal_numpy_over_stretches_ties_and_gaps(n):
    rng = np.random.default_rng(n)
    x = [None if rng.random() < 0.01 else float(v) for v in rng.integers(0, 30, 500) / 3]
    step, got, at = ordered.window(n, MEASURES)(), [[] for _ in MEASURES], 0
    while at < len(x):
        k = int(rng.integers(1, 90))
        for g, o in zip(got, step(x[at : at + k])):
            g += o
        at += k
    for i in range(len(x)):
        w = x[max(0, i - n + 1) : i + 1]
        if len(w) < n or None in w:
            assert all(g[i] is None for g in got)
        else:
            w = np.array(w)
            want = [np.quantile(w, 0.3), w.max(), (w < w[-1]).sum(), (w == w[-1]).sum(), np.median(abs(w - np.median(w)))]
            np.testing.assert_allclose([g[i] for g in got], want, rtol=1e-12, atol=1e-12)


def test_a_missing_column_has_no_statistics():
    assert ordered.window(3, MEASURES)()([None] * 5) == [[None] * 5] * len(MEASURES)


def test_cost_hardly_grows_with_the_window():
    x = np.random.default_rng(3).normal(size=20_000).tolist()

    def took(n):
        step, began = ordered.window(n, (("quantile", 0.5), ("below",)))(), time.process_time()
        step(x)
        return time.process_time() - began

    took(20)
    assert min(took(5000), took(5000)) < 4 * min(took(20), took(20))


def test_long_windows_go_through_the_pass_and_equal_short_ones_way(spark, monkeypatch):
    bars = source.event_bars(spark, "/root/testdata/sf0.001")
    asked = {"stats.quantile": {"q": 0.2, "length": 70}, "stats.median_absolute_deviation": {"length": 71}, "stats.percentile_rank": {"length": 70}, "volatility.atr_percentile": {"lookback": 66}}
    long = base.compute(bars, asked)
    assert "MapInArrow" in long._jdf.queryExecution().toString()
    rows = long.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    from tapeloom.operators import statistics

    for module in (ordered, statistics):
        monkeypatch.setattr(module, "LONG_WINDOW", 10**9)
    want = base.compute(bars, asked).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    for c in ("quantile", "median_absolute_deviation", "percentile_rank", "atr_percentile"):
        assert want[c].notna().sum() > 20
        np.testing.assert_allclose(rows[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True)


def test_zones_that_wait_for_their_horizon_equal_those_of_the_whole_symbol(spark, monkeypatch):
    from tapeloom.functions import sheet

    bars = source.event_bars(spark, "/root/testdata/sf0.001")
    asked = [n for n in base.CATALOGUE if n.startswith("smc.") and not base.CATALOGUE[n].needs_bench and ("ob" in n or "fvg" in n)]
    s = sheet.Sheet({f.name: f.dataType.simpleString() for f in bars.schema})
    for n in asked:
        base.columns(s, n)
    late = [m for m in s.machines if m.ahead]
    assert late and not any(m.whole for m in late)
    want = base.compute(bars, asked).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)  # a symbol is one chunk
    monkeypatch.setattr(sheet, "CHUNK", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        rows = base.compute(bars, asked).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == len(want) and list(rows.columns) == list(want.columns)
    for c in want.columns:
        assert rows[c].equals(want[c]), c


def test_held_rows_are_bounded():
    import pyarrow as pa

    from tapeloom.functions.sheet import CHUNK, Delayed, Machine

    seen = Machine(1, lambda: lambda x: [[sum(x[max(0, i - 3) : i + 6]) for i in range(len(x))]], ["x"], ["y"], reach=3, ahead=5)
    d, out, most, n = Delayed([seen], [["x"]], CHUNK), [], 0, 5 * CHUNK
    for at in range(0, n, 1000):
        for b in d.push(pa.RecordBatch.from_arrays([pa.array(range(at, min(n, at + 1000)))], names=["x"])):
            out += b.column(1).to_pylist()
        most = max(most, d.size)
    out += [v for b in d.rest() for v in b.column(1).to_pylist()]
    assert most <= CHUNK + 1000 + 8
    assert out == [float(sum(range(max(0, i - 3), min(n, i + 6)))) for i in range(n)]

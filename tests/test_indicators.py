"""Indicators against plain recurrences, their properties, and bars that are odd."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tapeloom.operators import base, smart_money, statistics, volume
from tapeloom.plans import registry  # noqa: F401  (fills the catalogue)

T0 = dt.datetime(2024, 1, 1)
KIND = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def make(closes, symbol="A", spread=1.0, volumes=None, step=3600):
    rows, before = [], closes[0] if closes else 0
    for i, c in enumerate(closes):
        o = before if c is not None and before is not None else c
        hi, lo = (max(o, c) + spread, min(o, c) - spread) if c is not None else (None, None)
        rows.append((symbol, T0 + dt.timedelta(seconds=step * i), o, hi, lo, c, float(volumes[i] if volumes else 100 + i % 7)))
        before = c if c is not None else before
    return rows


def walk(n, seed=1, start=100.0):
    return (start + np.cumsum(np.random.default_rng(seed).normal(0, 1, n))).round(3).tolist()


def run(spark, rows, names):
    return base.compute(spark.createDataFrame(rows, KIND), names).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def table(spark):
    names = ["ma.ema", "ma.wma", "ma.kama", "ma.hma", "ma.vidya", "momentum.rsi", "momentum.macd", "momentum.stochastic", "momentum.cci", "volatility.atr", "volatility.bollinger_bands", "volatility.supertrend", "volume.obv", "volume.money_flow_index", "stats.rolling_regression", "stats.rolling_kurtosis", "stats.percentile_rank", "volume.klinger_oscillator"]
    rows = make(walk(150)) + make(walk(90, 2), "B")
    return pd.DataFrame(rows, columns=KIND.replace(",", "").split()[::2]), run(spark, rows, names)


def close(got, want):
    np.testing.assert_allclose(got.to_numpy(float), np.asarray(want, float), rtol=1e-9, atol=1e-9, equal_nan=True)


def each(table, f):
    bars, got = table
    for s in ("A", "B"):
        f(bars[bars.symbol == s].reset_index(drop=True), got[got.symbol == s].reset_index(drop=True))


def wilder(x, n):
    out, y = [], None
    for i, v in enumerate(x):
        good = [w for w in x[max(0, i - n + 1) : i + 1] if w == w]
        y = (np.mean(good) if len(good) == n else None) if y is None else y if v != v else y + (v - y) / n
        out.append(np.nan if y is None else y)
    return np.array(out)


def test_averages_follow_their_recurrences(table):
    def check(b, g):
        c = b.close
        close(g.ema, c.ewm(span=14, adjust=False, min_periods=14).mean())
        close(g.wma, c.rolling(14).apply(lambda w: (w * np.arange(1, 15)).sum() / 105, raw=True))
        er = ((c - c.shift(10)).abs() / c.diff().abs().rolling(10).sum()).fillna(0)
        sc, y, out = (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2, None, []
        for i, v in enumerate(c):
            y = (v if i >= 9 else None) if y is None else y + sc[i] * (v - y)
            out.append(np.nan if y is None else y)
        close(g.kama, out)

    each(table, check)


def test_oscillators_follow_their_definitions(table):
    def check(b, g):
        d = b.close.diff()
        up, down = wilder(d.clip(lower=0).tolist(), 14), wilder((-d).clip(lower=0).tolist(), 14)
        close(g.rsi, 100 - 100 / (1 + up / down))
        fast, slow = (b.close.ewm(span=n, adjust=False, min_periods=n).mean() for n in (12, 26))
        close(g.macd_macd, fast - slow)
        before = b.close.shift()
        tr = pd.concat([b.high - b.low, (b.high - before).abs(), (b.low - before).abs()], axis=1).max(axis=1)
        tr[0] = np.nan
        close(g.atr, wilder(tr.tolist(), 14))
        close(g.obv, (np.sign(d).fillna(0) * b.volume).cumsum())
        tp = (b.high + b.low + b.close) / 3
        mad = tp.rolling(20).apply(lambda w: np.abs(w - w.mean()).mean(), raw=True)
        close(g.cci, (tp - tp.rolling(20).mean()) / (0.015 * mad))

    each(table, check)


def test_rolling_statistics_follow_pandas(table):
    def check(b, g):
        close(g.bollinger_bands_upper, b.close.rolling(20).mean() + 2 * b.close.rolling(20).std())
        close(g.rolling_kurtosis, b.close.rolling(20).kurt())
        close(g.percentile_rank, b.close.rolling(20).rank(pct=True) * 100)
        close(g.rolling_regression_slope, b.close.rolling(14).apply(lambda w: np.polyfit(range(14), w, 1)[0], raw=True))

    each(table, check)


def test_bounds_hold(table):
    _, g = table
    assert g.rsi.dropna().between(0, 100).all() and g.money_flow_index.dropna().between(0, 100).all() and g.stochastic_k.dropna().between(0, 100).all()
    b = g.dropna(subset=["bollinger_bands_upper"])
    assert (b.bollinger_bands_lower <= b.bollinger_bands_middle).all() and (b.bollinger_bands_middle <= b.bollinger_bands_upper).all()
    s = g.dropna(subset=["supertrend_supertrend"])
    assert ((s.supertrend_trend > 0) == (s.supertrend_supertrend == s.supertrend_lower_band)).all() and set(s.supertrend_trend) <= {1.0, -1.0}


def test_symbols_do_not_touch_and_order_does_not_matter(spark, table):
    alone = run(spark, make(walk(90, 2), "B")[::-1], ["ma.ema", "momentum.rsi", "volatility.supertrend"])
    both = table[1][table[1].symbol == "B"].reset_index(drop=True)
    for c in ("ema", "rsi", "supertrend_supertrend"):
        close(alone[c], both[c])


def test_constant_rising_and_falling_prices(spark):
    rows = make([50.0] * 60, "C") + make([float(i) for i in range(1, 61)], "R") + make([float(i) for i in range(100, 40, -1)], "F")
    g = run(spark, rows, ["momentum.rsi", "stats.z_score", "stats.entropy", "volatility.bollinger_width", "stats.rolling_regression"]).groupby("symbol").last()
    assert g.rsi["C"] == 50 and g.rsi["R"] == 100 and g.rsi["F"] == 0
    assert np.isnan(g.z_score["C"]) and g.entropy["C"] == 0 and g.bollinger_width["C"] == 0 and g.rolling_regression_r2["C"] == 1
    assert abs(g.rolling_regression_slope["R"] - 1) < 1e-9


def test_short_empty_and_gappy_bars(spark):
    names = [n for n, i in base.CATALOGUE.items() if not i.needs_bench and n.split(".")[0] in ("ma", "volume", "smc")]
    one = run(spark, make([5.0]), names)
    assert len(one) == 1 and one["sma"].isna().all()
    assert base.compute(spark.createDataFrame([], KIND), names).count() == 0
    gappy = walk(60, 3)
    gappy[20] = gappy[21] = None
    flat = make(gappy, volumes=[0] * 60)
    g = run(spark, flat, ["ma.sma", "ma.ema", "volume.vwap", "volume.chaikin_money_flow", "smc.smart_money_score", "sr.order_blocks"])
    assert len(g) == 60 and g.vwap.isna().all() and g.sma[22:33].isna().all() and g.ema[22:].notna().all()


def test_parameters_offsets_and_errors(spark):
    rows = make(walk(40))
    g = run(spark, rows, {"ma.sma": {"length": 5, "offset": 2, "fillna": -1.0}, "ma.ema": {"length": 3, "source": "hlc3"}})
    want = pd.Series([r[5] for r in rows]).rolling(5).mean().shift(2).fillna(-1)
    close(g.sma, want)
    for bad in ({"length": 0}, {"length": 2.5}, {"length": True}, {"source": "none"}):
        with pytest.raises(base.IndicatorError):
            run(spark, rows, {"ma.sma": bad})


def test_confirmed_swings_do_not_look_ahead(spark):
    rows = make(walk(80, 4))
    a = run(spark, rows, ["sr.confirmed_swing_high", "pattern.calculate_patterns", "sr.smc_structure"])
    b = run(spark, rows[:60], ["sr.confirmed_swing_high", "pattern.calculate_patterns", "sr.smc_structure"])
    for c in b.columns:
        assert a[c][:60].astype(str).tolist() == b[c].astype(str).tolist(), c


def jumpy(n=400, seed=8):
    """Bars with runs, gaps and bursts of volume, on which gaps, blocks and sweeps come and go."""
    rng = np.random.default_rng(seed)
    rows, c = [], 100.0
    for i in range(n):
        jump = rng.random() < 0.12
        step = float(rng.normal(0, 0.6)) + (float(rng.choice([-1, 1])) * 5 if jump else 0.0)
        o = c + (0.6 * step if jump else 0.0)
        c = max(20.0, o + (0.8 * step if jump else step))
        hi, lo = max(o, c) + abs(float(rng.normal(0, 0.3))), min(o, c) - abs(float(rng.normal(0, 0.3)))
        rows.append(("J", T0 + dt.timedelta(hours=i), round(o, 2), round(hi, 2), round(lo, 2), round(c, 2), float(rng.integers(50, 100) * (6 if jump else 1))))
    return rows


def test_machines_equal_their_sql_where_everything_happens(spark):
    """Gaps, blocks and sweeps: the Python machines against recursive SQL, on bars on which all of their states come up."""
    import duckdb

    names = [n for n, i in base.CATALOGUE.items() if i.recursive and not i.needs_bench]
    rows = jumpy(600, 9)
    rows[50] = (*rows[50][:5], None, rows[50][6])
    got = run(spark, rows, names)
    bars = pd.DataFrame(rows, columns=KIND.replace(",", "").split()[::2])  # noqa: F841  (read by name)
    want = duckdb.sql(base.sql("SELECT * FROM bars", names)).df().sort_values(["symbol", "ts"]).reset_index(drop=True)
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns[7:]:
        if got[c].dtype == bool or want[c].dtype == bool:
            assert (got[c].astype(bool) == want[c].astype(bool)).all(), c
        elif got[c].dtype == object:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c
        else:
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=c)
    for c in ("active_fvg", "mitigated_fvg", "filled_fvg", "inverse_fvg", "mitigation_block", "invalidated_order_block", "market_structure_shift", "liquidity_sweep"):
        assert got[c].astype(float).nunique() > 1, c


def test_features_equal_their_sql_and_every_prefix(spark):
    """A bar's features don't depend on what follows, and the analyses built on them don't either."""
    import duckdb

    from tapeloom.plans import analyzers, features

    rows = jumpy(260)
    made = features.features(spark.createDataFrame(rows, KIND)).toPandas().sort_values("ts").reset_index(drop=True)
    bars = pd.DataFrame(rows, columns=KIND.replace(",", "").split()[::2])  # noqa: F841
    want = duckdb.sql(features.features_sql("SELECT * FROM bars")).df().sort_values("ts").reset_index(drop=True)
    for c in ("fvg", "fvg_active", "ob_active", "order_block", "ob_age", "breaker_block", "bos", "choch", "liq_sweep", "smart_money_score"):
        np.testing.assert_allclose(made[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=c)
    assert all(made[c].nunique() > 1 for c in ("fvg", "fvg_active", "bos", "choch", "liq_sweep", "smart_money_score"))
    for k in (120, 199):
        part = features.features(spark.createDataFrame(rows[:k], KIND)).toPandas().sort_values("ts").reset_index(drop=True)
        for c in part.columns:
            a, b = made[c][:k], part[c]
            if a.dtype == object or a.dtype == bool:
                assert a.astype(str).tolist() == b.astype(str).tolist(), c
            else:
                np.testing.assert_allclose(a.astype(float, errors="ignore"), b.astype(float, errors="ignore"), rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=c) if c != "ts" else None
    table = spark.createDataFrame(rows, KIND)
    for name in ("trend", "support_resistance"):
        whole = analyzers.analyze(features.features(table), name, latest=False, evidence=False).where(f"ts = '{rows[149][1]}'").drop("ts").first()
        last = analyzers.analyze(features.features(spark.createDataFrame(rows[:150], KIND)), name, evidence=False).drop("ts").first()
        assert whole == last, name


def test_supertrend_begins_on_the_side_of_the_close(spark):
    rows = [("F", T0 + dt.timedelta(hours=i), 100.0 - i, 100.5 - i, 98.0 - i, 98.2 - i, 10.0) for i in range(40)]
    rows += [("R", T0 + dt.timedelta(hours=i), 100.0 + i, 102.0 + i, 99.5 + i, 101.8 + i, 10.0) for i in range(40)]
    g = run(spark, rows, ["volatility.supertrend", "volatility.atr"])
    for symbol, side, band in (("F", -1, "upper_band"), ("R", 1, "lower_band")):
        own = g[(g.symbol == symbol) & g.supertrend_supertrend.notna()]
        assert len(own) > 20 and (own.supertrend_trend == side).all() and (own.supertrend_supertrend == own[f"supertrend_{band}"]).all()


def test_vidya_takes_a_missing_price_as_unchanged(spark):
    closes = [100.0 + 0.001 * (i % 3) for i in range(40)]
    gappy = list(closes)
    gappy[20] = None
    a, b = (run(spark, make(x), ["ma.vidya"]).vidya for x in (closes, gappy))
    assert np.isnan(b[20]) and abs(a - b)[21:].max() < 0.002
    held, y, out = pd.Series(closes), None, []
    step = held.diff().fillna(held[0])
    up, down = step.clip(lower=0).rolling(9).sum(), (-step).clip(lower=0).rolling(9).sum()
    cmo = ((up - down).abs() / (up + down)).fillna(0)
    for i, v in enumerate(closes):
        y = None if i < 8 else v if y is None else y + 0.2 * cmo[i] * (v - y)
        out.append(np.nan if y is None else y)
    close(a, out)


def test_long_folds_equal_short_ones():
    from tapeloom.functions import sheet

    rng = np.random.default_rng(2)
    x = [None if r < 0.05 else float(v) for r, v in zip(rng.random(9000), rng.normal(0, 1, 9000))]
    gains = [None if r < 0.02 else float(r) for r in rng.random(9000)]
    for seed, gain in ((x, 0.1), ([None] * 500 + x[500:], gains), ([None] * 9000, 0.5), (x, 1.0)):
        for y in (None, 3.0):
            a, ya = sheet._folded_in_blocks(seed, gain, x, y)
            b, yb = [], y
            for k in range(0, 9000, 1000):
                got, yb = sheet.folded(seed[k : k + 1000], gain if isinstance(gain, float) else gain[k : k + 1000], x[k : k + 1000], yb)
                b += got
            assert [v is None for v in a] == [v is None for v in b] and (ya is None) == (yb is None)
            np.testing.assert_allclose([v for v in a if v is not None], [v for v in b if v is not None], rtol=1e-9, atol=1e-12)


def test_bars_of_one_time_come_in_one_order(spark):
    rows = make(walk(60)) + [(s, t, o, h, low, c + 0.25, v) for s, t, o, h, low, c, v in make(walk(60))[::3]]
    a, b = (run(spark, r, ["ma.ema", "ma.sma", "momentum.momentum"]).sort_values(["ts", "close"]).reset_index(drop=True) for r in (rows, rows[::-1]))
    for c in ("ema", "sma", "momentum"):
        close(a[c], b[c])


#: one plain formula for each family, over the closes (c), highs (h), lows (l), opens (o) and volumes (v) of one symbol
PLAIN = {
    ("ma.sma", "sma"): lambda o, h, l, c, v: c.rolling(14).mean(),
    ("ma.dema", "dema"): lambda o, h, l, c, v: 2 * c.ewm(span=14, adjust=False).mean() - c.ewm(span=14, adjust=False).mean().where(lambda e: e.index >= 13).ewm(span=14, adjust=False).mean(),
    ("momentum.roc", "roc"): lambda o, h, l, c, v: 100 * (c / c.shift(12) - 1),
    ("momentum.williams_r", "williams_r"): lambda o, h, l, c, v: -100 * (h.rolling(14).max() - c) / (h.rolling(14).max() - l.rolling(14).min()),
    ("momentum.stochastic", "stochastic_k"): lambda o, h, l, c, v: (100 * (c - l.rolling(14).min()) / (h.rolling(14).max() - l.rolling(14).min())).rolling(3).mean(),
    ("volatility.donchian_channel", "donchian_channel_upper"): lambda o, h, l, c, v: h.rolling(20).max(),
    ("volume.obv", "obv"): lambda o, h, l, c, v: (np.sign(c.diff()).fillna(0) * v).cumsum(),
    ("volume.negative_volume_index", "negative_volume_index"): lambda o, h, l, c, v: 1000 * (1 + c.pct_change().where(v < v.shift(), 0).fillna(0)).cumprod(),
    ("stats.z_score", "z_score"): lambda o, h, l, c, v: (c - c.rolling(20).mean()) / c.rolling(20).std(),
    ("stats.rolling_skewness", "rolling_skewness"): lambda o, h, l, c, v: c.rolling(20).skew(),
    ("sr.pivot_point", "pivot_point"): lambda o, h, l, c, v: ((h + l + c) / 3).shift(),
    ("smc.equilibrium", "equilibrium"): lambda o, h, l, c, v: (h.rolling(20).max() + l.rolling(20).min()) / 2,
    ("smc.delta_proxy", "delta_proxy"): lambda o, h, l, c, v: v * ((c - l) - (h - c)) / (h - l),
}


def test_families_follow_plain_formulas(spark):
    rows = make(walk(160, 12))
    names = [n for n, _ in PLAIN if n in base.CATALOGUE]
    g = run(spark, rows, names)
    b = pd.DataFrame(rows, columns=KIND.replace(",", "").split()[::2])
    checked = 0
    for (name, column), f in PLAIN.items():
        if name in names:
            want = f(b.open, b.high, b.low, b.close, b.volume)
            at = g[column].notna() & want.notna()
            assert at.sum() > 100, name
            np.testing.assert_allclose(g[column][at].astype(float), want[at], rtol=1e-8, atol=1e-8, err_msg=name)
            checked += 1
    assert checked >= 11


def test_a_bullish_gap_is_met_and_filled():
    item = [1, smart_money.FRESH, 10.0, 8.0]
    smart_money._meet(item, 9.0, 9.5, True)
    assert item[1:3] == [smart_money.MITIGATED, 9.0]
    smart_money._meet(item, 7.9, 8.5, True)
    assert item[1] == smart_money.FILLED
    block = [-1, smart_money.FRESH, 8.0, 10.0]
    smart_money._meet(block, 9.0, 8.5, False)
    assert block[1] == smart_money.MITIGATED
    smart_money._meet(block, 11.0, 10.5, False)
    assert block[1] == smart_money.INVERTED
    smart_money._meet(block, 9.0, 7.5, False)
    assert block[1] == smart_money.RECLAIMED


def test_value_area_grows_downwards_on_ties():
    edges = np.linspace(0, 5, 6)
    assert volume.profile(edges, np.array([1.0, 4.0, 5.0, 4.0, 1.0])) == (2.5, 4.0, 0.0, 2.5, 0.5)


def test_kendall_counts_pairs():
    rng = np.random.default_rng(3)
    for _ in range(30):
        x, y = rng.integers(0, 6, (2, 25)).astype(float)
        c = sum(np.sign((x[i] - x[j]) * (y[i] - y[j])) for i in range(25) for j in range(i))
        nx, ny = (sum(v[i] != v[j] for i in range(25) for j in range(i)) for v in (x, y))
        assert abs(statistics.kendall(x, y) - c / np.sqrt(float(nx) * ny)) < 1e-12


def test_double_top_is_found(spark):
    closes = [100 + 2 * i for i in range(12)] + [122 - 2 * i for i in range(1, 9)] + [106 + 2 * i for i in range(1, 9)] + [122 - 2 * i for i in range(1, 12)]
    rows = [("A", T0 + dt.timedelta(hours=i), float(c), c + 1.0, c - 1.0, float(c), 10.0) for i, c in enumerate(closes)]
    g = run(spark, rows, ["pattern.calculate_patterns"])
    assert (g.calculate_patterns_double_top_detected == 1).sum() == 1 and "Reversal" in set(g.calculate_patterns_pattern_family)

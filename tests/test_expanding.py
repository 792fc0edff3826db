"""Expanding accumulators over ranges of rows against walking each whole series."""

import datetime as dt
import random
from math import isfinite

import numpy as np
import pytest

from tapeloom.functions import expanding, series

T0 = dt.datetime(2024, 3, 1)
KIND = "symbol string, ts timestamp, close double, `a.b` string"
MADE = {"var": ("close", expanding.VARIANCE), "fall": ("close", expanding.DRAWDOWN), "rise": ("close", expanding.LONGEST_RISE)}


def _rows():
    rng, out = random.Random(8), []
    for symbol, n in (("A", 300), ("B", 20), (None, 40), ("C", 1)):
        for i in range(n):
            x = rng.choice([None, float("nan"), float("inf")]) if rng.random() < 0.1 else rng.uniform(1, 9)
            out.append((symbol, T0 + dt.timedelta(minutes=i // 2), x, str(i)))
    return out


def _plain(values, least):
    seen, out = [], []
    for x in values:
        if x is not None and isfinite(x):
            seen.append(x)
        if len(seen) < least:
            out.append((None,) * 3)
            continue
        high = np.maximum.accumulate(seen)
        run = best = 1
        for p, q in zip(seen, seen[1:]):
            run = run + 1 if q > p else 1
            best = max(best, run)
        out.append((np.var(seen, ddof=1) if len(seen) > 1 else None, max(1 - np.array(seen) / high), best))
    return out


@pytest.mark.parametrize("ranges", [1, 9])
def test_measures_equal_walking_the_whole_series(spark, ranges):
    df = spark.createDataFrame(_rows(), KIND)
    got = expanding.accumulate(df, MADE, least=2, ranges=ranges)
    assert got.columns == [*df.columns, *MADE]
    rows = {}
    for r in got.collect():
        rows.setdefault(r.symbol, []).append(r)
    want = {}
    for r in _rows():
        want.setdefault(r[0], []).append(r)
    assert {k: len(v) for k, v in rows.items()} == {k: len(v) for k, v in want.items()}
    rank = lambda x: (x is not None, x is not None and x != x, x if x is not None and x == x else 0.0)  # noqa: E731 (null, number, NaN)
    for symbol, found in rows.items():
        whole = sorted(want[symbol], key=lambda r: (r[1], rank(r[2])))
        by_row = {(r.ts, r["a.b"]): r for r in found}
        for r, w in zip(whole, _plain([r[2] for r in whole], 2)):
            for c, v in zip(MADE, w):
                x = by_row[r[1], r[3]][c]
                assert (x is None) == (v is None) and (v is None or abs(x - v) < 1e-9), (symbol, r, c)


def test_any_cut_merges_to_the_same_state():
    rng = random.Random(2)
    for _, a in MADE.values():
        x = [float(rng.randrange(1, 6)) for _ in range(40)]
        ends = []
        for cut in range(41):
            sides = []
            for part in (x[:cut], x[cut:]):
                s = a.init()
                for v in part:
                    s = a.step(s, v)
                sides.append(s)
            ends.append(a.value(a.merge(*sides)))
        np.testing.assert_allclose(ends, ends[0], rtol=1e-12)


def test_empty_tables_and_taken_names(spark):
    df = spark.createDataFrame([], KIND)
    assert expanding.accumulate(df, MADE).count() == 0
    with pytest.raises(ValueError):
        expanding.accumulate(df, {"close": MADE["var"]})


def test_expanding_apply_takes_an_accumulator(spark):
    df = spark.createDataFrame([("A", T0 + dt.timedelta(hours=i), float(v), "") for i, v in enumerate((5, 6, 3, 4))], KIND)
    rows = series.expanding_apply(df, "close", expanding.DRAWDOWN, "fall").orderBy("ts").collect()
    assert [r.fall for r in rows] == [0.0, 0.0, 0.5, 0.5]

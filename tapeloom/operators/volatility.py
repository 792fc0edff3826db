"""Volatility, bands and trailing stops (names volatility.*)."""

from __future__ import annotations

from math import log

from tapeloom.functions.sheet import Sheet

from .averages import ema_raw, weighted, wilder
from .base import alias, indicator, positive, price
from .momentum import rate, true_range


@indicator("volatility.true_range")
def true_range_(s: Sheet) -> str:
    return true_range(s)


@indicator("volatility.atr")
def atr(s: Sheet, length: int = 14) -> str:
    return wilder(s, true_range(s), positive(length))


@indicator("volatility.natr")
def natr(s: Sheet, length: int = 14) -> str:
    return s.put(f"100 * {s.div(atr(s, length), 'close')}")


@indicator("volatility.bollinger_bands")
def bollinger_bands(s: Sheet, length: int = 20, std_mult: float = 2.0, source: str = "close") -> dict[str, str]:
    x = price(s, source)
    mean, std = s.roll("avg", x, positive(length)), s.roll("stddev_samp", x, length)
    return {"upper": s.put(f"{mean} + {std_mult!r} * {std}"), "middle": mean, "lower": s.put(f"{mean} - {std_mult!r} * {std}")}


@indicator("volatility.bollinger_width")
def bollinger_width(s: Sheet, length: int = 20, std_mult: float = 2.0, percentage: bool = True, source: str = "close") -> str:
    b = bollinger_bands(s, length, std_mult, source)
    return s.put(f"{100.0 if percentage else 1.0} * {s.div(f'{b['upper']} - {b['lower']}', b['middle'])}")


@indicator("volatility.bollinger_percent_b")
def bollinger_percent_b(s: Sheet, length: int = 20, std_mult: float = 2.0, source: str = "close") -> str:
    b = bollinger_bands(s, length, std_mult, source)
    return s.put(s.div(f"{price(s, source)} - {b['lower']}", f"{b['upper']} - {b['lower']}"))


@indicator("volatility.donchian_channel")
def donchian_channel(s: Sheet, length: int = 20) -> dict[str, str]:
    up, low = s.roll("max", "high", positive(length)), s.roll("min", "low", length)
    return {"upper": up, "middle": s.put(f"({up} + {low}) / 2"), "lower": low}


@indicator("volatility.keltner_channel")
def keltner_channel(s: Sheet, length: int = 20, atr_length: int = 10, mult: float = 2.0, source: str = "close") -> dict[str, str]:
    mid, width = ema_raw(s, price(s, source), positive(length)), atr(s, atr_length)
    return {"upper": s.put(f"{mid} + {mult!r} * {width}"), "middle": mid, "lower": s.put(f"{mid} - {mult!r} * {width}")}


def log_ratio(s: Sheet, a: str, b: str) -> str:
    a, b = s.put(a), s.put(b)
    return s.put(f"CASE WHEN {a} > 0 AND {b} > 0 THEN ln({a} / {b}) END")


@indicator("volatility.historical_volatility")
def historical_volatility(s: Sheet, length: int = 20, annualization: float = 252.0, source: str = "close") -> str:
    x = price(s, source)
    return s.put(f"{s.roll('stddev_samp', log_ratio(s, x, s.lag(x)), positive(length))} * sqrt({annualization!r}) * 100")


@indicator("volatility.chaikin_volatility")
def chaikin_volatility(s: Sheet, length: int = 10, roc_length: int = 10) -> str:
    return rate(s, ema_raw(s, "high - low", positive(length)), positive(roc_length))


@indicator("volatility.ulcer_index")
def ulcer_index(s: Sheet, length: int = 14, source: str = "close") -> str:
    x = price(s, source)
    top = s.roll("max", x, positive(length))
    fall = s.put(f"100 * {s.div(f'{x} - {top}', top, '0.0')}")
    return s.put(f"sqrt({s.roll('avg', f'{fall} * {fall}', length)})")


@indicator("volatility.standard_deviation")
def standard_deviation(s: Sheet, length: int = 20, source: str = "close") -> str:
    return s.roll("stddev_samp", price(s, source), positive(length))


@indicator("volatility.variance")
def variance(s: Sheet, length: int = 20, source: str = "close") -> str:
    return s.roll("var_samp", price(s, source), positive(length))


@indicator("volatility.mass_index")
def mass_index(s: Sheet, length: int = 25, ema_length: int = 9) -> str:
    one = ema_raw(s, "high - low", positive(ema_length))
    return s.roll("sum", s.put(s.div(one, ema_raw(s, one, ema_length))), positive(length))


@indicator("volatility.volatility_ratio")
def volatility_ratio(s: Sheet, length: int = 14) -> str:
    return s.put(s.div(true_range(s), atr(s, length)))


@indicator("volatility.atr_percentile")
def atr_percentile(s: Sheet, length: int = 14, lookback: int = 100) -> str:
    a = atr(s, length)
    return s.put(f"100.0 * ({' + '.join(s.ranked(a, positive(lookback)))}) / {lookback}")


@indicator("volatility.bollinger_squeeze")
def bollinger_squeeze(s: Sheet, length: int = 20, bb_mult: float = 2.0, kc_mult: float = 1.5, source: str = "close") -> str:
    b, k = bollinger_bands(s, length, bb_mult, source), keltner_channel(s, length, length, kc_mult, source)
    return s.mark(s.flag(f"{b['upper']} < {k['upper']} AND {b['lower']} > {k['lower']}"), "boolean")


@indicator("volatility.expansion_index")
def expansion_index(s: Sheet, length: int = 14) -> str:
    return rate(s, true_range(s), positive(length))


@indicator("volatility.volatility_oscillator")
def volatility_oscillator(s: Sheet, fast_len: int = 14, slow_len: int = 28) -> str:
    a, b = atr(s, fast_len), atr(s, slow_len)
    return s.put(f"100 * {s.div(f'{a} - {b}', b)}")


@indicator("volatility.adaptive_atr")
def adaptive_atr(s: Sheet, length: int = 14, fast_len: int = 2, slow_len: int = 30) -> str:
    tr, n = true_range(s), positive(length)
    fast, slow = 2 / (fast_len + 1), 2 / (slow_len + 1)
    path = s.roll("sum", f"abs({tr} - {s.lag(tr)})", n)
    ratio = s.put(s.div(f"abs({tr} - {s.lag(tr, n)})", path, "0.0"))
    return s.fold(s.put(f"CASE WHEN count({tr}) {s.rows(n)} >= {n} THEN {tr} END"), s.put(f"power({ratio} * {fast - slow!r} + {slow!r}, 2)"), tr)


@indicator("volatility.parkinson_volatility")
def parkinson_volatility(s: Sheet, length: int = 20, annualization: float = 252.0) -> str:
    r = log_ratio(s, "high", "low")
    return s.put(f"sqrt({s.roll('sum', f'{r} * {r}', positive(length))} / {4 * length * log(2)!r}) * sqrt({annualization!r}) * 100")


@indicator("volatility.garman_klass_volatility")
def garman_klass_volatility(s: Sheet, length: int = 20, annualization: float = 252.0) -> str:
    a, b = log_ratio(s, "high", "low"), log_ratio(s, "close", "open")
    mean = s.roll("avg", f"0.5 * {a} * {a} - {2 * log(2) - 1!r} * {b} * {b}", positive(length))
    return s.put(f"CASE WHEN {mean} >= 0 THEN sqrt({mean}) * sqrt({annualization!r}) * 100 END")


def satchell(s: Sheet) -> str:
    return s.put(f"{log_ratio(s, 'high', 'close')} * {log_ratio(s, 'high', 'open')} + {log_ratio(s, 'low', 'close')} * {log_ratio(s, 'low', 'open')}")


@indicator("volatility.rogers_satchell_volatility")
def rogers_satchell_volatility(s: Sheet, length: int = 20, annualization: float = 252.0) -> str:
    mean = s.roll("avg", satchell(s), positive(length))
    return s.put(f"CASE WHEN {mean} >= 0 THEN sqrt({mean}) * sqrt({annualization!r}) * 100 END")


@indicator("volatility.yang_zhang_volatility")
def yang_zhang_volatility(s: Sheet, length: int = 20, annualization: float = 252.0) -> str:
    n = positive(length)
    k = 0.34 / (1.34 + (n + 1) / max(1, n - 1))
    night, day = s.roll("var_samp", log_ratio(s, "open", s.lag("close")), n), s.roll("var_samp", log_ratio(s, "close", s.lag("close")), n)
    total = s.put(f"{night} + {k!r} * {day} + {1 - k!r} * {s.roll('avg', satchell(s), n)}")
    return s.put(f"CASE WHEN {total} >= 0 THEN sqrt({total}) * sqrt({annualization!r}) * 100 END")


@indicator("volatility.choppiness_index")
def choppiness_index(s: Sheet, length: int = 14) -> str:
    total = s.roll("sum", true_range(s), positive(length))
    share = s.put(s.div(total, f"{s.roll('max', 'high', length)} - {s.roll('min', 'low', length)}"))
    return s.put(f"CASE WHEN {share} > 0 THEN 100 * ln({share}) / {log(length)!r} END")


@indicator("volatility.vhf")
def vhf(s: Sheet, length: int = 28, source: str = "close") -> str:
    x = price(s, source)
    return s.put(s.div(f"abs({x} - {s.lag(x, positive(length))})", s.roll("sum", f"abs({x} - {s.lag(x)})", length)))


@indicator("volatility.bb_squeeze_momentum")
def bb_squeeze_momentum(s: Sheet, length: int = 20) -> str:
    n = positive(length)
    off = s.put(f"close - ({donchian_channel(s, n)['middle']} + {s.roll('avg', 'close', n)}) / 2")
    y = weighted(s, s.bfill(off), [(6 * i - 2 * (n + 1)) / (n * (n + 1)) for i in range(1, n + 1)])
    return s.put(f"CASE WHEN {off} IS NOT NULL THEN {y} END")


@indicator("volatility.atr_stop_distance")
def atr_stop_distance(s: Sheet, length: int = 14, mult: float = 3.0) -> str:
    return s.put(f"{mult!r} * {atr(s, length)}")


@indicator("volatility.volatility_stop", machine=True)
def volatility_stop(s: Sheet, length: int = 14, mult: float = 3.0) -> dict[str, str]:
    """Trailing stop that flips sides when the close crosses it; it starts long at the first average range."""

    def make():
        state = {"stop": None, "long": True}

        def step(close, width):
            rows = []
            for c, w in zip(close, width):
                if c is not None and w is not None:
                    side = 1 if state["long"] else -1
                    own = c - side * mult * w
                    stop = own if state["stop"] is None else max(state["stop"] * side, own * side) * side
                    if (c - stop) * side < 0:
                        state["long"], stop = not state["long"], c + side * mult * w
                    state["stop"] = stop
                rows.append((state["stop"], float(state["long"])))
            return list(zip(*rows))

        return step

    def sql(sheet: Sheet, table: str, inputs: list[str], outputs: list[str]) -> str:
        c, w = inputs
        layers = [
            {"ok": f"{c} IS NOT NULL AND {w} IS NOT NULL", "side": "CASE WHEN r_up THEN 1 ELSE -1 END"},
            {"own": f"{c} - side * {mult!r} * {w}"},
            {"held": "CASE WHEN r_stop IS NULL THEN own ELSE side * greatest(side * r_stop, side * own) END"},
            {"turned": f"coalesce(({c} - held) * side < 0, false)"},
            {"n_up": "CASE WHEN ok AND turned THEN NOT r_up ELSE r_up END", "n_stop": f"CASE WHEN NOT ok THEN r_stop WHEN turned THEN {c} + side * {mult!r} * {w} ELSE held END"},
        ]
        return sheet.recursion(table, {"up": "true", "stop": "NULL::DOUBLE"}, layers, {outputs[0]: "n_stop", outputs[1]: "n_up"})

    return s.machine(make, ["close", atr(s, length)], ["stop_price", "is_long"], ("vstop", length, mult), sql=sql)


alias("volatility.atr_trailing_stop", "volatility.volatility_stop", "stop_price")


@indicator("volatility.standard_error")
def standard_error(s: Sheet, length: int = 20, source: str = "close") -> str:
    return s.put(f"{s.roll('stddev_samp', price(s, source), positive(length))} / sqrt({length})")


@indicator("volatility.rei")
def rei(s: Sheet, length: int = 8) -> str:
    """Two-bar range expansion, counted where the bar or the one before reaches into the ranges two bars earlier."""
    h, l, n = (lambda k: s.lag("high", k)), (lambda k: s.lag("low", k)), positive(length)
    meets = s.put(s.flag(f"(high >= {l(2)} OR {h(1)} >= {l(3)}) AND (low <= {h(2)} OR {l(1)} <= {h(3)})"))
    up, down = s.put(f"high - {h(2)}"), s.put(f"low - {l(2)}")
    top = s.roll("sum", f"CASE WHEN {meets} THEN {up} + {down} ELSE 0.0 END", n)
    low_ = s.roll("sum", f"CASE WHEN {meets} THEN abs({up}) + abs({down}) ELSE 0.0 END", n)
    return s.put(f"100 * {s.div(top, low_)}")


for _side in ("upper", "lower", "middle"):
    alias(f"volatility.bollinger_{_side}", "volatility.bollinger_bands", _side)
    alias(f"volatility.donchian_{_side}", "volatility.donchian_channel", _side)
    alias(f"volatility.keltner_{_side}", "volatility.keltner_channel", _side)


@indicator("volatility.supertrend", machine=True)
def supertrend(s: Sheet, length: int = 10, multiplier: float = 3.0) -> dict[str, str]:
    """Bands around the mid price that only tighten while the close before stays inside; the line is the band of the trend.

    The trend begins with the side of the mid price on which the first bar with a range closes; bars without a range carry
    everything on.
    """

    def make():
        state = {"up": None, "low": None, "trend": 1.0, "close": None}

        def step(mid, close, width):
            rows = []
            for m, c, w in zip(mid, close, width):
                before, state["close"] = state["close"], c
                old_up, old_low = state["up"], state["low"]
                if m is not None and w is not None and (old_up is not None or c is not None):
                    up, low = m + multiplier * w, m - multiplier * w
                    if old_up is None:
                        state["trend"] = 1.0 if c > m else -1.0
                    else:
                        up = up if up < old_up or (before is not None and before > old_up) else old_up
                        low = low if low > old_low or (before is not None and before < old_low) else old_low
                        if c is not None and state["trend"] < 0 and c > old_up:
                            state["trend"] = 1.0
                        elif c is not None and state["trend"] > 0 and c < old_low:
                            state["trend"] = -1.0
                    state.update(up=up, low=low)
                rows.append((state["low"] if state["trend"] > 0 else state["up"], state["trend"], state["up"], state["low"]))
            return list(zip(*rows))

        return step

    def sql(sheet: Sheet, table: str, inputs: list[str], outputs: list[str]) -> str:
        m, c, w = inputs
        layers = [
            {"ok": f"{m} IS NOT NULL AND {w} IS NOT NULL AND (r_up IS NOT NULL OR {c} IS NOT NULL)", "bu": f"{m} + {multiplier!r} * {w}", "bl": f"{m} - {multiplier!r} * {w}"},
            {
                "n_up": "CASE WHEN NOT ok THEN r_up WHEN r_up IS NULL OR bu < r_up OR coalesce(r_was > r_up, false) THEN bu ELSE r_up END",
                "n_low": "CASE WHEN NOT ok THEN r_low WHEN r_low IS NULL OR bl > r_low OR coalesce(r_was < r_low, false) THEN bl ELSE r_low END",
                "n_trend": f"CASE WHEN NOT ok THEN r_trend WHEN r_up IS NULL THEN CASE WHEN {c} > {m} THEN 1 ELSE -1 END WHEN r_trend < 0 AND coalesce({c} > r_up, false) THEN 1 WHEN r_trend > 0 AND coalesce({c} < r_low, false) THEN -1 ELSE r_trend END",
                "n_was": c,
            },
        ]
        state = {"up": "NULL::DOUBLE", "low": "NULL::DOUBLE", "trend": "1", "was": "NULL::DOUBLE"}
        return sheet.recursion(table, state, layers, dict(zip(outputs, ("CASE WHEN n_trend > 0 THEN n_low ELSE n_up END", "n_trend", "n_up", "n_low"))))

    return s.machine(make, ["(high + low) / 2", "close", atr(s, length)], ["supertrend", "trend", "upper_band", "lower_band"], ("supertrend", length, multiplier), sql=sql)

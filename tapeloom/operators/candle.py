"""Candle anatomy, single-bar shapes and rolling candle statistics (names candle.*)."""

from __future__ import annotations

from tapeloom.functions.sheet import Sheet

from .averages import ema_raw
from .base import alias, indicator, positive
from .momentum import true_range
from .volume import rank_share

BODY, SPREAD = "abs(close - open)", "(high - low)"
UPPER, LOWER = "(high - greatest(open, close))", "(least(open, close) - low)"
WICKS = f"({UPPER} + {LOWER})"
EPS = "1e-10"


def share(x: str, default: str = "0.0") -> str:
    return Sheet.div(x, SPREAD, default)


#: row-local values
FORMS = {
    "body_size": BODY, "real_body": "close - open", "body_percent": f"100 * {share(BODY)}", "body_midpoint": "(open + close) / 2", "body_ratio": share(BODY), "body_strength": share("close - open"),
    "body_position": share("(open + close) / 2 - low", "0.5"), "upper_wick": UPPER, "lower_wick": LOWER, "wick_size": WICKS, "wick_ratio": share(WICKS), "wick_balance": f"{UPPER} - {LOWER}",
    "wick_strength": share(f"{LOWER} - {UPPER}"), "wick_percent": f"100 * {share(WICKS)}", "candle_range": SPREAD, "buying_pressure": "close - low", "selling_pressure": "high - close",
    "candle_strength": share("close - low", "0.5"), "direction_strength": share("close - open"), "dominance_score": share("(close - low) - (high - close)"),
    "pressure_score": Sheet.div("close - low", "(close - low) + (high - close)", "0.5"), "balance_score": f"1 - {share('abs((close - low) - (high - close))', '1.0')}",
    "close_location_value": share("(close - low) - (high - close)"), "close_percent": f"100 * {share('close - low', '0.5')}", "close_to_high": "high - close", "close_to_low": "close - low",
    "close_position": share("close - low", "0.5"), "open_location": share("(open - low) - (high - open)"), "open_position": share("open - low", "0.5"),
}
#: row-local tests
TESTS = {
    "bullish_body": "close > open", "bearish_body": "close < open", "neutral_candle": f"{BODY} < {EPS}",
    "spinning_top": f"{share(BODY)} <= 0.25 AND {UPPER} > {BODY} AND {LOWER} > {BODY}", "hammer_shape": f"{LOWER} > 2 * {BODY} AND {UPPER} < 0.1 * {SPREAD} AND {BODY} > {EPS}",
    "inverted_hammer_shape": f"{UPPER} > 2 * {BODY} AND {LOWER} < 0.1 * {SPREAD} AND {BODY} > {EPS}",
    "belt_hold": f"(abs(open - low) < {EPS} AND close > low + 0.8 * {SPREAD}) OR (abs(open - high) < {EPS} AND close < high - 0.8 * {SPREAD})",
    "shaven_head": f"{UPPER} < {EPS}", "shaven_bottom": f"{LOWER} < {EPS}", "indecision_candle": f"{share(BODY)} <= 0.25 AND {WICKS} > 2 * {BODY}",
    "absorption_candle": f"{share(BODY)} <= 0.25 AND {LOWER} > 0.5 * {SPREAD} AND close < open",
}


def _form(text: str):
    return lambda s: s.put(text)


def _test(text: str):
    return lambda s: s.mark(s.flag(text), "boolean")


for _name, _text in FORMS.items():
    indicator(f"candle.{_name}")(_form(_text))
for _name, _text in TESTS.items():
    indicator(f"candle.{_name}")(_test(_text))
for _name, _of in (("upper_shadow", "upper_wick"), ("lower_shadow", "lower_wick"), ("body_to_range", "body_ratio"), ("bullish_candle", "bullish_body"), ("bearish_candle", "bearish_body"), ("hanging_man_shape", "hammer_shape"), ("shooting_star_shape", "inverted_hammer_shape")):
    alias(f"candle.{_name}", f"candle.{_of}")


def _limit(name: str, default: float, text: str):
    def build(s: Sheet, threshold: float = default) -> str:
        return s.mark(s.flag(text.format(t=repr(threshold))), "boolean")

    build.__defaults__ = (default,)
    indicator(f"candle.{name}")(build)


_limit("small_body", 0.25, f"{share(BODY)} <= {{t}}")
_limit("large_body", 0.6, f"{share(BODY)} >= {{t}}")
_limit("long_upper_wick", 0.5, f"{UPPER} > {{t}} * {SPREAD}")
_limit("long_lower_wick", 0.5, f"{LOWER} > {{t}} * {SPREAD}")
_limit("small_wick", 0.2, f"{WICKS} < {{t}} * {SPREAD}")
_limit("doji", 0.05, f"{share(BODY)} <= {{t}}")
_limit("dragonfly_doji", 0.05, f"{share(BODY)} <= {{t}} AND {LOWER} > 3 * {UPPER} AND {UPPER} < 0.1 * {SPREAD}")
_limit("gravestone_doji", 0.05, f"{share(BODY)} <= {{t}} AND {UPPER} > 3 * {LOWER} AND {LOWER} < 0.1 * {SPREAD}")
_limit("long_legged_doji", 0.05, f"{share(BODY)} <= {{t}} AND {UPPER} > 0.3 * {SPREAD} AND {LOWER} > 0.3 * {SPREAD}")
_limit("marubozu", 0.95, f"{share(BODY)} >= {{t}}")
_limit("bullish_marubozu", 0.95, f"{share(BODY)} >= {{t}} AND close > open")
_limit("bearish_marubozu", 0.95, f"{share(BODY)} >= {{t}} AND close < open")


@indicator("candle.body_change")
def body_change(s: Sheet) -> str:
    return s.put(f"{BODY} - {s.lag(BODY)}")


@indicator("candle.true_range")
def true_range_(s: Sheet) -> str:
    return true_range(s)


#: (value, rolling function) of the plain rolling statistics
ROLLING = {
    "body_average": (BODY, "avg"), "rolling_body_mean": (BODY, "avg"), "rolling_body_std": (BODY, "stddev_samp"), "average_range": (SPREAD, "avg"), "rolling_range_mean": (SPREAD, "avg"),
    "rolling_range_std": (SPREAD, "stddev_samp"), "rolling_wick_mean": (WICKS, "avg"), "rolling_wick_std": (WICKS, "stddev_samp"),
}


def _rolling(x: str, f: str):
    def build(s: Sheet, length: int = 20) -> str:
        return s.roll(f, x, positive(length))

    return build


for _name, (_x, _f) in ROLLING.items():
    indicator(f"candle.{_name}")(_rolling(_x, _f))


def _ranked(x: str):
    def build(s: Sheet, length: int = 252) -> str:
        return rank_share(s, x, length)

    return build


for _name, _x in (("range_percentile", SPREAD), ("rolling_range_percentile", SPREAD), ("rolling_body_percentile", BODY), ("rolling_wick_percentile", WICKS)):
    indicator(f"candle.{_name}")(_ranked(_x))


def _scaled(x: str, sign: str, default: float):
    def build(s: Sheet, length: int = 20, multiplier: float = default) -> str:
        return s.mark(s.flag(f"{s.put(x)} {sign} {multiplier!r} * {s.roll('avg', x, positive(length))}"), "boolean")

    return build


for _name, _x, _sign, _m in (("body_expansion", BODY, ">", 1.5), ("body_contraction", BODY, "<", 0.75), ("expansion_candle", SPREAD, ">", 1.5), ("compression_candle", SPREAD, "<", 0.75)):
    indicator(f"candle.{_name}")(_scaled(_x, _sign, _m))


@indicator("candle.range_expansion")
def range_expansion(s: Sheet) -> str:
    return s.mark(s.flag(f"{SPREAD} > {s.lag(SPREAD)}"), "boolean")


@indicator("candle.range_contraction")
def range_contraction(s: Sheet) -> str:
    return s.mark(s.flag(f"{SPREAD} < {s.lag(SPREAD)}"), "boolean")


@indicator("candle.rolling_range")
def rolling_range(s: Sheet, length: int = 20) -> str:
    return s.put(f"{s.roll('max', 'high', positive(length))} - {s.roll('min', 'low', length)}")


#: tests against the bar before: {o} {h} {l} {c} are its prices
BEFORE = {
    "gap_up": "open > {c}", "gap_down": "open < {c}", "breakaway_gap_up": "open > {h}", "breakaway_gap_down": "open < {l}",
    "gap_fill": "(open > {c} AND low <= {c}) OR (open < {c} AND high >= {c})", "inside_gap": "open <> {c} AND open <= {h} AND open >= {l}",
    "inside_bar": "high <= {h} AND low >= {l}", "outside_bar": "high > {h} AND low < {l}",
}


def before(s: Sheet, text: str) -> str:
    return text.format(o=s.lag("open"), h=s.lag("high"), l=s.lag("low"), c=s.lag("close"))


def _compared(text: str):
    return lambda s: s.mark(s.flag(before(s, text)), "boolean")


for _name, _text in BEFORE.items():
    indicator(f"candle.{_name}")(_compared(_text))


@indicator("candle.gap_size")
def gap_size(s: Sheet) -> str:
    return s.put(before(s, "open - {c}"))


alias("candle.opening_gap", "candle.gap_size")


@indicator("candle.gap_percent")
def gap_percent(s: Sheet) -> str:
    return s.put(f"100 * {s.div(before(s, 'open - {c}'), s.lag('close'))}")


@indicator("candle.closing_gap")
def closing_gap(s: Sheet) -> str:
    return s.put(before(s, "close - {c}"))


@indicator("candle.high_wave")
def high_wave(s: Sheet, length: int = 20) -> str:
    wide = f"{UPPER} > 0.3 * {SPREAD} AND {LOWER} > 0.3 * {SPREAD} AND {SPREAD} > {s.roll('avg', SPREAD, positive(length))}"
    return s.mark(s.flag(f"{share(BODY)} <= 0.25 AND {wide}"), "boolean")


@indicator("candle.bull_power")
def bull_power(s: Sheet, length: int = 13) -> str:
    return s.put(f"high - {ema_raw(s, 'close', positive(length))}")


@indicator("candle.bear_power")
def bear_power(s: Sheet, length: int = 13) -> str:
    return s.put(f"low - {ema_raw(s, 'close', positive(length))}")


@indicator("candle.engulfing_body")
def engulfing_body(s: Sheet) -> str:
    up = before(s, "{c} < {o} AND close > open AND open <= {c} AND close >= {o}")
    down = before(s, "{c} > {o} AND close < open AND open >= {c} AND close <= {o}")
    return s.put(f"CASE WHEN {s.flag(up)} THEN 1 WHEN {s.flag(down)} THEN -1 ELSE 0 END")


@indicator("candle.body_overlap")
def body_overlap(s: Sheet) -> str:
    o, c = s.lag("open"), s.lag("close")
    return s.put(f"CASE WHEN {c} IS NOT NULL THEN greatest(0.0, least(greatest(open, close), greatest({o}, {c})) - greatest(least(open, close), least({o}, {c}))) END")


@indicator("candle.range_overlap")
def range_overlap(s: Sheet) -> str:
    h, l = s.lag("high"), s.lag("low")  # noqa: E741
    return s.put(f"CASE WHEN {h} IS NOT NULL THEN greatest(0.0, least(high, {h}) - greatest(low, {l})) END")


@indicator("candle.impulse_candle")
def impulse_candle(s: Sheet, length: int = 20) -> str:
    return s.mark(s.flag(f"{SPREAD} > 1.5 * {s.roll('avg', SPREAD, positive(length))} AND {share(BODY)} >= 0.6"), "boolean")


@indicator("candle.rolling_body_zscore")
def rolling_body_zscore(s: Sheet, length: int = 20) -> str:
    return s.put(s.div(f"{s.put(BODY)} - {s.roll('avg', BODY, positive(length))}", s.roll("stddev_samp", BODY, length)))


@indicator("candle.institutional_body")
def institutional_body(s: Sheet, length: int = 20, z_thresh: float = 2.0) -> str:
    return s.mark(s.flag(f"{rolling_body_zscore(s, length)} > {z_thresh!r}"), "boolean")


@indicator("candle.institutional_wick")
def institutional_wick(s: Sheet, length: int = 20, z_thresh: float = 2.0) -> str:
    return s.mark(s.flag(f"{s.put(WICKS)} > {s.roll('avg', WICKS, positive(length))} + {z_thresh!r} * {s.roll('stddev_samp', WICKS, length)}"), "boolean")


@indicator("candle.institutional_imbalance")
def institutional_imbalance(s: Sheet, length: int = 20) -> str:
    busy = f"volume > 1.5 * {s.roll('avg', 'volume', positive(length))}"
    return s.mark(s.flag(f"{rolling_body_zscore(s, length)} > 1.5 AND {SPREAD} > 2 * {s.roll('avg', SPREAD, length)} AND {busy}"), "boolean")


@indicator("candle.institutional_pressure")
def institutional_pressure(s: Sheet, length: int = 20) -> str:
    wide = s.flag(f"{SPREAD} > 1.5 * {s.roll('avg', SPREAD, positive(length))}")
    return s.put(f"CASE WHEN {wide} THEN {FORMS['wick_strength']} ELSE 0.0 END")


def extremes(s: Sheet, n: int) -> tuple[str, str]:
    """Highest high and lowest low of the n bars before this one."""
    return s.lag(s.roll("max", "high", positive(n))), s.lag(s.roll("min", "low", n))


@indicator("candle.rejection_candle")
def rejection_candle(s: Sheet, length: int = 20) -> str:
    top, low = extremes(s, length)
    return s.mark(s.flag(f"({UPPER} > 0.5 * {SPREAD} AND high >= {top}) OR ({LOWER} > 0.5 * {SPREAD} AND low <= {low})"), "boolean")


@indicator("candle.acceptance_candle")
def acceptance_candle(s: Sheet, length: int = 20) -> str:
    top, low = extremes(s, length)
    return s.mark(s.flag(f"{share(BODY)} >= 0.6 AND (close > {top} OR close < {low})"), "boolean")


@indicator("candle.liquidity_sweep_candle")
def liquidity_sweep_candle(s: Sheet, length: int = 20) -> str:
    top, low = extremes(s, length)
    return s.mark(s.flag(f"(high > {top} AND close < {top}) OR (low < {low} AND close > {low})"), "boolean")


@indicator("candle.smart_money_candle")
def smart_money_candle(s: Sheet, length: int = 20) -> str:
    parts = f"{liquidity_sweep_candle(s, length)} AND {rejection_candle(s, length)} AND {institutional_wick(s, length)}"
    return s.mark(s.flag(f"{parts} AND volume > 1.2 * {s.roll('avg', 'volume', length)}"), "boolean")

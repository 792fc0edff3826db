"""Chart patterns from confirmed pivots (names pattern.*), as windows over the bars: no look-ahead.

A pivot of ``WIDTH`` bars to each side is known ``WIDTH`` bars later and stands at that bar. The last three highs and lows
are carried along; lines through three points are least squares in closed form.
"""

from __future__ import annotations

from tapeloom.functions.sheet import Sheet

from .base import indicator
from .levels import boolean
from .smart_money import previous

#: fixed values: thresholds of the rules
WIDTH, MATCH, SHOULDER, FIT, PARALLEL, FLAT = 5, 0.005, 0.03, 0.85, 0.002, 0.0015
POLE, FLAG_SHARE, DECAY, CUP_DEPTH, HANDLE_SHARE, HANDLE_BARS = 0.04, 0.5, 0.8, 0.1, 0.5, 3
EPS = "1e-10"


def pivots(s: Sheet, x: str, f: str, far: str) -> dict[str, str]:
    """(value, v1..v3, p1..p3): the pivot confirmed here, and the last three with their positions, newest first."""
    w = WIDTH
    here = s.lag(x, w)
    around = s.put(f"{f}({x}) {s.rows(w)}"), s.put(f"{f}({x}) {s.rows(w, w + 1)}")
    new = s.put(f"CASE WHEN {s.lag(x, 2 * w)} IS NOT NULL AND {here} {far} {around[0]} AND {here} {far} {around[1]} THEN {here} END")
    at = s.put(f"CASE WHEN {new} IS NOT NULL THEN row_number() {s.over()} - {w} END")
    out = {"new": new}
    for name, v in (("v", new), ("p", at)):
        for k in (1, 2, 3):
            out[f"{name}{k}"] = s.ffill(v)
            v = s.put(f"CASE WHEN {new} IS NOT NULL THEN {previous(s, v)} END")
    return out


def line(s: Sheet, q: dict[str, str]) -> tuple[str, str, str]:
    """(slope, intercept, r squared) through the last three pivots."""
    x, y = [q[f"p{k}"] for k in (1, 2, 3)], [q[f"v{k}"] for k in (1, 2, 3)]
    mx, my = s.put(f"({' + '.join(x)}) / 3.0"), s.put(f"({' + '.join(y)}) / 3.0")
    sxx = s.put(" + ".join(f"({a} - {mx}) * ({a} - {mx})" for a in x))
    sxy = s.put(" + ".join(f"({a} - {mx}) * ({b} - {my})" for a, b in zip(x, y)))
    syy = s.put(" + ".join(f"({b} - {my}) * ({b} - {my})" for b in y))
    slope = s.put(s.div(sxy, sxx))
    return slope, s.put(f"{my} - {slope} * {mx}"), s.put(s.div(f"{sxy} * {sxy}", f"{sxx} * {syy}"))


def shoulders(s: Sheet, q: dict[str, str], other: dict[str, str], sign: str, bar: str) -> dict[str, str]:
    """Three pivots whose middle one sticks out, with at least two opposite pivots between them, which give the neckline."""
    near = f"abs({q['v3']} - {q['v1']}) / ({q['v3']} + {EPS}) < {SHOULDER}"
    head = f"{q['v2']} {sign} {q['v3']} AND {q['v2']} {sign} {q['v1']} AND {near}"
    # opposite pivots before this bar's pivot
    y1, y2, x1, x2 = (s.put(f"CASE WHEN {other['new']} IS NOT NULL THEN {other[a]} ELSE {other[b]} END") for a, b in (("v2", "v1"), ("v3", "v2"), ("p2", "p1"), ("p3", "p2")))
    found = boolean(s, f"{q['new']} IS NOT NULL AND {head} AND {x2} > {q['p3']}")
    slope = s.put(f"CASE WHEN {found} THEN ({y1} - {y2}) / ({x1} - {x2} + {EPS}) END")
    neck = s.put(f"{y2} + {slope} * ({bar} - {x2})")
    return {"found": found, "slope": slope, "neckline": neck, "broken": s.put(f"CASE WHEN {found} THEN CASE WHEN close {'<' if sign == '>' else '>'} {neck} THEN 1.0 ELSE 0.0 END END")}


def one(s: Sheet, test: str, value: str = "1.0") -> str:
    return s.put(f"CASE WHEN {s.flag(test)} THEN {value} END")


def first(*pairs: tuple[str, str], default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN {v}" for t, v in pairs) + f" ELSE {default} END"


@indicator("pattern.calculate_patterns")
def calculate_patterns(s: Sheet) -> dict[str, str]:
    bar = s.put(f"row_number() {s.over()}")
    hi, lo = pivots(s, "high", "max", ">"), pivots(s, "low", "min", "<")
    out = {"swing_high": hi["new"], "swing_low": lo["new"]}

    matches = {}
    for q, name in ((hi, "top"), (lo, "bottom")):
        two = boolean(s, f"{q['new']} IS NOT NULL AND abs({q['v2']} - {q['v1']}) / ({q['v2']} + {EPS}) < {MATCH}")
        three = boolean(s, f"{two} AND abs({q['v1']} - {q['v3']}) / ({q['v1']} + {EPS}) < {MATCH}")
        out[f"double_{name}_detected"], out[f"triple_{name}_detected"] = one(s, two), one(s, three)
        out["resistance_strength" if name == "top" else "support_strength"] = s.put(first((three, "95.0"), (two, "85.0")))
        matches[name] = two

    a, b = shoulders(s, hi, lo, ">", bar), shoulders(s, lo, hi, "<", bar)
    out |= {"hs_detected": one(s, a["found"]), "ihs_detected": one(s, b["found"])}
    out["neckline"] = s.put(f"CASE WHEN {b['found']} THEN {b['neckline']} WHEN {a['found']} THEN {a['neckline']} END")
    out["hs_neckline_slope"] = s.put(f"coalesce({b['slope']}, {a['slope']})")
    out["hs_breakout_confirmed"] = s.put(f"coalesce({b['broken']}, {a['broken']})")

    (m, c, r), (n, d, q) = line(s, hi), line(s, lo)
    upper, lower = s.put(f"{m} * {bar} + {c}"), s.put(f"{n} * {bar} + {d}")
    shape = boolean(s, f"({hi['new']} IS NOT NULL OR {lo['new']} IS NOT NULL) AND {r} > {FIT} AND {q} > {FIT} AND {upper} > {lower} + {EPS}")
    parallel, width = s.put(f"abs({m} - {n}) < {PARALLEL}"), s.put(f"{upper} - {lower}")
    flat_up, flat_low = f"abs({m}) < {FLAT}", f"abs({n}) < {FLAT}"
    box = boolean(s, f"{shape} AND {parallel} AND {flat_up} AND {flat_low}")
    channel = boolean(s, f"{shape} AND {parallel} AND NOT ({flat_up} AND {flat_low})")
    leaning = f"{shape} AND abs({m} - {n}) > {PARALLEL}"
    symmetric = boolean(s, f"{leaning} AND {m} < 0 AND {n} > 0")
    falling = boolean(s, f"{leaning} AND NOT {symmetric} AND {m} < 0 AND {flat_low}")
    rising = boolean(s, f"{leaning} AND NOT {symmetric} AND NOT {falling} AND {flat_up} AND {n} > 0")
    wedge = boolean(s, f"{leaning} AND NOT ({symmetric} OR {falling} OR {rising}) AND (({m} > 0 AND {n} > 0) OR ({m} < 0 AND {n} < 0))")
    triangle = boolean(s, f"{symmetric} OR {falling} OR {rising}")
    closing = boolean(s, f"{triangle} OR {wedge}")
    start = s.put(f"least({hi['p3']}, {lo['p3']})")
    width_then = s.put(f"({m} * {start} + {c}) - ({n} * {start} + {d})")
    out |= {
        "triangle_detected": one(s, triangle), "triangle_upper": one(s, shape, upper), "triangle_lower": one(s, shape, lower), "triangle_type": s.mark(first((symmetric, "'Symmetrical'"), (falling, "'Descending'"), (rising, "'Ascending'"), default="'None'"), "string"),
        "apex_distance": one(s, closing, f"greatest(0.0, {s.div(f'{d} - {c}', f'{m} - {n}')} - {bar})"), "compression_pct": one(s, f"{closing} AND {width_then} > {EPS}", f"least(greatest(100 * (1 - {width} / nullif({width_then}, 0)), 0.0), 100.0)"),
        "breakout_pressure": one(s, f"{closing} AND {width} > {EPS}", f"least(greatest(100 * (close - {lower}) / nullif({width}, 0), 0.0), 100.0)"),
        "channel_detected": one(s, channel), "channel_upper": one(s, channel, upper), "channel_lower": one(s, channel, lower), "channel_width": one(s, channel, width), "channel_type": s.mark(first((f"{channel} AND {m} > 0", "'Ascending'"), (channel, "'Descending'"), default="'None'"), "string"),
        "rectangle_detected": one(s, box), "rectangle_upper": one(s, box, upper), "rectangle_lower": one(s, box, lower), "rectangle_width": one(s, box, width),
        "wedge_detected": one(s, wedge), "wedge_type": s.mark(first((f"{wedge} AND {m} > 0", "'Rising'"), (wedge, "'Falling'"), default="'None'"), "string"),
    }

    pole = s.put(f"close - {s.lag('close', 10)}")
    rest = s.put(f"max(high) {s.rows(5, 1)} - min(low) {s.rows(5, 1)}")
    decay = s.put(f"{s.roll('avg', 'volume', 5)} / ({s.roll('avg', 'volume', 20)} + {EPS})")
    flag = boolean(s, f"{bar} > 15 AND abs({pole}) / ({s.lag('close', 10)} + {EPS}) > {POLE} AND {rest} < abs({pole}) * {FLAG_SHARE} AND {decay} < {DECAY}")
    out |= {
        "flag_detected": one(s, flag), "pennant_detected": one(s, f"{flag} AND {triangle}"), "pole_length": one(s, flag, f"abs({pole})"), "retracement_depth": one(s, flag, f"least(greatest(100 * {rest} / (abs({pole}) + {EPS}), 0.0), 100.0)"),
        "volume_decay": one(s, flag, decay), "flag_quality": one(s, flag, f"least(greatest(100 * (1 - {decay}), 0.0), 100.0)"),
    }

    long_enough = f"{bar} > 30"
    left, bowl, right = s.put(f"max(high) {s.rows(10, 21)}"), s.put(f"min(low) {s.rows(10, 11)}"), s.put(f"max(high) {s.rows(10, 1)}")
    round_low = boolean(s, f"{long_enough} AND {left} > 1.05 * {bowl} AND {right} > 1.05 * {bowl} AND {right} > 0.98 * {left} AND abs({left} - {right}) / ({left} + {EPS}) < 0.05")
    depth = s.put(f"({left} - {bowl}) / ({left} + {EPS})")
    cup = boolean(s, f"{round_low} AND {depth} >= {CUP_DEPTH}")
    low10 = s.put(f"min(low) {s.rows(10, 1)}")
    since = s.put(first(*((f"{s.lag('low', k)} = {low10}", str(k)) for k in range(10, 0, -1))))
    handle = boolean(s, f"{cup} AND {since} >= {HANDLE_BARS} AND ({right} - {low10}) / ({right} + {EPS}) < {HANDLE_SHARE} * {depth} AND close < {right} AND close > {low10} AND {s.roll('avg', 'volume', 5)} < {s.roll('avg', 'volume', 20)}")
    dip, crown, dip2 = s.put(f"min(low) {s.rows(10, 21)}"), s.put(f"max(high) {s.rows(10, 11)}"), low10
    round_high = boolean(s, f"{long_enough} AND {dip} < 0.85 * {crown} AND {dip2} < 0.85 * {crown} AND abs({dip} - {dip2}) / ({dip} + {EPS}) < 0.05")
    out |= {"rounding_bottom_detected": one(s, round_low), "cup_detected": one(s, cup), "handle_detected": one(s, handle), "rounding_top_detected": one(s, round_high, "80.0")}

    # the last rule that fits gives the confidence
    out["pattern_confidence"] = s.put(first((round_high, "85.0"), (handle, "95.0"), (cup, "85.0"), (flag, "90.0"), (closing, "85.0"), (channel, "80.0"), (box, "75.0"), (f"{a['found']} OR {b['found']}", "80.0")))
    reversal = f"{matches['top']} OR {matches['bottom']} OR {a['found']} OR {b['found']} OR {cup} OR {round_high}"
    out["pattern_family"] = s.mark(first((reversal, "'Reversal'"), (f"{closing} OR {flag}", "'Continuation'"), default="'None'"), "string")
    broke = s.flag(f"{shape} AND (close > {upper} OR close < {lower})")
    out["market_phase"] = s.mark(first((broke, "'Breakout'"), (closing, "'Compression'"), (channel, "'Trending'"), (box, "'Accumulation/Distribution'"), default="'Neutral'"), "string")
    busy = s.put(s.div("volume", s.roll("avg", "volume", 20)))
    out["volume_confirmation"] = busy
    out["trend_strength"] = s.put(f"100 * {s.div(f'abs(close - {s.lag('close', 20)})', s.roll('sum', f'abs(close - {s.lag('close')})', 20))}")
    out["breakout_strength"] = one(s, broke, f"100 * {s.div(f'CASE WHEN close > {upper} THEN close - {upper} ELSE {lower} - close END', width)}")
    out["market_regime"] = s.mark(first((f"{out['trend_strength']} >= 50 AND close > {s.lag('close', 20)}", "'Bullish'"), (f"{out['trend_strength']} >= 50", "'Bearish'"), default="'Neutral'"), "string")
    return out


__all__ = ["calculate_patterns"]

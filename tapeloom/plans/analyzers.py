"""Analyzers: votes over a feature table, one record a bar (or the latest of each symbol) with its evidence.

Everything is a window expression, so a record can be had for every bar at the cost of one, as a back-test needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tapeloom.functions.sheet import Sheet

from .activity import volatility, volume
from .shape import candles, chart, support_resistance
from .votes import TINY, Look, Votes, band, clip


def trend(s: Sheet) -> tuple[dict[str, str], dict[str, Votes]]:
    look = Look(s)
    v = Votes(s)
    v.add("EMA_Align", 20.0, ("ema_20 > ema_50 AND (ema_200 IS NULL OR ema_50 > ema_200)", "Bullish Alignment", 1), ("ema_20 < ema_50 AND (ema_200 IS NULL OR ema_50 < ema_200)", "Bearish Alignment", -1), ("true", "Mixed Alignment", 0))
    slope = look.slope("ema_20", 5)
    v.add("EMA_Slope", 10.0, (f"{slope} > 0", "Positive Short-term Slope", 1), (f"{slope} < 0", "Negative Short-term Slope", -1))
    shape = s.put(f"{look.f('sum', 'bos', 20)} + 1.5 * {look.f('sum', 'choch', 20)}")
    v.add("Structure", 20.0, (f"{shape} >= 1", "Bullish Structure (HH/HL)", 1), (f"{shape} <= -1", "Bearish Structure (LH/LL)", -1), ("true", "Structure Consolidated", 0))
    v.add("VWAP", 15.0, ("close > vwap", "Price above VWAP", 1), ("true", "Price below VWAP", -1))
    step = look.slope("macd_line - macd_signal", 5)
    v.add("MACD", 15.0, (f"macd_line > macd_signal AND {step} > 0", "Bullish Expanding Momentum", 1), (f"macd_line < macd_signal AND {step} < 0", "Bearish Expanding Momentum", -1), ("true", "Decaying Momentum", 0))
    v.add("SuperTrend", 10.0, ("supertrend_direction > 0", "Bullish Trailing Support", 1), ("true", "Bearish Trailing Resistance", -1))
    direction = s.put(clip(f"1.0 * ({v.score()})", -100.0, 100.0))  # of 100 points; 10 stand for a vote that no feature casts
    side = s.put(f"cast(sign({direction}) AS int)")
    status = s.mark(f"CASE WHEN {direction} >= 60 THEN 'Strong Bullish' WHEN {direction} >= 20 THEN 'Bullish' WHEN {direction} > -20 THEN 'Sideways' WHEN {direction} > -60 THEN 'Bearish' ELSE 'Strong Bearish' END", "string")
    sure = s.put(f"100 * ({v.weight('{p} = ' + side)} + CASE WHEN {side} = 0 THEN 0.5 * ({v.weight('{p} = 0')}) ELSE 0.0 END) / {v.weight('{p} IS NOT NULL')}")
    out = {"direction": status, "direction_score": direction, "direction_confidence": sure}

    t = Votes(s)
    adx_step, spread_step = look.slope("adx", 10), look.slope("abs(ema_20 - ema_50)", 10)
    t.add("ADX", 70.0, ("adx >= 25", "Strong directional ADX", 1), ("true", "Weak ADX", -1))
    t.add("EMA_Spread", 15.0, (f"{spread_step} > 0", "Moving Averages Expanding", 1), ("true", "Moving Averages Contracting", -1))
    t.add("Regression", 15.0, ("linreg_r2 > 0.6", "High linear fit", 1), ("true", "Messy linear fit", -1))
    strength = s.put(clip(f"CASE WHEN adx >= 25 THEN least(1.5 * adx, 60.0) + CASE WHEN {adx_step} > 0 THEN 10 ELSE 0 END ELSE least(coalesce(adx, 0.0), 30.0) END + CASE WHEN {spread_step} > 0 THEN 15 ELSE 0 END + CASE WHEN linreg_r2 > 0.6 THEN 15 ELSE 0 END", 0.0, 100.0))
    out |= {"strength": s.mark(band(strength, (80.0, "Very Strong"), (60.0, "Strong"), (40.0, "Moderate"), (20.0, "Weak"), other="Very Weak"), "string"), "strength_score": strength, "strength_confidence": t.confidence("1")}

    q = Votes(s)
    ratio = s.put(f"abs(close - {s.lag('close', 20)}) / ({look.f('sum', f'abs(close - {s.lag('close')})', 20)} + {TINY})")
    noise = s.put(f"{look.f('avg', '(high - low) - abs(close - open)', 10)} / ({look.f('avg', 'abs(close - open)', 10)} + {TINY})")
    fit = s.put(clip(f"coalesce({look.f('avg', 'linreg_r2', 10)}, 0.0)", 0.0, 1.0))
    q.add("Efficiency", 40.0, (f"{ratio} >= 0.8", "Excellent efficiency", 1), (f"{ratio} >= 0.6", "Good efficiency", 1), ("true", "Choppy action", -1))
    q.add("Noise", 30.0, (f"{noise} > 1.5", "High wick interference", -1), (f"{noise} < 0.8", "Clean bodies", 1), ("true", "Average noise", 0))
    q.add("Smoothness", 30.0, (f"{fit} > 0.7", "Consistently smooth", 1), ("true", "Erratic path", -1))
    quality = s.put(clip(f"50 * coalesce({ratio}, 0.0) + greatest(0.0, 10 * (2 - {noise})) + 30 * {fit}", 0.0, 100.0))
    out |= {
        "quality": s.mark(band(quality, (75.0, "Excellent"), (50.0, "Good"), (30.0, "Average"), other="Poor"), "string"), "quality_score": quality, "quality_confidence": q.confidence("1"), "trend_efficiency": ratio,
        "noise_level": s.mark(f"CASE WHEN {noise} > 1.5 THEN 'High' WHEN {noise} < 0.8 THEN 'Low' ELSE 'Moderate' END", "string"),
    }

    up = f"{direction} > 0"
    persistence = s.put(f"100 * CASE WHEN {up} THEN {look.f('avg', f'CASE WHEN ema_20 > {s.lag('ema_20')} THEN 1.0 ELSE 0.0 END', 19)} ELSE {look.f('avg', f'CASE WHEN ema_20 < {s.lag('ema_20')} THEN 1.0 ELSE 0.0 END', 19)} END")
    back = s.put(f"CASE WHEN {up} THEN {look.f('max', 'high', 20)} - close ELSE close - {look.f('min', 'low', 20)} END / (atr_14 + {TINY})")
    health = s.put(clip(f"100 - 20 * {back}", 0.0, 100.0))
    aligned = "(ob_active > 0 OR fvg_active > 0 OR liq_sweep <> 0)"
    joined = s.put(clip(f"30 * ob_active + 20 * fvg_active + CASE WHEN liq_sweep <> 0 THEN 20 ELSE 0 END + CASE WHEN {aligned} AND volume > 1.5 * {look.f('avg', 'volume', 20)} THEN 30 ELSE 0 END", 0.0, 100.0))
    drive = s.put(clip(f"{strength} * coalesce({ratio}, 0.0)", 0.0, 100.0))
    confirmed = s.put(clip(f"0.7 * {joined} + CASE WHEN bos = CASE WHEN {up} THEN 1 ELSE -1 END THEN 30 ELSE 0 END", 0.0, 100.0))
    reliable = s.put(clip(f"0.4 * {persistence} + 0.3 * {health} + 0.3 * {drive}", 0.0, 100.0))
    out |= {"trend_persistence": persistence, "pullback_health": health, "institutional_participation": joined, "momentum_quality": drive, "smart_money_confirmation": confirmed, "trend_reliability": reliable}

    e = Votes(s)
    higher = s.put(s.flag(f"{look.f('max', 'high', 5)} > {look.f('max', 'high', 15, 5)}"))
    e.add("Divergence", 20.0, (f"{higher} AND {look.f('max', 'rsi', 5)} < {look.f('max', 'rsi', 15, 5)} AND {look.f('max', 'rsi', 5)} > 60", "Bearish RSI Divergence", 1))
    e.add("Divergence", 20.0, (f"{higher} AND {look.f('max', 'macd_line', 5)} < {look.f('max', 'macd_line', 15, 5)} AND {look.f('max', 'macd_line', 5)} > 0", "Bearish MACD Divergence", 1))
    e.add("ADX", 20.0, (f"adx < {s.lag('adx', 2)} AND adx > 30", "ADX Decline (Momentum Loss)", 1))
    e.add("Volume", 20.0, (f"volume > 2.5 * {look.f('avg', 'volume', 20)} AND abs(close - open) / (high - low + {TINY}) < 0.4", "Climax Volume w/ Rejection", 1))
    e.add("Extension", 20.0, (f"abs(close - ema_20) / (ema_20 + {TINY}) > 0.05", "Hyper-extended from EMA20", 1))
    tired = s.put(clip(e.score(), 0.0, 100.0))
    out |= {"exhaustion": s.mark(band(tired, (75.0, "Critical"), (50.0, "High"), (25.0, "Moderate"), other="Low"), "string"), "exhaustion_score": tired, "exhaustion_confidence": tired}

    wild = s.put(s.flag(f"atr_14 > 1.5 * {look.f('avg', 'atr_14', 50)}"))
    regime = s.mark(f"CASE WHEN adx > 25 AND {strength} > 40 THEN CASE WHEN {wild} THEN 'Volatile Trending' WHEN {quality} > 60 THEN 'Clean Trending' ELSE 'Trending' END WHEN adx < 20 AND NOT {wild} THEN 'Compression / Sideways' ELSE 'Choppy / Transitional' END", "string")
    turned, broke = look.f("sum", "choch", 10), look.f("sum", "bos", 10)
    phase = s.mark(
        f"CASE WHEN {regime} = 'Compression / Sideways' THEN CASE WHEN ema_200 IS NULL THEN 'Consolidation' WHEN close > ema_200 THEN 'Accumulation Zone' ELSE 'Distribution Zone' END "
        f"WHEN {up} THEN CASE WHEN {turned} < 0 THEN 'Distribution Risk (CHOCH Down)' WHEN {broke} > 0 THEN 'Mature Markup' ELSE 'Early Markup' END "
        f"ELSE CASE WHEN {turned} > 0 THEN 'Accumulation Risk (CHOCH Up)' WHEN {broke} < 0 THEN 'Mature Markdown' ELSE 'Early Markdown' END END",
        "string",
    )
    sound = f"{quality} > 60 AND {health} > 60"
    chance = s.put(clip(f"50 + 0.15 * abs({direction}) + 0.15 * {strength} + CASE WHEN {sound} THEN 20 ELSE -10 END - 0.3 * {tired}", 5.0, 95.0))
    out |= {"regime": regime, "phase": phase, "regime_confidence": s.put(f"greatest({strength}, 50.0)"), "continuation_probability": chance, "continuation": s.mark(band(chance, (70.0, "High"), (45.0, "Moderate"), other="Low"), "string")}
    return out, {"direction": v, "strength": t, "quality": q, "exhaustion": e}


def momentum(s: Sheet) -> tuple[dict[str, str], dict[str, Votes]]:
    look = Look(s)
    rsi = s.put(clip("2 * (rsi - 50)", -100.0, 100.0))
    macd = s.put("50 * sign(macd_line) + 50 * sign(macd_histogram)")
    v = Votes(s)
    for kind, weight, x, yes, no in (("MACD", 20.0, macd, "Bullish MACD Force", "Bearish MACD Force"), ("RSI", 20.0, rsi, "Bullish RSI", "Bearish RSI"), ("ROC", 15.0, "roc", "Positive ROC", "Negative ROC"), ("Momentum", 15.0, "momentum", "Positive Momentum", "Negative Momentum")):
        v.add(kind, weight, (f"{x} > 0", yes, 1), (f"{x} < 0", no, -1))
    so_far = v.score()
    v.add("ADX", 15.0, (f"adx > 25 AND {so_far} > 0", "ADX Supporting Trend", 1), ("adx > 25", "ADX Supporting Trend", -1))
    score = s.put(clip(f"{v.score()} * 100 / 100.0", -100.0, 100.0))
    side = s.put(f"cast(sign({score}) AS int)")
    out = {
        "rsi_score": rsi, "macd_score": macd, "momentum_score": score, "momentum_confidence": v.confidence(side),
        "momentum_status": s.mark(f"CASE WHEN {score} >= 60 THEN 'Strong Bullish' WHEN {score} >= 20 THEN 'Bullish' WHEN {score} > -20 THEN 'Neutral' WHEN {score} > -60 THEN 'Bearish' ELSE 'Strong Bearish' END", "string"),
    }
    hist, speed = look.slope("macd_histogram", 5), look.slope("rsi", 5)
    a = Votes(s)
    a.add("Hist_Expand", 30.0, (f"{hist} > 0 AND macd_histogram > 0", "Bullish Histogram Expansion", 1), (f"{hist} < 0 AND macd_histogram < 0", "Bearish Histogram Expansion", -1))
    a.add("RSI_Velocity", 30.0, (f"{speed} > 1.5", "High RSI Velocity", 1), (f"{speed} < -1.5", "High RSI Velocity", -1))
    faster = a.weight("{p} IS NOT NULL")
    out |= {"acceleration_score": faster, "acceleration": s.mark(band(faster, (60.0, "Rapid Acceleration"), (30.0, "Accelerating"), other="Constant"), "string"), "acceleration_confidence": a.confidence(f"(CASE WHEN {hist} > 0 OR {speed} > 0 THEN 1 ELSE -1 END)")}
    x = Votes(s)
    x.add("Volume_Climax", 40.0, (f"volume > 3.0 * {look.f('avg', 'volume', 20)} AND abs(close - open) / (high - low + {TINY}) < 0.4", "Blowoff / Climax Volume w/ Rejection", -1))
    x.add("RSI_Extreme", 30.0, ("rsi > 80 OR rsi < 20", "RSI at Extreme Exhaustion", -1))
    x.add("Volatility_Collapse", 30.0, (f"{look.f('stddev_samp', 'roc', 10)} < 0.5 * {look.f('stddev_samp', 'roc', 10, 10)}", "Momentum Volatility Collapsing post-peak", -1))
    tired = x.weight("{p} IS NOT NULL")
    out |= {"momentum_exhaustion_score": tired, "momentum_exhaustion": s.mark(band(tired, (70.0, "Climax/Blowoff"), (35.0, "Exhausting"), other="Normal", sign=">"), "string")}
    h = Votes(s)
    for kind, weight, c, d, text in (("MACD_Hist", 25.0, "macd_histogram", "0", "MACD Hist"), ("MACD_Line", 20.0, "macd_line", "macd_signal", "MACD Line"), ("RSI_Cross", 20.0, "rsi", "50", "RSI 50"), ("Mom_Cross", 15.0, "momentum", "0", "Momentum Zero")):
        was = s.lag(f"{c} - {d}") if d != "0" else s.lag(c)
        edge = "=" if kind == "RSI_Cross" else ""
        h.add(kind, weight, (f"{was} < 0 AND {c} >{edge} {d}", f"{text} Cross Up", 1), (f"{was} > 0 AND {c} <{edge} {d}", f"{text} Cross Down", -1))
    shift = h.score()
    out |= {"shift_score": shift, "shift": s.mark(f"CASE WHEN {shift} >= 30 THEN 'Positive Shift' WHEN {shift} <= -30 THEN 'Negative Shift' ELSE 'No Major Shift' END", "string"), "shift_confidence": h.confidence(s.put(f"cast(sign({shift}) AS int)"))}
    c = Votes(s)
    c.add("ROC_Squeeze", 35.0, (f"{look.f('stddev_samp', 'roc', 20)} < 0.5", "Momentum heavily compressed", 0))
    c.add("Price_Squeeze", 35.0, (f"({look.f('max', 'high', 20)} - {look.f('min', 'low', 20)}) / (atr_14 + {TINY}) < 4", "Price Volatility Squeeze", 0))
    c.add("ATR_Squeeze", 30.0, (f"atr_14 < 0.8 * {look.f('avg', 'atr_14', 20)}", "ATR Compression Phase", 0))
    tight = c.weight("{p} IS NOT NULL")
    out |= {"compression_score": tight, "compression": s.mark(band(tight, (70.0, "High Compression"), (35.0, "Building"), other="Expanded"), "string")}
    marks = "(CASE WHEN ob_active > 0 THEN 30 ELSE 0 END + CASE WHEN fvg_active > 0 THEN 20 ELSE 0 END + CASE WHEN liq_sweep <> 0 THEN 20 ELSE 0 END + CASE WHEN bos <> 0 THEN 30 ELSE 0 END)"
    busy = s.put(f"volume / ({look.f('avg', 'volume', 20)} + {TINY})")
    joined = s.put(clip(f"CASE WHEN {marks} = 0 THEN 0.0 WHEN {busy} > 1.2 THEN {marks} + 20 * least({busy}, 2.0) WHEN {busy} < 0.8 THEN 0.5 * {marks} ELSE 1.0 * {marks} END", 0.0, 100.0))
    retail = s.put("CASE WHEN rsi > 75 OR rsi < 25 THEN 50.0 ELSE 0.0 END")
    out |= {"institutional_momentum": joined, "retail_momentum": retail, "dominance": s.mark(f"CASE WHEN {joined} > {retail} + 20 THEN 'Institutional Dominance' WHEN {retail} > {joined} + 20 THEN 'Retail Dominance' ELSE 'Mixed Context' END", "string")}
    g = Votes(s)
    g.add("Shift", 25.0, (f"abs({shift}) >= 30", "Directional Momentum Shift detected", 1))
    g.add("Compression_Break", 25.0, (f"{tight} >= 35 AND abs({shift}) > 0", "Breaking out of Compression", 1))
    g.add("Inst_Volume", 25.0, (f"volume > 1.5 * {look.f('avg', 'volume', 20)} AND {joined} > 30", "SMC Aligned Volume Expansion", 1))
    g.add("Volatility", 25.0, (f"atr_14 > 1.2 * {look.f('avg', 'atr_14', 20)}", "Volatility Expanding with Direction", 1))
    lit = g.weight("{p} IS NOT NULL")
    out |= {"ignition_score": lit, "ignition": s.mark(band(lit, (85.0, "Explosive"), (60.0, "Igniting"), (30.0, "Building"), other="Dormant"), "string")}
    # the strengths of the oscillators' divergences; the type that most of them have
    kinds = {o: divergence(s, look, o, *((65.0, 35.0) if o == "rsi" else (0.0, 0.0))) for o in ("rsi", "macd_line", "roc", "momentum")}
    out |= {f"divergence_{o}": k for o, (k, _) in kinds.items()}
    n = {t: s.put(" + ".join(f"CASE WHEN {k} = {t} THEN 1 ELSE 0 END" for k, _ in kinds.values())) for t in (-1, 1, -2, 2)}
    most, any_ = s.put(f"greatest({', '.join(n.values())})"), s.put(" + ".join(n.values()))
    kind = s.put(f"CASE WHEN {most} = 0 THEN 0 " + " ".join(f"WHEN {c} = {most} THEN {t}" for t, c in n.items()) + " ELSE 0 END")
    strongest = s.put(f"greatest({', '.join(x for _, x in kinds.values())})")
    out |= {
        "divergence": s.mark(f"CASE {kind} WHEN -1 THEN 'Regular Bearish' WHEN 1 THEN 'Regular Bullish' WHEN -2 THEN 'Hidden Bearish' WHEN 2 THEN 'Hidden Bullish' ELSE 'None' END", "string"),
        "divergence_strength": strongest, "divergence_confidence": s.put(f"25.0 * {any_}"),
    }
    out |= {"acceleration_rate": s.put(f"CASE WHEN {a.polarity(0)} IS NOT NULL THEN 1.0 ELSE 0.0 END + CASE WHEN {a.polarity(1)} IS NOT NULL THEN 0.1 * abs({speed}) ELSE 0.0 END")}
    out |= {"rsi_regime": s.mark("CASE WHEN rsi > 50 THEN 'Bullish' ELSE 'Bearish' END", "string"), "macd_phase": s.mark(f"CASE WHEN abs({macd}) = 100 THEN 'Expanding' ELSE 'Transitional' END", "string")}
    up, down = "roc > 0 AND rsi > 50 AND macd_histogram > 0 AND momentum > 0", "roc < 0 AND rsi < 50 AND macd_histogram < 0 AND momentum < 0"
    local = s.put(f"CASE WHEN {up} THEN 100.0 WHEN {down} THEN -100.0 ELSE 0.0 END")
    out |= {
        "local_alignment": local,
        "momentum_cycle": s.mark(
            f"CASE WHEN {tight} >= 70 THEN 'Accumulation' WHEN {lit} >= 60 AND {shift} <> 0 THEN 'Early Expansion' WHEN {lit} >= 30 AND abs({score}) > 20 THEN 'Expansion' WHEN {faster} >= 60 THEN 'Acceleration' "
            f"WHEN abs({score}) >= 60 THEN 'Markup/Markdown' WHEN {tired} >= 60 THEN 'Exhaustion' WHEN abs({shift}) > 40 AND {score} <> 0 AND sign({shift}) <> sign({score}) THEN 'Distribution' ELSE 'Reset' END",
            "string",
        ),
    }
    out["cycle_confidence"] = s.put(f"CASE WHEN {out['momentum_cycle']} IN ('Accumulation', 'Acceleration', 'Exhaustion') THEN 100.0 ELSE 80.0 END")
    rises = look.f("sum", "CASE WHEN roc > 0 THEN 1 ELSE 0 END", 20)
    lasts = s.put(f"5.0 * CASE WHEN {score} > 0 THEN {rises} ELSE 20 - {rises} END")
    backed, fit = s.put(clip(f"50 * {busy}", 0.0, 100.0)), s.put(clip("100 * coalesce(linreg_r2, 0.0)", 0.0, 100.0))
    agree = s.put("CASE WHEN rsi > 50 AND macd_line > 0 AND roc > 0 THEN 100.0 WHEN rsi < 50 AND macd_line < 0 AND roc < 0 THEN 100.0 ELSE 0.0 END")
    quality = s.put(f"({fit} + {agree} + {backed}) / 3")
    out |= {
        "momentum_persistence": lasts, "volume_backing": backed, "momentum_quality": quality, "momentum_efficiency": fit, "momentum_stability": s.put(clip(f"100 - {tight}", 0.0, 100.0)), "momentum_consistency": agree,
        "impulse_strength": faster, "pullback_strength": s.put(f"100 - {faster}"), "momentum_continuation": s.put(f"(0.3 * abs({score}) + 0.3 * {lasts} + 0.4 * {joined}) * CASE WHEN {any_} > 0 THEN 0.5 ELSE 1.0 END"),
    }
    side = s.put(f"cast(CASE WHEN {shift} <> 0 THEN sign({shift}) ELSE sign({score}) END AS int)")
    ready = s.put(clip(
        f"0.15 * {lit} + 0.1 * abs({shift}) + 0.15 * {joined} + 0.1 * {backed} + CASE WHEN {side} <> 0 AND sign({local}) = {side} THEN 0.1 * abs({local}) ELSE 0.0 END + 0.1 * abs({score}) + 0.1 * {quality} + least(0.2 * coalesce(adx, 0.0), 10.0) "
        f"+ 0.1 * {lasts} + CASE WHEN atr_14 > 1.2 * {look.f('avg', 'atr_14', 20)} THEN 5 ELSE 0 END - CASE WHEN {tired} > 40 THEN 0.4 * {tired} ELSE 0.0 END - CASE WHEN {any_} > 0 AND sign({kind}) <> {side} THEN 30 ELSE 0 END", 0.0, 100.0,
    ))
    out |= {
        "swing_readiness": ready,
        "swing_state": s.mark(f"CASE WHEN {ready} >= 85 THEN 'Ready (Optimal Entry)' WHEN {ready} >= 65 THEN 'Early (Building)' WHEN {ready} >= 45 THEN 'Running' WHEN {ready} >= 25 THEN 'Late (Extended)' WHEN {tired} > 60 THEN 'Exhausted' ELSE 'Very Early / Dormant' END", "string"),
    }
    return out, {"momentum": v, "acceleration": a, "exhaustion": x, "shift": h, "compression": c, "ignition": g}


def divergence(s: Sheet, look: Look, osc: str, high: float, low: float) -> tuple[str, str]:
    """(type, strength): 1 and -1 regular, 2 and -2 hidden divergence of price and oscillator between the halves of the last
    20 bars."""
    (a, b), (c, d), (e, f), (g, h) = ((look.f(how, x, 10, 10), look.f(how, x, 10)) for how, x in (("max", "close"), ("min", "close"), ("max", osc), ("min", osc)))
    kind = s.put(f"CASE WHEN {s.lag('close', 19)} IS NULL THEN 0 WHEN {b} > {a} AND {f} < {e} AND {e} > {high!r} THEN -1 WHEN {d} < {c} AND {h} > {g} AND {g} < {low!r} THEN 1 WHEN {b} < {a} AND {f} > {e} AND {f} > {high!r} THEN -2 WHEN {d} > {c} AND {h} < {g} AND {h} < {low!r} THEN 2 ELSE 0 END")
    return kind, s.put(f"CASE WHEN {kind} = 0 THEN 0.0 ELSE least(CASE WHEN {kind} < 0 THEN abs({e} - {f}) / (abs({e}) + {TINY}) ELSE abs({h} - {g}) / (abs({g}) + {TINY}) END * CASE WHEN abs({kind}) = 1 THEN 200.0 ELSE 150.0 END, 100.0) END")


#: fixed values: weights of longer timeframes, and of the bar's own in the two votes
FRAME_WEIGHTS = {"_M": 0.30, "_W": 0.25, "_D": 0.20, "_4H": 0.10, "_1H": 0.05, "_15m": 0.05, "_5m": 0.05}
CANDLE_WEIGHTS = {"_M": 0.35, "_W": 0.25, "_D": 0.20, "_4H": 0.10, "_1H": 0.05, "_15m": 0.03, "_5m": 0.02}
OWN_TREND, OWN_MOMENTUM = 0.10, 0.15


def frames(s: Sheet) -> tuple[dict[str, str], dict[str, Votes]]:
    """Votes of the longer timeframes that the table has columns of (plans.timeframes)."""
    there = [f for f in FRAME_WEIGHTS if f"close{f}" in s.columns]
    own = s.put(s.flag("close > ema_50"))
    score, total = f"CASE WHEN {own} THEN {OWN_TREND!r} ELSE 0.0 END", repr(OWN_TREND)
    for f in there:
        known = f"close{f} IS NOT NULL AND ema{f} IS NOT NULL"
        total += f" + CASE WHEN {known} THEN {FRAME_WEIGHTS[f]!r} ELSE 0.0 END"
        score += f" + CASE WHEN {known} AND close{f} > ema{f} THEN {FRAME_WEIGHTS[f]!r} ELSE 0.0 END"
    share = s.put(clip(f"100 * ({score}) / ({total})", 0.0, 100.0))
    alone = s.put(f"({total}) <= {OWN_TREND + 1e-9!r}")
    text = f"CASE WHEN {alone} THEN 'Local Only' WHEN {share} >= 80 THEN 'Full Bullish Alignment' WHEN {share} <= 20 THEN 'Full Bearish Alignment' WHEN ({own} AND {share} < 50) OR (NOT {own} AND {share} >= 50) THEN 'LTF / HTF Conflict' ELSE 'Mixed / Neutral' END"

    def side(f: str) -> str:
        names = ("roc", "rsi", "macd_histogram", "momentum")
        up, down = (" AND ".join(f"{n}{f} {sign} {50 if n == 'rsi' else 0}" for n in names) for sign in "><")
        return s.put(f"CASE WHEN {' OR '.join(f'{n}{f} IS NULL' for n in names)} THEN NULL WHEN {up} THEN 1 WHEN {down} THEN -1 ELSE 0 END")

    sides = {f: side(f) for f in there}
    push = f"{OWN_MOMENTUM!r} * coalesce({side('')}, 0)" + "".join(f" + {FRAME_WEIGHTS[f]!r} * coalesce({c}, 0)" for f, c in sides.items())
    weight = repr(OWN_MOMENTUM) + "".join(f" + CASE WHEN {c} IS NOT NULL THEN {FRAME_WEIGHTS[f]!r} ELSE 0.0 END" for f, c in sides.items())
    drive = s.put(f"100 * ({push}) / ({weight})")
    def known(c: str) -> bool:
        return c in s.columns

    # bodies of the longer bars: their lean, and how far the longest and the shorter ones disagree
    lean = {f: s.put(f"cast(sign(close{f} - open{f}) AS int)") for f in there if known(f"open{f}")}
    bodies = " + ".join(["0.0", *(f"{CANDLE_WEIGHTS[f]!r} * coalesce({c}, 0)" for f, c in lean.items())])
    counted = " + ".join([TINY, *(f"CASE WHEN {c} IS NOT NULL THEN {CANDLE_WEIGHTS[f]!r} ELSE 0.0 END" for f, c in lean.items())])
    candle = s.put(f"100 * ({bodies}) / ({counted})")
    part = lambda names: s.put(" + ".join(["0.0", *(f"CASE WHEN close{f} > open{f} THEN 1.0 WHEN close{f} IS NULL THEN 0.0 ELSE -1.0 END" for f in names if f in lean)]))
    longest, shorter = part(("_D", "_W", "_M")), part(("_5m", "_15m", "_1H", "_4H"))
    torn = s.put(f"25 * abs({longest} - {shorter})")
    # volume features of the longer bars against their own past
    traded: dict[str, str] = {}
    for f in there:
        tests = [(f"volume{f}", f"volume{f} > volume_ma_20{f}" if known(f"volume_ma_20{f}") else "false")]
        tests += [(f"{c}{f}", f"{c}{f} > {s.lag(f'{c}{f}')}") for c in ("obv", "chaikin_money_flow") if known(f"{c}{f}")]
        tests += [(f"vwap{f}", f"close{f} > vwap{f}")] if known(f"vwap{f}") else []
        votes = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 WHEN {t} THEN 1 ELSE -1 END" for c, t in tests if known(c))
        there_ = " OR ".join(f"{c} IS NOT NULL" for c, _ in tests if known(c))
        traded[f] = s.put(f"CASE WHEN NOT ({there_}) THEN NULL WHEN {votes} > 0 THEN 1 ELSE -1 END")
    flow = " + ".join(["0.0", *(f"{FRAME_WEIGHTS[f]!r} * coalesce({c}, 0)" for f, c in traded.items())])
    heard = s.put(" + ".join(["0.0", *(f"CASE WHEN {c} IS NOT NULL THEN {FRAME_WEIGHTS[f]!r} ELSE 0.0 END" for f, c in traded.items())]))
    volumes = s.put(f"100 * {s.div(flow, heard, '0.0')}")
    v = Votes(s)
    for f in there:
        v.add(f.strip("_"), FRAME_WEIGHTS[f], (f"close{f} > ema{f}", "Bullish", 1), (f"close{f} <= ema{f}", "Bearish", -1))
    return {
        "frames_trend_score": share, "frames_trend": s.mark(text, "string"), "frames_momentum_score": drive,
        "frames_momentum": s.mark(f"CASE WHEN {drive} > 70 THEN 'Strong Bullish Alignment' WHEN {drive} < -70 THEN 'Strong Bearish Alignment' ELSE 'Mixed / Choppy' END", "string"),
        "frames_candle_score": candle, "frames_candle": s.mark(f"CASE WHEN {candle} > 35 THEN 'Macro Long' WHEN {candle} < -35 THEN 'Macro Short' ELSE 'Rotational Balance' END", "string"),
        "frames_trigger": s.mark(f"CASE WHEN {shorter} > 1 THEN 'Trigger Sync Bull' WHEN {shorter} < -1 THEN 'Trigger Sync Bear' ELSE 'Friction Compression' END", "string"), "frames_conflict": torn,
        "frames_structure": s.mark(f"CASE WHEN {torn} < 30 THEN 'Consensus Structural Matrix' ELSE 'Timeframe Fragmentation Node' END", "string"),
        "frames_volume_score": volumes, "frames_volume": s.mark(f"CASE WHEN {volumes} > 50 THEN 'Macro Accumulation' WHEN {volumes} < -50 THEN 'Macro Distribution' ELSE 'Mixed Context' END", "string"), "frames_volume_confidence": s.put(f"100 * {heard}"),
    }, {"timeframes": v} if there else {}


ANALYZERS = {"trend": trend, "momentum": momentum, "volatility": volatility, "volume": volume, "candle": candles, "pattern": chart, "support_resistance": support_resistance, "timeframes": frames}


def analyze(features: DataFrame, name: str, latest: bool = True, evidence: bool = True, digits: int | None = 2) -> DataFrame:
    """(symbol, ts, close, verdict columns, evidence_* arrays) of an analyzer, for the latest bar of each symbol or all bars."""
    s = Sheet({f.name: f.dataType.simpleString() for f in features.schema})
    out, votes = ANALYZERS[name](s)
    if evidence:
        out = out | {f"evidence_{k}": v.evidence() for k, v in votes.items()}
    df = s.spark(features, out, digits).select("symbol", "ts", "close", *out)
    if latest:
        df = df.withColumn("rank_", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("ts").desc()))).where("rank_ = 1").drop("rank_")
    return df


def analyze_sql(features: str, columns: dict[str, str], name: str, digits: int | None = 2) -> str:
    """DuckDB SQL of the records of all bars, without evidence, over the SQL ``features`` with these columns and types."""
    s = Sheet(dict(columns))
    out, _ = ANALYZERS[name](s)
    return f"SELECT symbol, ts, close, {', '.join(out)} FROM ({s.duck(features, out, digits)})"


def required(name: str) -> list[str]:
    """Feature columns that an analyzer reads."""
    from tapeloom.functions.sheet import TOKEN
    from tapeloom.plans.features import build

    from tapeloom.operators.base import BAR

    known = Sheet(dict(BAR))
    names = {**BAR, **build(known)}
    s = Sheet({n: "double" for n in names})
    ANALYZERS[name](s)
    used = {t for c in s.cells.values() for t in TOKEN.findall(c.spark)}
    return sorted(used & names.keys())


def coverage(features: DataFrame, least: float = 0.8) -> dict[str, tuple[float, str]]:
    """For each analyzer: share of its columns that are there, and READY or BLOCKED."""
    out = {}
    for name in ANALYZERS:
        need = required(name)
        share = sum(c in features.columns for c in need) / max(1, len(need))
        out[name] = (share, "READY" if share >= least else "BLOCKED")
    return out

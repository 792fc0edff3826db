"""Volatility and volume analyzers: how wide bars are, what trades behind them, and whether the two agree with the price."""

from __future__ import annotations

from tapeloom.functions.sheet import Sheet

from .votes import TINY, Look, Votes, band, clip, shifted

#: fixed values: oscillators of the divergence vote and their weights
OSCILLATORS = {"obv": 0.20, "cmf": 0.15, "adl": 0.15, "vpt": 0.10, "mfi": 0.10, "money_flow": 0.10, "force_index": 0.10, "accdist": 0.10}
#: fixed values: flow features that confirm a trend, and their weights
FLOWS = {"obv": 15.0, "cmf": 15.0, "vpt": 10.0, "mfi": 10.0, "force_index": 10.0, "adl": 15.0, "money_flow": 10.0, "nvi": 5.0, "pvi": 5.0, "accdist": 5.0}
LONG, MIDDLE, SHORT = 252, 20, 10


def volatility(s: Sheet) -> tuple[dict[str, str], dict[str, Votes]]:
    look = Look(s)
    atr_rank, hv_rank = look.rank("atr_14", LONG), look.rank("hv_20", LONG)
    path = look.f("sum", f"abs(close - {s.lag('close')})", SHORT - 1)
    efficiency = s.put(f"coalesce(abs(close - {s.lag('close', SHORT - 1)}) / ({path} + {TINY}), 0.0)")
    z = s.put(f"coalesce((atr_14 - {look.f('avg', 'atr_14', LONG)}) / ({look.f('stddev_samp', 'atr_14', LONG)} + {TINY}), 0.0)")
    seen = look.seen("atr_14", LONG)
    low, high = look.quantile("atr_14", 0.25, LONG), look.quantile("atr_14", 0.75, LONG)
    stays = s.put(f"CASE WHEN {atr_rank} < 25 THEN {look.run_of(seen, f'v < {low}')} WHEN {atr_rank} > 75 THEN {look.run_of(seen, f'v > {high}')} ELSE 0 END")
    ratio = s.put(f"CASE WHEN hv_20 > 0 THEN atr_14 / nullif(close, 0) * sqrt(252) * 100 / (hv_20 + {TINY}) ELSE 1.0 END")
    gaps = look.f("sum", f"CASE WHEN abs(open - {s.lag('close')}) > 0.5 * {s.lag('atr_14')} THEN 1 ELSE 0 END", MIDDLE)
    change = s.put(s.div(f"atr_14 - {s.lag('atr_14')}", s.lag("atr_14")))
    both = f"corr({change}, {s.lag(change)}) {s.rows(LONG)}"
    again = s.put(f"CASE WHEN count({s.lag(change)}) {s.rows(LONG)} > 2 THEN coalesce(nanvl({both}, 0.0), 0.0) ELSE 0.0 END", f"CASE WHEN count({s.lag(change)}) {s.rows(LONG)} > 2 THEN coalesce(CASE WHEN isnan({both}) THEN 0.0 ELSE {both} END, 0.0) ELSE 0.0 END")
    out = {"efficiency": efficiency, "atr_percentile": atr_rank, "hv_percentile": hv_rank, "regime_persistence": stays, "atr_zscore": z, "realized_ratio": ratio, "gap_frequency": gaps, "volatility_clustering": again}

    v = Votes(s)
    v.add("ATR_Rank", 40.0, (f"{atr_rank} > 90", "Extreme Volatility", 1), (f"{atr_rank} < 10", "Volatility Collapse", -1), ("true", "Normal Range", 0))
    v.add("HV_Rank", 30.0, (f"{hv_rank} > 75", "High Annualized Volatility", 1), (f"{hv_rank} < 25", "Low Annualized Volatility", -1))
    v.add("Efficiency", 30.0, (f"{efficiency} > 0.7", "Highly Efficient Move", -1), (f"{efficiency} < 0.3", "Choppy/Inefficient", 1))
    score = s.put(clip(f"1.0 * ({v.score()})", -100.0, 100.0))
    side = s.put(f"cast(sign({score}) AS int)")
    sound = "CASE WHEN hv_20 IS NOT NULL THEN 100 ELSE 70 END"
    out |= {
        "volatility_score": score, "volatility_confidence": s.put(clip(f"0.7 * ({v.weight('({p} = ' + side + ' OR {p} = 0)')}) + 0.3 * {sound}", 0.0, 100.0)),
        "volatility_regime": s.mark(shifted(score, "Extreme High Volatility", "High Volatility", "Normal Volatility", "Low Volatility / Compression", "Extreme Volatility Collapse"), "string"),
    }
    c = Votes(s)
    slope = s.put(f"100 * {look.slope('atr_14', SHORT)} / ({look.f('avg', 'atr_14', LONG)} + {TINY})")
    width = look.slope("bbw", 5)
    c.add("ATR_Slope", 50.0, (f"{slope} > 2", "ATR Expanding Rapidly", 1), (f"{slope} < -2", "ATR Contracting Rapidly", -1))
    c.add("BB_Width", 50.0, (f"{width} > 0", "Bands Expanding", 1), (f"{width} < 0", "Bands Contracting", -1), ("bbw IS NULL AND ei > 0", "Volatility Expanding", 1), ("bbw IS NULL AND ei <= 0", "Volatility Contracting", -1))
    drive = s.put(clip(f"1.0 * ({c.score()})", -100.0, 100.0))
    known = f"CASE WHEN {s.lag('close')} IS NOT NULL THEN 50.0 ELSE 0.0 END + CASE WHEN bbw IS NOT NULL OR ei IS NOT NULL THEN 50.0 ELSE 0.0 END"
    out |= {"cycle_slope": slope, "cycle_intensity": drive, "cycle_confidence": s.put(known), "cycle_phase": s.mark(shifted(drive, "Aggressive Expansion", "Expansion", "Equilibrium", "Contraction", "Aggressive Contraction"), "string")}
    q = Votes(s)
    q.add("Squeeze_Indicator", 100.0, ("sqz = 1", "Active Squeeze", -1), ("sqz IS NOT NULL", "No Active Squeeze", 0), (f"{atr_rank} < 15 AND {z} < -1.5", "Extreme Volatility Collapse (Proxy Squeeze)", -1), ("true", "Insufficient Compression", 0))
    tight = s.put(f"CASE WHEN {q.polarity(0)} < 0 THEN 1 ELSE 0 END")
    lasts = s.put(f"CASE WHEN {tight} = 0 THEN 0 WHEN sqz IS NOT NULL THEN {look.run_of(look.seen('sqz', MIDDLE), 'v = 1')} ELSE {stays} END")
    out |= {"squeeze": s.mark(f"{tight} = 1", "boolean"), "squeeze_bars": lasts, "squeeze_score": s.put(f"CASE WHEN {tight} = 0 THEN 0.0 WHEN sqz IS NOT NULL THEN least(10.0 * {lasts}, 100.0) ELSE 100.0 - {atr_rank} END"), "squeeze_confidence": s.put("CASE WHEN sqz IS NOT NULL THEN 100.0 ELSE 70.0 END")}
    b = Votes(s)
    b.add("Squeeze_Energy", 50.0, (f"{tight} = 1", "Squeeze building kinetic energy", 1))
    b.add("Cycle_Contraction", 30.0, (f"{drive} < -40", "Deep contraction phase", 1))
    b.add("Z_Score", 20.0, (f"{z} < -2", "Z-Score heavily compressed", 1))
    chance = s.put(clip(f"CASE WHEN {tight} = 1 THEN 30 + least(5.0 * {lasts}, 20.0) ELSE 0.0 END + CASE WHEN {drive} < -40 THEN 30 ELSE 0 END + CASE WHEN {z} < -2 THEN 20 ELSE 0 END", 5.0, 95.0))
    lit = b.weight("{p} = 1")
    out |= {"breakout_probability": chance, "breakout_confidence": s.put(f"CASE WHEN {lit} > 0 THEN {lit} WHEN {chance} < 20 THEN 100.0 ELSE 50.0 END")}
    return out, {"state": v, "cycle": c, "squeeze": q, "breakout": b}


def more(a: str, b: str) -> str:
    """a > b by more than the rounding of running sums."""
    return f"({a}) - ({b}) > 1e-9 * greatest(abs({a}), abs({b}))"


def pivots(s: Sheet, x: str, reach: int = 2, n: int = MIDDLE) -> dict[str, tuple[str, str]]:
    """(last, the one before) of the strict pivots that the last n bars show, high and low."""
    out = {}
    for side in ("high", "low"):
        others = [s.lag(x, reach + k) for k in range(-reach, reach + 1) if k]
        around = " AND ".join(more(s.lag(x, reach), o) if side == "high" else more(o, s.lag(x, reach)) for o in others)
        at = s.put(f"CASE WHEN {around} THEN {s.lag(x, reach)} END")
        w = s.rows(n - 2 * reach)
        held = s.put(f"collect_list({at}) {w}", f"coalesce(list({at}) FILTER (WHERE {at} IS NOT NULL) {w}, [])")
        out[side] = tuple(s.put(f"CASE WHEN size({held}) >= {k} THEN element_at({held}, -{k}) END", f"{held}[len({held}) - {k - 1}]" if k == 1 else f"CASE WHEN len({held}) >= {k} THEN {held}[len({held}) - {k - 1}] END") for k in (1, 2))
    return out


def pivot_divergence(s: Sheet, x: str) -> tuple[str, str]:
    """(type, strength): 1 and -1 regular, 2 and -2 hidden divergence of the last two pivots of price and oscillator."""
    p, o, full = pivots(s, "close"), pivots(s, x), s.put(f"count(close) {s.rows(MIDDLE)}")
    (ph, qh), (pl, ql), (oh, uh), (ol, ul) = p["high"], p["low"], o["high"], o["low"]
    kind = s.put(
        f"CASE WHEN {full} < {MIDDLE} THEN 0 WHEN {more(ph, qh)} AND {more(uh, oh)} THEN -1 WHEN {more(qh, ph)} AND {more(oh, uh)} THEN -2 "
        f"WHEN {more(ql, pl)} AND {more(ol, ul)} THEN 1 WHEN {more(pl, ql)} AND {more(ul, ol)} THEN 2 ELSE 0 END"
    )
    return kind, s.put(
        f"CASE WHEN {kind} < 0 THEN least(abs({oh} - {uh}) / (abs({uh}) + {TINY}) * CASE WHEN {kind} = -1 THEN 200.0 ELSE 150.0 END, 100.0) "
        f"WHEN {kind} > 0 THEN least(abs({ol} - {ul}) / (abs({ul}) + {TINY}) * CASE WHEN {kind} = 1 THEN 200.0 ELSE 150.0 END, 100.0) ELSE 0.0 END"
    )


def volume(s: Sheet) -> tuple[dict[str, str], dict[str, Votes]]:
    look = Look(s)
    ups = s.put(f"CASE WHEN close > ema_20 THEN 1 ELSE 0 END + CASE WHEN close > vwap THEN 1 ELSE 0 END + CASE WHEN close > {s.lag('close', 9)} THEN 1 ELSE 0 END")
    side = s.put(f"CASE WHEN {ups} >= 2 THEN 1 WHEN {ups} = 0 THEN -1 ELSE 0 END")
    v = Votes(s)
    for x, weight in FLOWS.items():
        now, then = {"cmf": ("cmf", "0.0"), "money_flow": ("money_flow", "0.0"), "mfi": ("mfi", "50.0")}.get(x, (x, s.lag(x)))
        v.add(x.upper(), weight, (f"{x} IS NULL", "Unknown", 0), (f"{more(now, then)} AND {side} = 1", "Aligned with Trend", 1), (f"{more(then, now)} AND {side} = -1", "Against Trend", -1), ("true", "Neutral/Divergent", 0))
    v.add("VWAP_RVOL", 15.0, (f"relative_volume > 1.2 AND close > vwap AND {side} = 1", "High Vol hold above VWAP", 1), (f"relative_volume > 1.2 AND close < vwap AND {side} = -1", "High Vol rejection below VWAP", -1))
    every = sum(FLOWS.values()) + 15.0
    there = s.put(" + ".join([*(f"CASE WHEN {x} IS NOT NULL THEN {w!r} ELSE 0.0 END" for x, w in FLOWS.items()), "CASE WHEN vwap IS NOT NULL AND relative_volume IS NOT NULL THEN 15.0 ELSE 0.0 END"]))
    score = s.put(clip(f"100 * {s.div(v.score(), there, '0.0')}", -100.0, 100.0))
    agree = s.put(s.div(v.weight("{p} = " + s.put(f"cast(sign({score}) AS int)")), there, "0.0"))
    out = {
        "volume_trend": side, "confirmation_score": score, "confirmation_confidence": s.put(clip(f"40 * {there} / {every!r} + 60 * {agree}", 0.0, 100.0)),
        "confirmation": s.mark(shifted(score, "Strong Bullish", "Bullish", "Neutral", "Bearish", "Strong Bearish", 50, 15), "string"),
    }
    relative, share, z = s.put("coalesce(relative_volume, 1.0)"), s.put("coalesce(volume_percentile, 50.0)"), s.put("coalesce(volume_zscore, 0.0)")
    spread, body = s.put(f"high - low + {TINY}"), s.put("abs(close - open)")
    e = Votes(s)
    e.add("Percentile", 40.0, (f"{share} > 95 OR {z} > 3", "Extreme Z-Score", 1), (f"{share} > 80", "High Volume Regime", 1), (f"{share} < 20", "Volume Dry-up", -1))
    rises = " AND ".join(f"{s.lag('volume', k)} > {s.lag('volume', k + 1)}" if k else f"volume > {s.lag('volume')}" for k in range(3))
    e.add("Velocity", 30.0, (rises, "Multi-bar Acceleration", 1))
    e.add("Climax", 30.0, (f"{relative} > 2.5 AND {body} / {spread} < 0.3", "Climax/Exhaustion Risk", -1))
    climax = s.put(f"CASE WHEN {e.polarity(2)} IS NOT NULL AND atr IS NOT NULL THEN 1 ELSE 0 END")
    burst = s.put(f"CASE WHEN {share} > 95 OR {z} > 3 THEN 40.0 WHEN {share} > 80 THEN 25.0 ELSE 0.0 END + CASE WHEN {e.polarity(1)} = 1 THEN 30.0 ELSE 0.0 END + 30.0 * {climax}")
    told = f"CASE WHEN volume_percentile IS NOT NULL THEN 40.0 ELSE 0.0 END + CASE WHEN {s.lag('volume', 5)} IS NOT NULL THEN 30.0 ELSE 0.0 END + CASE WHEN atr IS NOT NULL THEN 30.0 ELSE 0.0 END"
    explosive = s.mark(f"CASE WHEN {climax} = 1 THEN 'Climax (Exhaustion)' WHEN {burst} >= 80 THEN 'Explosive' WHEN {burst} >= 50 THEN 'Expanding' WHEN {burst} >= 20 THEN 'Building' ELSE 'Dormant' END", "string")
    out |= {"explosion_score": burst, "explosion": explosive, "explosion_confidence": s.put(told)}

    d = Votes(s)
    d.add("Del_Pct", 30.0, ("delivery_percent > 60", "High Delivery", 1))
    place = look.rank("delivery_percent", MIDDLE)
    full = f"{s.lag('close', MIDDLE)} IS NOT NULL"
    d.add("Del_Rank", 20.0, (f"{full} AND {place} > 80", "Top 20d Rank", 1))
    d.add("Del_ZScore", 20.0, (f"{full} AND (delivery_percent - {look.f('avg', 'delivery_percent', MIDDLE)}) / ({look.f('stddev_samp', 'delivery_percent', MIDDLE)} + {TINY}) > 2", "Statistical Anomaly", 1))
    heavy = f"delivery_quantity > 1.5 * {look.f('avg', 'delivery_quantity', SHORT)}"
    d.add("Quantity", 30.0, (f"{heavy} AND close > {s.lag('close')}", "Heavy Delivery (Up Day)", 1), (f"{heavy} AND close < {s.lag('close')}", "Heavy Delivery (Down Day)", -1))
    delivered = s.put(f"CASE WHEN delivery_percent IS NULL THEN 0.0 ELSE {clip(f'1.0 * ({d.score()})', -100.0, 100.0)} END")
    torn = f"{d.weight('{p} = 1')} > 0 AND {d.weight('{p} = -1')} > 0"
    out |= {
        "delivery_score": delivered, "delivery_confidence": s.put(f"CASE WHEN delivery_percent IS NULL THEN 0.0 ELSE CASE WHEN delivery_quantity IS NOT NULL THEN 100.0 ELSE 60.0 END - CASE WHEN {torn} THEN 30.0 ELSE 0.0 END END"),
        "delivery": s.mark(f"CASE WHEN delivery_percent IS NULL THEN 'Unavailable' ELSE {shifted(delivered, 'Strong Accumulation', 'Mild Accumulation', 'Neutral', 'Mild Distribution', 'Strong Distribution')} END", "string"),
    }

    found = {x: pivot_divergence(s, x) for x in OSCILLATORS}
    weight = s.put(" + ".join(f"CASE WHEN {x} IS NOT NULL AND {s.lag('close', MIDDLE - 1)} IS NOT NULL THEN {w!r} ELSE 0.0 END" for x, w in OSCILLATORS.items()))
    votes = {k: s.put(" + ".join(f"CASE WHEN {x} IS NOT NULL AND {found[x][0]} = {k} THEN {w!r} * {found[x][1]} ELSE 0.0 END" for x, w in OSCILLATORS.items())) for k in (1, -1, 2, -2)}
    most = s.put(f"greatest({', '.join(votes.values())})")
    kind = s.put(f"CASE WHEN {weight} = 0 OR {most} = 0 THEN 0 " + " ".join(f"WHEN {c} = {most} THEN {k}" for k, c in votes.items()) + " ELSE 0 END")
    same = f"CASE WHEN {kind} > 0 THEN {votes[1]} + {votes[2]} ELSE {votes[-1]} + {votes[-2]} END"
    strength = s.put(f"CASE WHEN {kind} = 0 THEN 0.0 ELSE {clip(f'{most} / {weight}', 0.0, 100.0)} END")
    out |= {
        "divergence": s.mark(f"CASE {kind} WHEN 1 THEN 'Regular Bullish' WHEN -1 THEN 'Regular Bearish' WHEN 2 THEN 'Hidden Bullish' WHEN -2 THEN 'Hidden Bearish' ELSE 'None' END", "string"),
        "divergence_strength": strength, "divergence_confidence": s.put(f"CASE WHEN {kind} <> 0 THEN {clip(f'100 * ({same}) / {weight}', 0.0, 100.0)} WHEN {weight} > 0.5 THEN 100.0 ELSE 50.0 END"),
    }

    mean = look.f("avg", "volume", MIDDLE)
    steady = s.put(clip(f"100 * (1 - ({look.f('stddev_samp', 'volume', MIDDLE)} + {TINY}) / ({mean} + {TINY}))", 0.0, 100.0))
    dry = s.put(f"CASE WHEN {share} < 15 THEN 1 ELSE 0 END")
    smart = s.put(clip(f"0.6 * {delivered} + 0.4 * {score}", 0.0, 100.0))
    crowd = s.put(clip(f"{burst} - {smart}", 0.0, 100.0))
    flow = look.f("sum", f"(close - {s.lag('close')}) / (high - low + {TINY}) * volume", MIDDLE)
    dark = s.put(s.flag(f"{relative} > 2 AND {spread} < 0.15 * coalesce(atr, {TINY})"))
    block = s.put(s.flag(f"{relative} > 3 AND {share} > 90 AND {spread} < coalesce(atr, {TINY})"))
    out |= {
        "volume_quality": s.put(clip(f"({score} + 100) / 2", 0.0, 100.0)), "volume_efficiency": s.put(clip(f"{body} / (volume + {TINY}) * 1000000", 0.0, 100.0)),
        "participation": s.mark(f"CASE WHEN {smart} > 60 THEN 'Smart Accumulation' WHEN {crowd} > 60 THEN 'Retail Speculation' ELSE 'Equilibrium' END", "string"), "smart_participation": smart, "retail_participation": crowd,
        "volume_stability": steady, "volume_persistence": burst, "volume_dry_up": s.mark(f"{dry} = 1", "boolean"), "regime_shift": s.mark(s.flag(f"{explosive} = 'Explosive' AND {s.lag('volume')} < {mean}"), "boolean"),
        "liquidity_absorption": s.put(f"CASE WHEN {burst} > 50 AND {body} < 0.5 * coalesce(atr, {TINY}) THEN 80.0 ELSE 0.0 END"), "volume_compression": s.put(f"CASE WHEN {dry} = 1 THEN 100.0 - {share} ELSE 0.0 END"), "volume_expansion": s.put(clip(burst, 0.0, 100.0)),
        "block_trade": s.mark(block, "boolean"), "dark_pool": s.mark(dark, "boolean"), "volume_fractal": s.put(f"CASE WHEN {full} THEN 100 * {flow} / ({mean} * {MIDDLE} + {TINY}) ELSE 0.0 END"),
    }

    m = Votes(s)
    marks = [(f"coalesce({x}, 0) <> 0", f"Structure {x.upper()} Active") for x in ("ob_active", "fvg_active", "liq_sweep", "bos", "choch", "breaker_block", "mitigation_block")]
    for test, text in marks:
        m.add("SMC", 20.0, (test, text, 1))
    m.add("Dark_Pool", 25.0, (dark, "Dark Pool / Hidden Absorption Proxy", 1))
    m.add("Block_Trade", 20.0, (block, "Institutional Block Trade Profile", 1))
    m.add("Delivery", 15.0, (f"{delivered} > 40", "Validates Smart Accumulation", 1))
    structured = " OR ".join(t for t, _ in marks)
    m.add("Retail_Trap", 35.0, (f"NOT ({structured}) AND {burst} > 50 AND (rsi > 70 OR rsi < 30)", "Explosive Vol at Extreme w/o Structure", -1))
    m.add("Divergence", 15.0, (f"{kind} <> 0 AND {strength} > 50", "Volume Divergence flags weakness", -1))
    n = len(marks)
    trap, weak = f"{m.polarity(n + 3)} = -1", f"{m.polarity(n + 4)} = -1"
    # every piece of evidence takes its share of the doubt that is left
    doubt = "0.5" + "".join(f" * CASE WHEN {m.polarity(i)} = 1 THEN {1 - w!r} ELSE 1.0 END" for i, w in enumerate([0.20] * n + [0.25, 0.20, 0.15]))
    big = s.put(f"100 * (1 - {doubt}) * CASE WHEN {trap} THEN 0.8 ELSE 1.0 END")
    small = s.put(f"100 * (1 - 0.5 * CASE WHEN {trap} THEN 0.65 ELSE 1.0 END * CASE WHEN {weak} THEN 0.85 ELSE 1.0 END)")
    out |= {
        "institutional_probability": big, "retail_probability": small, "smart_confidence": s.put(clip(f"({big} + {small}) / 2 + 30", 20.0, 95.0)),
        "dominance": s.mark(f"CASE WHEN {big} > {small} + 20 THEN 'Institutional' WHEN {small} > {big} + 20 THEN 'Retail' ELSE 'Mixed' END", "string"),
    }
    return out, {"confirmation": v, "explosion": e, "delivery": d, "smart_volume": m}


__all__ = ["band", "volatility", "volume"]

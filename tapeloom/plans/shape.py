"""Candle, chart pattern and support/resistance analyzers: what the last bars look like and where the price stands."""

from __future__ import annotations

from tapeloom.functions.sheet import Sheet

from .votes import TINY, Look, Votes, clip

#: fixed values: likelihood ratios of events by regime, for a rising and a falling context
LIKELIHOODS = {
    "bullish_expansion": {"structure": (4.12, 0.31), "sweep": (3.45, 0.42), "momentum": (2.68, 2.68)},
    "bearish_expansion": {"structure": (0.28, 4.35), "sweep": (0.39, 3.62), "momentum": (2.81, 2.81)},
    "mean_reverting": {"structure": (1.42, 1.42), "sweep": (4.65, 4.65), "momentum": (0.88, 0.88)},
}
#: fixed values: prior chances, and what a ratio counts after the first event
REVERSAL, CONTINUATION, AGAIN = 0.15, 0.60, 0.40


def fused(s: Sheet, prior: float, regime: str, rising: str, events: list[tuple[str, str]]) -> str:
    """Chance after the events (kind, test) that hold: odds of the prior times their likelihood ratios, of which those after
    the first count only in part."""
    odds, seen = repr(prior / (1 - prior)), "0"
    for kind, test in events:
        on = s.put(s.flag(test))
        ratio = s.put("CASE " + " ".join(f"WHEN {regime} = '{r}' THEN CASE WHEN {rising} THEN {x[kind][0]!r} ELSE {x[kind][1]!r} END" for r, x in LIKELIHOODS.items()) + " END")
        odds = s.put(f"{odds} * CASE WHEN NOT {on} THEN 1.0 WHEN {seen} = 0 THEN {ratio} ELSE 1 + ({ratio} - 1) * {AGAIN!r} END")
        seen = s.put(f"{seen} + CASE WHEN {on} THEN 1 ELSE 0 END")
    return s.put(clip(f"{odds} / (1 + {odds})", 0.001, 0.999))


def candles(s: Sheet) -> tuple[dict[str, str], dict[str, Votes]]:
    """Bodies count as shares of the bar's range."""
    body, busy = s.put("coalesce(body_pct, 0.0) / 100"), s.put("coalesce(volume_ratio, 0.0)")
    swept, turn = s.put("coalesce(liquidity_sweep, 0)"), s.put("coalesce(trend_direction, 0)")
    path, wild = s.put("coalesce(efficiency_ratio, 0.0)"), s.put("coalesce(normalized_volatility, 0.0)")
    regime = s.mark(f"CASE WHEN {path} > 0.55 AND {wild} > 0.05 THEN CASE WHEN {turn} >= 0 THEN 'bullish_expansion' ELSE 'bearish_expansion' END ELSE 'mean_reverting' END", "string")
    market = s.put(clip(f"60 * {path} + 100 * {wild}", 0.0, 100.0))
    v = Votes(s)
    v.add("Wyckoff", 35.0, (f"{swept} = 1", "Spring Grab", 1), (f"{swept} = -1", "Upthrust Grab", -1))
    v.add("Auction_Expansion", 20.0, (f"{body} > 0.7 AND {busy} > 1.2 AND close > open", "Expansion", 1), (f"{body} > 0.7 AND {busy} > 1.2", "Expansion", -1))
    v.add("Effort_Vs_Result", 25.0, (f"{busy} > 1.5 AND {body} < 0.3 AND {turn} > 0", "Absorption", -1), (f"{busy} > 1.5 AND {body} < 0.3 AND {turn} < 0", "Absorption", 1), (f"{busy} > 1.5 AND {body} < 0.3", "Absorption", 0))
    score = s.put(clip(f"1.0 * ({v.score()})", -100.0, 100.0))
    out = {
        "candle_regime": regime, "market_quality": market, "psychology_score": score,
        "psychology": s.mark(f"CASE WHEN abs({score}) > 25 AND {body} < 0.4 THEN 'Institutional Absorption' WHEN abs({score}) > 20 THEN 'Trend Expansion' ELSE 'Equilibrium' END", "string"),
        "emotion": s.mark(f"CASE WHEN {swept} <> 0 THEN 'Panic/Trap' ELSE 'Indecision' END", "string"), "auction": s.mark(f"CASE WHEN abs({score}) > 25 THEN 'Imbalanced State' ELSE 'Symmetrical Balance' END", "string"),
    }
    bulls = s.put(clip("50 * (clv + 1) + CASE WHEN bull_sequence >= 3 THEN 5 * bull_sequence ELSE 0 END - CASE WHEN bear_sequence >= 3 THEN 5 * bear_sequence ELSE 0 END", 0.0, 100.0))
    out |= {
        "bull_power_pct": bulls, "bear_power_pct": s.put(f"100 - {bulls}"), "control_score": s.put("100 * abs(clv)"),
        "candle_dominance": s.mark(f"CASE WHEN {bulls} > 60 THEN 'Bullish Auction Control' WHEN {bulls} < 40 THEN 'Bearish Auction Control' ELSE 'Auction Rotation Equilibrium' END", "string"),
    }
    changed = s.put("coalesce(choch, 0)")
    r = Votes(s)
    r.add("CHoCH", 40.0, (f"{changed} > 0", "Protected Break", 1), (f"{changed} < 0", "Protected Break", -1))
    r.add("Sweep", 35.0, (f"{swept} > 0", "Stop Hunting", 1), (f"{swept} < 0", "Stop Hunting", -1))
    back = fused(s, REVERSAL, regime, f"({changed} > 0 OR {swept} > 0 OR clv > 0)", [("structure", f"{changed} <> 0"), ("sweep", f"{swept} <> 0")])
    on = fused(s, CONTINUATION, regime, f"({turn} >= 0)", [("structure", f"bos <> 0 AND bos = {turn}"), ("momentum", "abs(clv) > 0.4")])
    trap = s.put(f"CASE WHEN {swept} <> 0 THEN 150 * {back} ELSE 15.0 END")
    out |= {
        "reversal_probability": s.put(f"100 * {back}"), "reversal_direction": s.mark(f"CASE WHEN {changed} > 0 OR {swept} > 0 THEN 'Bullish' WHEN {changed} < 0 OR {swept} < 0 THEN 'Bearish' ELSE 'None' END", "string"),
        "reversal_quality": s.mark(f"CASE WHEN {back} > 0.65 THEN 'Confirmed Structural Reversal Zone' ELSE 'Trend Profile Intact' END", "string"), "trap_probability": trap,
        "candle_continuation_probability": s.put(f"100 * {on}"), "candle_continuation": s.mark(f"CASE WHEN {on} > 0.7 THEN 'Institutional Orderflow Expansion' ELSE 'Mean Reverting Compression' END", "string"),
    }
    gap, taken = s.put(s.flag("gap_up = 1 OR gap_down = 1")), s.put(f"{body} > 0.5")
    out |= {
        "gap_type": s.mark(f"CASE WHEN NOT {gap} THEN 'None' WHEN {busy} > 1.5 AND {taken} THEN 'Sovereign Breakaway Gap' ELSE 'Common Auction Variance' END", "string"), "gap_accepted": s.mark(f"{gap} AND {taken}", "boolean"),
        "gap_fill_probability": s.put(f"CASE WHEN NOT {gap} THEN 0.0 WHEN {taken} THEN 100 - {clip(f'30 * {busy} + 40 * {body}', 10.0, 95.0)} ELSE {clip(f'85 - 20 * {busy}', 20.0, 95.0)} END"),
    }
    # a sweep and a change are told by nearly sure sources, a proxy counts less
    sure = [(v, (0.85, 1.0, 1.0)), (r, (1.0, 0.85))]
    side = {p: s.put(" + ".join(f"CASE WHEN {x.polarity(i)} = {p} THEN {x.items[i][1] * k!r} ELSE 0.0 END" for x, ks in sure for i, k in enumerate(ks))) for p in (1, -1)}
    total = s.put(f"{side[1]} + {side[-1]} + {TINY}")
    conflict = s.put(f"100 * least({side[1]}, {side[-1]}) / {total}")
    up, down = s.put("high - greatest(open, close)"), s.put("least(open, close) - low")
    optional = ["volume", path, wild, swept, "bull_sequence", "bear_sequence", "gap_up", "gap_down", busy, body, up, down]
    lost = s.put(" + ".join(f"CASE WHEN coalesce({x}, 0) = 0 THEN 1 ELSE 0 END" for x in optional))
    trust = s.put(clip(f"100 * greatest({side[1]}, {side[-1]}) / {total} - 30.0 * {lost} / {len(optional)}", 0.0, 100.0))
    own = s.put(f"cast(sign({score}) AS int)")
    agrees, against = v.weight("{p} = " + own), v.weight("{p} <> " + own)
    accepted = s.put(f"100 * {agrees} / ({agrees} + {against} + {TINY})")
    out |= {
        "candle_quality": s.put(f"abs({score})"), "rejection_index": against, "acceptance_index": agrees, "smart_money_conviction": s.put(f"clv * {on}"), "institutional_conviction": s.put("abs(clv)"),
        "auction_balance": s.put(f"100 - {conflict}"), "price_acceptance": accepted, "price_rejection": s.put(f"100 - {accepted}"), "conviction_decay": s.put(f"CASE WHEN {busy} > 1 THEN greatest(100 - 100 * {path}, 0.0) ELSE 50.0 END"),
        "price_discovery": s.put(f"least(50 * {path} * {busy}, 100.0)"), "liquidity_utilization": s.put(f"least(100 * ({up} + {down}) / (high - low + {TINY}) * least({busy}, 3.0) / 3, 100.0)"), "candle_confidence": trust,
    }
    return out, {"psychology": v, "reversal": r}


#: fixed values: weights of a pattern's confidence, of the market's regime, and of false breakouts by pattern
PATTERN_WEIGHTS = {"volume": 20.0, "structure": 25.0, "trend": 15.0, "efficiency": 10.0, "regime": 10.0, "evidence": 20.0}
REGIMES = {"Trending": 10.0, "Accumulation": 8.0, "Distribution": 8.0, "Volatile": 6.0, "Compression": 5.0, "Mean Reversion": 4.0}
FALSE = {"FLAG": 0.8, "PENNANT": 0.8, "CUP_HANDLE": 0.7, "ROUNDING_BOTTOM": 0.7, "ROUNDING_TOP": 0.7, "TRIANGLE": 1.2}


def by_regime(weights: dict[str, float], other: float) -> str:
    return "CASE market_regime " + " ".join(f"WHEN '{k}' THEN {w!r}" for k, w in weights.items()) + f" ELSE {other!r} END"


def chart(s: Sheet) -> tuple[dict[str, str], dict[str, Votes]]:
    """Triangles, flags and pennants, cups and roundings, each with stop, target and chances; and the first of all patterns."""
    trend = s.put("CASE WHEN trend_direction > 0.1 THEN 1 WHEN trend_direction < -0.1 THEN -1 ELSE 0 END")
    sure, path = s.put("coalesce(pattern_confidence, 0.0)"), s.put("coalesce(efficiency_ratio, 0.0)")
    backed, strong = s.put("coalesce(volume_confirmation, 0.0)"), s.put("coalesce(trend_strength, 0.0)")
    traded = s.put(clip(f"33.3 * {backed}", 0.0, 100.0))
    context = by_regime(REGIMES, 5.0)
    w = PATTERN_WEIGHTS

    def judged(reliability: float) -> tuple[str, str]:
        """(confidence, quality) of a pattern whose evidence has this reliability."""
        points = f"{reliability * w['evidence']!r} + CASE WHEN {backed} >= 1.2 THEN {w['volume']!r} ELSE 0.0 END + {w['trend'] / 100!r} * {strong} + {w['structure'] / 100!r} * {sure} + {w['efficiency']!r} * {path} + {w['regime'] / 10!r} * ({context})"
        return s.put(clip(f"100 * ({points}) / {sum(w.values())!r}", 0.0, 100.0)), s.put(clip(f"0.5 * {sure} + 30 * {path} + {20 * reliability!r}", 0.0, 100.0))

    def stop(side: str, levels: list[str], swing_low: str = "swing_low", swing_high: str = "swing_high") -> str:
        """Half a range beyond the nearest level on the far side of the entry, or two ranges away."""
        below = ", ".join([*(f"CASE WHEN {x} > 0 AND {x} < close THEN {x} END" for x in (*levels, swing_low)), "cast(NULL AS double)"])
        above = ", ".join([*(f"CASE WHEN {x} > close THEN {x} END" for x in (*levels, swing_high)), "cast(NULL AS double)"])
        return s.put(f"CASE WHEN {side} > 0 THEN coalesce(greatest({below}), close - 1.5 * atr) - 0.5 * atr ELSE coalesce(least({above}), close + 1.5 * atr) + 0.5 * atr END")

    v = Votes(s)
    out: dict[str, str] = {}
    forms = {
        "triangle": ("triangle_detected > 0", f"CASE WHEN triangle_type = 'Ascending' THEN 1 WHEN triangle_type = 'Descending' THEN -1 WHEN {trend} = 0 THEN 1 ELSE {trend} END", "'TRIANGLE'", "concat(coalesce(triangle_type, 'Symmetrical'), ' Triangle')", 0.85, 3.0, ["triangle_lower", "triangle_upper"]),
        "flag": ("(flag_detected > 0 OR pennant_detected > 0)", f"CASE WHEN {trend} = 0 THEN 1 ELSE {trend} END", "CASE WHEN pennant_detected > 0 THEN 'PENNANT' ELSE 'FLAG' END", f"concat(CASE WHEN {trend} < 0 THEN 'Bear ' ELSE 'Bull ' END, CASE WHEN pennant_detected > 0 THEN 'Pennant' ELSE 'Flag' END)", 0.90, 4.0, ["channel_lower", "channel_upper"]),
        "cup": ("(cup_detected > 0 OR rounding_top_detected > 0 OR rounding_bottom_detected > 0)", "CASE WHEN rounding_top_detected > 0 THEN -1 ELSE 1 END", "CASE WHEN rounding_top_detected > 0 THEN 'ROUNDING_TOP' WHEN handle_detected > 0 THEN 'CUP_HANDLE' ELSE 'ROUNDING_BOTTOM' END", "CASE WHEN rounding_top_detected > 0 THEN 'Rounding Top' WHEN handle_detected > 0 THEN 'Cup and Handle' ELSE 'Rounding Bottom' END", 0.88, 5.0, ["neckline"]),
    }
    made = {}
    for name, (test, side, code, title, reliability, reach, levels) in forms.items():
        there, side = s.put(s.flag(test)), s.put(side)
        sureness, quality = judged(reliability)
        entry_stop, target = stop(side, levels), s.put(f"close + {reach!r} * atr * {side}")
        chance = {"triangle": f"60 + 0.2 * {sureness}", "flag": f"60 + 0.25 * {sureness}", "cup": f"60 + 0.2 * {sureness}"}[name]
        fails = {"triangle": f"40 - 0.2 * {quality}", "flag": f"40 - 0.1 * {sureness}", "cup": "30.0"}[name]
        of = lambda x, other="0.0", there=there: f"CASE WHEN {there} THEN {x} ELSE {other} END"
        made[name] = (there, side, s.mark(of(code, "'NONE'"), "string"), s.put(of(sureness)), s.put(of(quality)))
        out |= {
            f"{name}_pattern_found": s.mark(there, "boolean"), f"{name}_pattern_name": s.mark(of(title, "'None'"), "string"), f"{name}_pattern_direction": s.mark(of(f"CASE WHEN {side} > 0 THEN 'Bullish' ELSE 'Bearish' END", "'Neutral'"), "string"),
            f"{name}_pattern_confidence": made[name][3], f"{name}_pattern_quality": made[name][4], f"{name}_pattern_breakout": s.put(of(clip(chance, 0.0, 100.0))), f"{name}_pattern_failure": s.put(of(clip(fails, 0.0, 100.0))),
            f"{name}_pattern_stop": s.put(of(entry_stop)), f"{name}_pattern_target": s.put(of(target)), f"{name}_pattern_reward_risk": s.put(of(f"abs({target} - close) / (abs(close - {entry_stop}) + {TINY})")),
        }
        v.add({"triangle": "Volatility_Contraction", "flag": "Healthy_Retracement", "cup": "Absorption_Curve"}[name], {"triangle": 30.0, "flag": 20.0, "cup": 35.0}[name], (f"{there} AND {side} > 0", "Bullish", 1), (there, "Bearish", -1))
    # cups come before triangles, triangles before flags
    first = s.mark("CASE " + " ".join(f"WHEN {made[n][0]} THEN {made[n][2]}" for n in ("cup", "triangle", "flag")) + " ELSE 'NONE' END", "string")
    some = " OR ".join(m[0] for m in made.values())
    for kind, sign in (("continuation", "="), ("reversal", "<>")):
        with_it = " + ".join(f"CASE WHEN {there} AND {f'{side} = {trend} AND {trend} <> 0' if kind == 'continuation' else f'({side} <> {trend} OR {trend} = 0)'} THEN 1 ELSE 0 END" for there, side, *_ in made.values())
        out[f"{kind}_patterns"] = s.put(with_it)
    best, finest = s.put(f"greatest({', '.join(m[3] for m in made.values())})"), s.put(f"greatest({', '.join(m[4] for m in made.values())})")
    trust = s.put(clip(f"0.4 * {best} + 0.3 * {sure} + 0.3 * {traded}", 0.0, 100.0))
    share = "CASE " + " ".join(f"WHEN {first} = '{k}' THEN {x!r}" for k, x in FALSE.items()) + " ELSE 1.0 END"
    fooled = s.put(f"CASE WHEN {some} THEN {clip(f'(0.3 * (100 - {finest}) + 0.3 * (100 - {traded}) + 0.2 * (100 - coalesce(breakout_strength, 0.0)) + CASE WHEN liquidity_sweep <> 0 THEN 15.0 ELSE 0.0 END - ({context})) * ({share})', 0.0, 100.0)} ELSE 50.0 END")
    out |= {
        "pattern": first, "pattern_quality": finest, "structural_integrity": sure, "breakout_readiness": best, "false_breakout_probability": fooled, "pattern_completion": s.put(f"least(1.2 * {best}, 100.0)"),
        "pattern_maturity": s.mark(f"CASE WHEN {best} > 80 THEN 'Breakout Imminent' WHEN {best} > 50 THEN 'Developing' ELSE 'Forming' END", "string"), "volume_score": traded,
        "pattern_conviction": s.put(clip(f"0.4 * {finest} + 0.4 * {traded} + 2.0 * ({context})", 0.0, 100.0)), "pattern_reliability": s.put(f"0.9 * {trust}"), "market_context": strong, "pattern_trust": trust,
    }

    # what the other detectors say, most telling first
    order = (
        ("Inverse Head & Shoulders", "ihs_detected = 1", 1), ("Head & Shoulders", "hs_detected = 1", -1), ("Triple Bottom", "triple_bottom_detected = 1", 1), ("Triple Top", "triple_top_detected = 1", -1),
        ("Double Bottom", "double_bottom_detected = 1", 1), ("Double Top", "double_top_detected = 1", -1), ("Wedge", "wedge_detected = 1", 0), ("Channel", "channel_detected = 1", 0), ("Rectangle", "rectangle_detected = 1", 0),
    )
    for name, test, side in order:
        v.add(name, 10.0, (test, name, side))
    out["other_pattern"] = s.mark("CASE " + " ".join(f"WHEN {t} THEN '{n}'" for n, t, _ in order) + " ELSE 'None' END", "string")
    out["other_pattern_side"] = s.put("CASE " + " ".join(f"WHEN {t} THEN {p if p else trend}" for _, t, p in order) + " ELSE 0 END")
    return out, {"patterns": v}


#: fixed values: points of institutional evidence, weights of a level's confidence, and what a regime makes of it
BONUS = {"sweep": 15.0, "order_block": 20.0, "fvg": 15.0, "choch": 25.0, "volume": 30.0, "quiet": 20.0, "retest": 15.0}
LEVEL_REGIMES = {"Trending": 1.2, "Mean Reversion": 0.8, "Volatile": 0.9, "Accumulation": 1.1, "Distribution": 0.7}
NEAR, CLEAR, MOST = 0.015, 0.005, 98.5


def support_resistance(s: Sheet) -> tuple[dict[str, str], dict[str, Votes]]:
    backed, strong, sure = s.put("coalesce(volume_confirmation, 0.0)"), s.put("coalesce(trend_strength, 0.0)"), s.put("coalesce(pattern_confidence, 0.0)")
    swept, block, gap, changed, broke, turn = (s.put(f"coalesce({c}, 0)") for c in ("liquidity_sweep", "order_block", "fvg", "choch", "bos", "trend_direction"))
    wide = s.put("greatest(coalesce(channel_width, 0.0), coalesce(rectangle_width, 0.0), coalesce(abs(triangle_upper - triangle_lower), 0.0))")
    near = s.put(f"100 * CASE WHEN {wide} > {TINY} THEN 0.15 * {wide} ELSE {NEAR!r} * close END / close")
    traded = s.put(clip(f"20 * {backed}", 0.0, 100.0))
    v = Votes(s)
    out: dict[str, str] = {}
    held: dict[str, dict[str, str]] = {}
    for side, sign, pick, test in (("support", 1, "greatest", "<"), ("resistance", -1, "least", ">")):
        edge, extreme = ("lower", "swing_low") if sign > 0 else ("upper", "swing_high")
        names = {"Swing Low" if sign > 0 else "Swing High": extreme, f"Channel {edge.title()}": f"channel_{edge}", f"Triangle {edge.title()}": f"triangle_{edge}", f"Rectangle {edge.title()}": f"rectangle_{edge}", "Neckline": "neckline"}
        valid = {n: s.put(f"CASE WHEN {c} > {TINY} AND {c} {test} close THEN {c} END") for n, c in names.items()}
        level = s.put(f"{pick}({', '.join(valid.values())})")
        kind = s.mark(f"CASE WHEN {level} IS NULL THEN 'None' " + " ".join(f"WHEN {c} = {level} THEN '{n}'" for n, c in valid.items()) + " ELSE 'None' END", "string")
        away = s.put(f"CASE WHEN {level} IS NULL THEN 0.0 ELSE 100 * abs(close - {level}) / close END")
        v.add("Liquidity Sweep", BONUS["sweep"], (f"{swept} = {sign}", "Liquidity swept beyond the level", sign))
        v.add("Order Block", BONUS["order_block"], (f"{block} = {sign}", "Price at an order block", sign))
        big = s.put(f"CASE WHEN {swept} = {sign} THEN {BONUS['sweep']!r} ELSE 0.0 END + CASE WHEN {block} = {sign} THEN {BONUS['order_block']!r} ELSE 0.0 END")
        weight = s.put(f"CASE WHEN market_regime = 'Trending' AND {turn} * {sign} < 0 THEN 0.8 ELSE {by_regime(LEVEL_REGIMES, 1.0)} END")
        raw = f"(0.35 * coalesce({side}_strength, 0.0) + 0.25 * {traded} + 0.25 * {big}) * {weight}"
        trust = s.put(f"CASE WHEN {level} IS NULL THEN 0.0 ELSE {clip(raw, 0.0, MOST)} END")
        held[side] = {"level": level, "away": away, "trust": trust, "big": s.put(f"{big} > 0")}
        out |= {side: level, f"{side}_type": kind, f"{side}_confidence": trust, f"{side}_quality": s.put(f"{trust} * CASE WHEN {away} < 2 THEN 1.0 ELSE 0.8 END"), f"{side}_distance_pct": away, f"institutional_{side}": s.mark(held[side]["big"], "boolean")}
    sup, res = held["support"], held["resistance"]
    wanted = "CASE WHEN market_regime IN ('Mean Reversion', 'Accumulation') THEN 32.0 ELSE 40.0 END"
    holding = s.put(s.flag(f"{sup['level']} IS NOT NULL AND {sup['away']} < {near} AND ({strong} > {wanted} OR {sup['big']})"))
    out["support_holding"] = s.mark(holding, "boolean")

    drive = s.put(clip(f"0.3 * coalesce(breakout_pressure, 0.0) + 0.2 * coalesce(compression_pct, 0.0) + 0.3 * {strong} + 20 * {backed}", 0.0, 100.0))
    moves: dict[str, dict[str, str]] = {}
    for name, sign, lvl, quiet in (("breakout", 1, res["level"], "('Mean Reversion', 'Distribution')"), ("breakdown", -1, sup["level"], "('Mean Reversion', 'Accumulation')")):
        cleared = f"close > {lvl} * {1 + CLEAR!r}" if sign > 0 else f"close < {lvl} * {1 - CLEAR!r}"
        on = s.put(s.flag(f"{broke} = {sign} OR {cleared}"))
        points = s.put(f"CASE WHEN {backed} > 1.2 THEN {BONUS['volume']!r} ELSE 0.0 END + CASE WHEN {gap} = {sign} THEN {BONUS['fvg']!r} ELSE 0.0 END + CASE WHEN {changed} = {sign} THEN {BONUS['choch']!r} ELSE 0.0 END")
        risk = s.put(f"CASE WHEN {on} THEN {clip(f'CASE WHEN market_regime IN {quiet} THEN 60.0 ELSE 20.0 END + CASE WHEN {backed} > 1.2 THEN 0.0 ELSE {BONUS['quiet']!r} END - 0.4 * {drive} - 0.2 * {sure}', 0.0, 100.0)} ELSE 0.0 END")
        quality = s.put(f"CASE WHEN {on} THEN {clip(f'{points} + {drive} - {risk}', 0.0, MOST)} ELSE 0.0 END")
        confirmed = s.put(f"{on} AND {quality} > 60 AND {backed} > 1")
        big = s.put(f"{on} AND ({gap} = {sign} OR {changed} = {sign})")
        goes_on = s.put(f"({on} AND {gap} = {sign}) OR {quality} > 75")
        moves[name] = {"on": on, "risk": risk, "quality": quality, "confirmed": confirmed, "big": big, "goes_on": goes_on}
        v.add("Volume", BONUS["volume"], (f"{on} AND {backed} > 1.2", f"{name.title()} supported by volume", sign))
        v.add("Fair Value Gap", BONUS["fvg"], (f"{on} AND {gap} = {sign}", "Gap left behind", sign))
        out |= {
            name: s.mark(on, "boolean"), f"{name}_type": s.mark(f"CASE WHEN {broke} = {sign} THEN 'Structural BOS' WHEN {on} THEN 'Geometrical' ELSE 'None' END", "string"), f"{name}_drive": s.put(f"CASE WHEN {on} THEN {drive} ELSE 0.0 END"),
            f"{name}_quality": quality, f"{name}_confirmed": s.mark(confirmed, "boolean"), f"false_{name}_risk": risk, f"institutional_{name}": s.mark(big, "boolean"), f"{name}_continues": s.mark(goes_on, "boolean"),
        }
    up, down = moves["breakout"], moves["breakdown"]

    at_support, at_resistance = f"({sup['level']} IS NOT NULL AND {sup['away']} <= {near})", f"({res['level']} IS NOT NULL AND {res['away']} <= {near})"
    bullish = s.put(s.flag(f"{at_support} AND {strong} > 40 AND market_phase IN ('Trending', 'Breakout')"))
    bearish = s.put(s.flag(f"NOT {at_support} AND {at_resistance} AND {strong} < 40 AND market_phase IN ('Trending', 'Breakdown')"))
    # a level below the price that is retested holds by itself, and so does one above
    kept = s.put(f"{bullish} OR {bearish}")
    trust = s.put(f"CASE WHEN {bullish} THEN {sup['trust']} WHEN {bearish} THEN {res['trust']} ELSE 0.0 END")
    out |= {
        "retest": s.mark(f"CASE WHEN {bullish} THEN 'Support Retest' WHEN {bearish} THEN 'Resistance Retest' ELSE 'None' END", "string"), "retest_confidence": trust,
        "retest_strength": s.put(f"CASE WHEN {kept} THEN {clip(f'{trust} + 10 * {backed}', 0.0, MOST)} ELSE 0.0 END"), "retest_quality": s.put(f"CASE WHEN {kept} THEN {clip(f'{BONUS['retest']!r} + 0.5 * {trust}', 0.0, MOST)} ELSE 0.0 END"),
    }

    lean = s.put(f"{strong} * sign({turn})")
    view = s.put(f"CASE WHEN {sup['big']} THEN 1 ELSE 0 END + CASE WHEN {up['big']} THEN 2 ELSE 0 END - CASE WHEN {down['big']} THEN 2 ELSE 0 END - CASE WHEN {res['big']} THEN 1 ELSE 0 END")
    out |= {
        "structural_bias": s.mark(f"CASE WHEN {lean} > 60 THEN 'Strong Bullish' WHEN {lean} > 20 THEN 'Bullish' WHEN {lean} < -60 THEN 'Strong Bearish' WHEN {lean} < -20 THEN 'Bearish' ELSE 'Neutral / Ranging' END", "string"),
        "support_status": s.mark(f"CASE WHEN {holding} THEN 'Holding' WHEN {down['on']} THEN 'Vulnerable' ELSE 'Building' END", "string"), "resistance_status": s.mark(f"CASE WHEN {up['on']} THEN 'Testing' WHEN {res['level']} IS NOT NULL THEN 'Intact' ELSE 'Clear Sky' END", "string"),
        "breakout_chance": up["quality"], "breakdown_chance": down["quality"], "institutional_view": s.mark(f"CASE WHEN {view} >= 2 THEN 'Smart Money Accumulation / Expansion' WHEN {view} <= -2 THEN 'Smart Money Distribution' ELSE 'Passive / Rotational' END", "string"),
        "risk_level": s.mark(f"CASE WHEN ({up['confirmed']} AND {up['risk']} < 30) OR ({holding} AND {sup['away']} < 2) THEN 'Low' WHEN {up['risk']} > 60 OR {down['on']} THEN 'High' ELSE 'Moderate' END", "string"),
        "action": s.mark(
            f"CASE WHEN {up['confirmed']} AND {up['goes_on']} THEN 'BUY (Breakout Confirmed)' WHEN {bullish} THEN 'BUY (Retest Validated)' WHEN {down['confirmed']} THEN 'SELL (Structural Failure)' "
            f"WHEN {res['big']} AND {res['away']} < 1 THEN 'TAKE PROFIT (Heavy Resistance)' ELSE 'WAIT (No Clear Edge)' END", "string",
        ),
        "reward_risk": s.put(s.div(f"{res['level']} - close", f"close - {sup['level']}")),
    }
    return out, {"levels": v}

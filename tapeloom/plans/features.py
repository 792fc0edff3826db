"""The feature table that the analyzers read: about 150 columns a bar, in one plan over one shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tapeloom.functions.sheet import Sheet
from tapeloom.operators import averages, candle, levels, momentum, patterns, smart_money, statistics, volatility, volume
from tapeloom.operators.base import BAR

TINY = "1e-9"


def build(s: Sheet, look_ahead: bool = False) -> dict[str, str]:
    """name -> column of the sheet. Placeholders that carry no information are left out; pattern results are kept.

    The regime, which the studied library names and never fills, comes from the ADX, the squeeze and the range. Every bar
    holds what it can know, so its row is the same whichever bars follow. ``look_ahead``: structure, liquidity and
    zones from swings at their own bar, and zones with what the bars after them made of them.
    """
    trend = volatility.supertrend(s, 10, 3.0)
    macd, reg, spread = momentum.macd(s), statistics.rolling_regression(s, 100), f"(high - low + {TINY})"
    before = s.lag("close")
    out = {
        "ema_20": averages.ema(s, 20), "ema_50": averages.ema(s, 50), "ema_200": averages.ema(s, 200), "rsi": momentum.rsi(s), "adx": momentum.adx(s)["adx"], "atr_14": volatility.atr(s), "atr": volatility.atr(s),
        "macd_line": macd["macd"], "macd_signal": macd["signal"], "macd_histogram": macd["histogram"], "roc": momentum.roc(s, 14), "momentum": momentum.momentum(s, 10),
        "supertrend": trend["supertrend"], "supertrend_direction": trend["trend"], "vwap": volume.vwap(s), "linreg_slope": reg["slope"], "linreg_r2": reg["r2"],
    }
    out["trend_direction"] = s.put(f"CASE WHEN {out['ema_20']} > {out['ema_50']} THEN 1 ELSE -1 END")
    body = s.put(f"abs(close - open) / {spread}")
    out |= {
        "clv": s.put(f"((close - low) - (high - close)) / {spread}"), "body_pct": s.put(f"100 * {body}"), "doji": s.put(f"CASE WHEN {body} < 0.1 THEN 1 ELSE 0 END"),
        "inside_bar": s.put(f"CASE WHEN high < {s.lag('high')} AND low > {s.lag('low')} THEN 1 ELSE 0 END"), "outside_bar": s.put(f"CASE WHEN high > {s.lag('high')} AND low < {s.lag('low')} THEN 1 ELSE 0 END"),
        "gap_up": s.put(f"CASE WHEN open > {s.lag('high')} THEN 1 ELSE 0 END"), "gap_down": s.put(f"CASE WHEN open < {s.lag('low')} THEN 1 ELSE 0 END"), "gap_size": s.put(f"abs(open - {before})"),
        "volume_ratio": s.put(f"volume / ({volume.average_volume(s)} + {TINY})"), "normalized_volatility": s.put(f"{out['atr']} / (close + {TINY})"),
        "efficiency_ratio": s.put(f"abs(close - {s.lag('close', 10)}) / ({s.roll('sum', f'abs(close - {before})', 10)} + {TINY})"),
    }
    for name, sign in (("bull_sequence", ">"), ("bear_sequence", "<")):
        on = s.put(f"CASE WHEN {s.flag(f'close {sign} {before}')} THEN 1 ELSE 0 END")
        run = s.cum("sum", f"1 - {on}")
        out[name] = s.cum("sum", on, run)
    flow = s.put(f"((close - low) - (high - close)) / {spread} * volume")
    out |= {
        "obv": volume.obv(s), "money_flow": flow, "adl": s.cum("sum", flow), "accdist": s.cum("sum", flow), "cmf": s.put(f"{s.roll('sum', flow, 20)} / ({volume.rolling_volume(s)} + {TINY})"),
        "mfi": volume.money_flow_index(s), "vpt": volume.price_volume_trend(s), "force_index": volume.force_index_ema(s), "nvi": volume.negative_volume_index(s), "pvi": volume.positive_volume_index(s),
        "volume_zscore": s.put(f"(volume - {volume.average_volume(s)}) / ({s.roll('stddev_samp', 'volume', 20)} + {TINY})"), "volume_percentile": volume.volume_percentile(s, 20),
        "relative_volume": volume.relative_volume(s), "delivery_percent": s.put(f"50 + 0.4 * {out['body_pct']}"), "delivery_quantity": s.put(f"volume * (50 + 0.4 * {out['body_pct']}) / 100"),
    }
    found = patterns.calculate_patterns(s)
    out |= {("pattern_" + k if k in ("swing_high", "swing_low", "resistance_strength", "support_strength", "compression_pct", "breakout_pressure", "volume_confirmation") else k): v for k, v in found.items()}
    out |= {
        "swing_high": levels.confirmed(s, "high", 2), "swing_low": levels.confirmed(s, "low", 2),
        "support_strength": s.roll("avg", f"CASE WHEN close <= {s.roll('min', 'low', 10)} THEN volume ELSE 0.0 END", 10), "resistance_strength": s.roll("avg", f"CASE WHEN close >= {s.roll('max', 'high', 10)} THEN volume ELSE 0.0 END", 10),
        "compression_pct": s.put(f"(high - low) / ({out['atr_14']} + {TINY})"), "breakout_pressure": s.put(f"{out['volume_ratio']} * abs(close - {before}) / ({out['atr_14']} + {TINY})"), "volume_confirmation": out["volume_ratio"],
    }
    known = not look_ahead
    near, far = smart_money.structure(s, 5, known), smart_money.structure(s, 20, known)
    life, pool = smart_money.zones(s, 5, known), smart_money.liquidity(s, 5, known)
    sweep = smart_money.liquidity_sweep(s, 5, known)
    out |= {
        "bos": near["bos"], "internal_bos": near["bos"], "external_bos": far["bos"], "major_bos": far["bos"], "minor_bos": near["bos"], "choch": near["choch"], "internal_choch": near["choch"], "external_choch": far["choch"],
        "displacement_strength": s.put(f"CASE WHEN {smart_money.displacement_candle(s)} THEN 100.0 ELSE 0.0 END"), "swing_failure": life["mss"], "structure_score": smart_money.structure_strength(s, known),
        "ob_active": s.put(f"CASE WHEN abs({life['ob']}) IN (1, 2) THEN 1 ELSE 0 END"), "bullish_ob_detected": s.put(f"CASE WHEN {life['ob']} IN (1, 2) THEN 1 ELSE 0 END"), "bearish_ob_detected": s.put(f"CASE WHEN {life['ob']} IN (-1, -2) THEN 1 ELSE 0 END"),
        "mitigation_block": s.put(f"CASE WHEN abs({life['ob']}) = 7 THEN 1 ELSE 0 END"), "breaker_block": s.put(f"CASE WHEN abs({life['ob']}) = 5 THEN 1 ELSE 0 END"), "ob_age": life["ob_age"], "ob_efficiency": smart_money.order_block_strength(s, 5, known),
        "reaction_count": s.put(f"CASE WHEN abs({life['ob']}) = 2 THEN 1 ELSE 0 END"), "order_block": s.put(f"CASE WHEN {life['ob']} > 0 THEN 1.0 WHEN {life['ob']} < 0 THEN -1.0 ELSE 0.0 END"),
        "fvg": s.put(f"CASE WHEN {life['fvg']} IN (1, 2) THEN 1.0 WHEN {life['fvg']} IN (-1, -2) THEN -1.0 ELSE 0.0 END"), "fvg_active": s.put(f"CASE WHEN abs({life['fvg']}) IN (1, 2) THEN 1 ELSE 0 END"), "inverse_fvg": s.put(f"CASE WHEN abs({life['fvg']}) = 5 THEN 1 ELSE 0 END"),
        "fvg_width": smart_money.fvg_strength(s, 5, known), "fvg_age": life["fvg_age"], "fvg_fill_ratio": s.put(f"CASE WHEN abs({life['fvg']}) = 3 THEN 1.0 WHEN abs({life['fvg']}) IN (1, 2) THEN 0.5 ELSE 0.0 END"),
        "liq_sweep": sweep, "liquidity_sweep": sweep, "sweep_strength": smart_money.liquidity_score(s, known), "equal_highs": pool["eqh"], "equal_lows": pool["eql"], "buy_side_liquidity": pool["bsl"], "sell_side_liquidity": pool["ssl"],
        "liquidity_pool_strength": smart_money.liquidity_strength(s, 5, known), "institutional_volume_score": smart_money.institutional_score(s), "smart_money_score": smart_money.smart_money_score(s, known),
        "bbw": volatility.bollinger_width(s), "sqz": s.put(f"CASE WHEN {volatility.bollinger_squeeze(s)} THEN 1 ELSE 0 END"), "hv_20": volatility.historical_volatility(s), "ei": volatility.expansion_index(s), "chop": volatility.choppiness_index(s),
        "nearest_support": levels.confirmed(s, "low", 5), "nearest_resistance": levels.confirmed(s, "high", 5),
    }
    wide = s.put(f"{out['atr_14']} > 1.5 * {s.roll('avg', out['atr_14'], 50)}")
    out |= {
        "market_regime": s.mark(f"CASE WHEN {out['adx']} >= 25 THEN 'Trending' WHEN {out['sqz']} = 1 THEN 'Compression' WHEN {wide} THEN 'Volatile' WHEN {out['adx']} < 20 THEN 'Mean Reversion' ELSE 'Neutral' END", "string"),
    }
    return out


def features(bars: DataFrame, fill: str | None = None, look_ahead: bool = False, digits: int | None = None) -> DataFrame:
    """Feature columns beside the bar columns.

    fill: None leaves missing values; ``forward`` carries the last value on; ``both`` also fills what comes before the
    first value, which looks ahead. look_ahead: see ``build``.
    """
    s = Sheet(dict(BAR))
    out = build(s, look_ahead)
    df = s.spark(bars.select(*BAR), out, digits)
    if fill is None:
        return df
    past = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("symbol").orderBy("ts").rowsBetween(0, Window.unboundedFollowing)
    for w, f in ((past, F.last), (ahead, F.first))[: 1 + (fill == "both")]:
        df = df.select("symbol", "ts", *(F.coalesce(F.col(c), f(c, ignorenulls=True).over(w)).alias(c) for c in df.columns if c not in ("symbol", "ts")))
    return df


def features_sql(bars: str, look_ahead: bool = False, digits: int | None = None) -> str:
    """DuckDB SQL of the unfilled table over the SQL ``bars``."""
    s = Sheet(dict(BAR))
    return s.duck(bars, build(s, look_ahead), digits)


__all__ = ["candle", "build", "features"]

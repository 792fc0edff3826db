"""Momentum and oscillators (names momentum.*)."""

from __future__ import annotations

from tapeloom.functions.sheet import Sheet

from .averages import counted, ema_of, ema_raw, wilder
from .base import alias, indicator, positive, price


def true_range(s: Sheet) -> str:
    before = s.lag("close")
    return s.put(f"CASE WHEN {before} IS NOT NULL THEN greatest(high - low, abs(high - {before}), abs(low - {before})) END")


def rate(s: Sheet, x: str, n: int) -> str:
    """Change over n bars in per cent of the old value."""
    x = s.put(x)
    return s.put(f"100 * {s.div(f'{x} - {s.lag(x, n)}', s.lag(x, n))}")


@indicator("momentum.rsi")
def rsi(s: Sheet, length: int = 14, source: str = "close") -> str:
    x, n = price(s, source), positive(length)
    step = s.put(f"{x} - {s.lag(x)}")
    gain = wilder(s, f"CASE WHEN {step} IS NOT NULL THEN greatest({step}, 0.0) END", n)
    loss = wilder(s, f"CASE WHEN {step} IS NOT NULL THEN greatest(-{step}, 0.0) END", n)
    return s.put(f"CASE WHEN {gain} IS NULL OR {loss} IS NULL THEN NULL WHEN {loss} = 0 THEN CASE WHEN {gain} = 0 THEN 50.0 ELSE 100.0 END ELSE 100 - 100 / (1 + {gain} / nullif({loss}, 0)) END")


@indicator("momentum.rsi_slope")
def rsi_slope(s: Sheet, rsi_length: int = 14, slope_length: int = 3, source: str = "close") -> str:
    r = rsi(s, rsi_length, source)
    return s.put(f"{r} - {s.lag(r, positive(slope_length))}")


def macd_of(s: Sheet, x: str, fast: int, slow: int, signal: int) -> dict[str, str]:
    line = s.put(f"{ema_of(s, x, positive(fast))} - {ema_of(s, x, positive(slow))}")
    sig = ema_of(s, line, positive(signal), seen=s.put(f"CASE WHEN {counted(s, x)} >= {max(fast, slow)} THEN 1 END"))
    return {"macd": line, "signal": sig, "histogram": s.put(f"{line} - {sig}")}


@indicator("momentum.macd")
def macd(s: Sheet, fast_length: int = 12, slow_length: int = 26, signal_length: int = 9, source: str = "close") -> dict[str, str]:
    return macd_of(s, price(s, source), fast_length, slow_length, signal_length)


alias("momentum.macd_signal", "momentum.macd", "signal")
alias("momentum.macd_histogram", "momentum.macd", "histogram")


@indicator("momentum.adx")
def adx(s: Sheet, length: int = 14) -> dict[str, str]:
    n = positive(length)
    up, down = s.put(f"high - {s.lag('high')}"), s.put(f"{s.lag('low')} - low")
    plus = wilder(s, f"CASE WHEN {up} IS NULL THEN NULL WHEN {up} > {down} AND {up} > 0 THEN {up} ELSE 0.0 END", n)
    minus = wilder(s, f"CASE WHEN {up} IS NULL THEN NULL WHEN {down} > {up} AND {down} > 0 THEN {down} ELSE 0.0 END", n)
    tr = wilder(s, true_range(s), n)
    pdi = s.put(f"100 * {s.div(plus, tr, '0.0')}")
    mdi = s.put(f"100 * {s.div(minus, tr, '0.0')}")
    # the index itself begins with the directional movement, not with the empty rows before it
    dx = s.put(f"CASE WHEN {tr} IS NOT NULL THEN 100 * {s.div(f'abs({pdi} - {mdi})', f'{pdi} + {mdi}', '0.0')} END")
    return {"adx": wilder(s, dx, n), "plus_di": pdi, "minus_di": mdi, "dx": dx}


alias("momentum.plus_di", "momentum.adx", "plus_di")
alias("momentum.minus_di", "momentum.adx", "minus_di")


@indicator("momentum.roc")
def roc(s: Sheet, length: int = 12, source: str = "close") -> str:
    return rate(s, price(s, source), positive(length))


@indicator("momentum.cci")
def cci(s: Sheet, length: int = 20) -> str:
    tp, n = price(s, "hlc3"), positive(length)
    mean = s.roll("avg", tp, n)
    mad = s.mean_of(s.values(tp, n), f"abs(v - {mean})", n)
    return s.put(s.div(f"{tp} - {mean}", f"0.015 * {mad}"))


@indicator("momentum.momentum")
def momentum(s: Sheet, length: int = 10, source: str = "close") -> str:
    x = price(s, source)
    return s.put(f"{x} - {s.lag(x, positive(length))}")


@indicator("momentum.trix")
def trix(s: Sheet, length: int = 15, source: str = "close") -> str:
    x = price(s, source)
    for _ in range(3):
        x = ema_raw(s, x, positive(length))
    return rate(s, x, 1)


@indicator("momentum.ppo")
def ppo(s: Sheet, fast_length: int = 12, slow_length: int = 26, signal_length: int = 9, source: str = "close") -> dict[str, str]:
    return ppo_of(s, price(s, source), fast_length, slow_length, signal_length)


def ppo_of(s: Sheet, x: str, fast: int, slow: int, signal: int) -> dict[str, str]:
    a, b = ema_of(s, x, positive(fast)), ema_of(s, x, positive(slow))
    line = s.put(f"100 * {s.div(f'{a} - {b}', b)}")
    sig = ema_of(s, line, positive(signal))
    return {"line": line, "signal": sig, "histogram": s.put(f"{line} - {sig}")}


@indicator("momentum.dpo")
def dpo(s: Sheet, length: int = 20, source: str = "close") -> str:
    x = price(s, source)
    return s.put(f"{x} - {s.lag(s.roll('avg', x, positive(length)), int(length / 2 + 1))}")


def stochastic_of(s: Sheet, x: str, high: str, low: str, n: int, smooth: int, d: int) -> dict[str, str]:
    low_, high_ = s.roll("min", low, n), s.roll("max", high, n)
    fast = s.put(f"100 * {s.div(f'{x} - {low_}', f'{high_} - {low_}')}")
    k = s.roll("avg", fast, positive(smooth, "smooth"))
    return {"k": k, "d": s.roll("avg", k, positive(d, "d"))}


@indicator("momentum.stochastic")
def stochastic(s: Sheet, length_k: int = 14, length_d: int = 3, smooth_k: int = 3) -> dict[str, str]:
    return stochastic_of(s, "close", "high", "low", positive(length_k), smooth_k, length_d)


@indicator("momentum.stochastic_rsi")
def stochastic_rsi(s: Sheet, length_rsi: int = 14, length_stoch: int = 14, smooth_k: int = 3, smooth_d: int = 3, source: str = "close") -> dict[str, str]:
    r = rsi(s, length_rsi, source)
    return stochastic_of(s, r, r, r, positive(length_stoch), smooth_k, smooth_d)


@indicator("momentum.williams_r")
def williams_r(s: Sheet, length: int = 14) -> str:
    low_, high_ = s.roll("min", "low", positive(length)), s.roll("max", "high", length)
    return s.put(f"-100 * {s.div(f'{high_} - close', f'{high_} - {low_}')}")


@indicator("momentum.ultimate_oscillator")
def ultimate_oscillator(s: Sheet, length1: int = 7, length2: int = 14, length3: int = 28, weight1: float = 4.0, weight2: float = 2.0, weight3: float = 1.0) -> str:
    before, tr = s.lag("close"), true_range(s)
    pressure = s.put(f"CASE WHEN {before} IS NOT NULL THEN close - least(low, {before}) END")
    parts = [s.div(s.roll("sum", pressure, positive(n)), s.roll("sum", tr, n), "0.0") for n in (length1, length2, length3)]
    top = " + ".join(f"{w!r} * {p}" for w, p in zip((weight1, weight2, weight3), parts))
    return s.put(f"100 * ({top}) / {weight1 + weight2 + weight3!r}")

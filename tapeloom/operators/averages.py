"""Moving averages (names ma.*)."""

from __future__ import annotations

from math import exp, floor, sqrt

from tapeloom.functions.sheet import Sheet, numbers

from .base import alias, indicator, positive, price


def counted(s: Sheet, x: str) -> str:
    return s.put(f"count({s.put(x)}) {s.past}")


def enough(s: Sheet, x: str, y: str, n: int) -> str:
    """y once n values of x have been seen. The count is a column of its own: where x is no fold, neither is any window
    that follows one, and folds that build on each other stay in one pass."""
    return s.gate(y, f"{counted(s, x)} >= {n}")


def ema_raw(s: Sheet, x: str, n: int) -> str:
    """Exponential mean with span n, from the first value on."""
    x = s.put(x)
    return s.fold(x, f"cast({2 / (n + 1)!r} AS double)", x)


def ema_of(s: Sheet, x: str, n: int, least: int | None = None, seen: str | None = None) -> str:
    """``seen``: a column that is known where x is and doesn't stand on a fold."""
    return enough(s, seen or x, ema_raw(s, x, n), n if least is None else least)


def wilder(s: Sheet, x: str, n: int) -> str:
    """Wilder's mean: the mean of the first n values, then 1/n of each new one; missing values carry it on."""
    x = s.put(x)
    return s.fold(s.roll("avg", x, n), f"cast({1 / n!r} AS double)", x)


def weighted(s: Sheet, x: str, weights: list[float]) -> str:
    """Sum of weights (oldest first) over the last values; missing if one of them is."""
    n = len(weights)
    return s.put(" + ".join(f"{w!r} * {s.lag(x, n - 1 - i)}" if n - 1 - i else f"{w!r} * {s.put(x)}" for i, w in enumerate(weights)))


def linear(n: int) -> list[float]:
    return [(i + 1) / (n * (n + 1) / 2) for i in range(n)]


@indicator("ma.sma")
def sma(s: Sheet, length: int = 14, source: str = "close", min_periods: int | None = None) -> str:
    return s.roll("avg", price(s, source), positive(length), min_periods)


@indicator("ma.ema")
def ema(s: Sheet, length: int = 14, source: str = "close", min_periods: int | None = None) -> str:
    return ema_of(s, price(s, source), positive(length), min_periods)


@indicator("ma.smma")
def smma(s: Sheet, length: int = 14, source: str = "close", min_periods: int | None = None) -> str:
    x = price(s, source)
    return enough(s, x, s.fold(x, f"cast({1 / positive(length)!r} AS double)", x), min_periods or length)


@indicator("ma.wma")
def wma(s: Sheet, length: int = 14, source: str = "close", min_periods: int | None = None) -> str:
    x = price(s, source)
    y = weighted(s, x, linear(positive(length)))
    return y if min_periods is None else s.put(f"CASE WHEN count({x}) {s.rows(length)} >= {min_periods} THEN {y} END")


@indicator("ma.vwma")
def vwma(s: Sheet, length: int = 14, source: str = "close", min_periods: int | None = None) -> str:
    pv = s.put(f"{price(s, source)} * volume")
    return s.put(s.div(s.roll("sum", pv, positive(length), min_periods), s.roll("sum", "volume", length, min_periods)))


@indicator("ma.lsma")
def lsma(s: Sheet, length: int = 14, source: str = "close") -> str:
    n = positive(length)
    return weighted(s, price(s, source), [(6 * i - 2 * (n + 1)) / (n * (n + 1)) for i in range(1, n + 1)])


def cascade(s: Sheet, source: str, n: int, depth: int, least: int | None) -> list[str]:
    out, x = [], price(s, source)
    seen = x
    for _ in range(depth):
        x = ema_of(s, x, n, least, seen)
        seen = s.put(f"CASE WHEN {counted(s, seen)} >= {n if least is None else least} THEN 1 END")
        out.append(x)
    return out


@indicator("ma.dema")
def dema(s: Sheet, length: int = 14, source: str = "close", min_periods: int | None = None) -> str:
    a, b = cascade(s, source, positive(length), 2, min_periods)
    return s.put(f"2 * {a} - {b}")


@indicator("ma.tema")
def tema(s: Sheet, length: int = 14, source: str = "close", min_periods: int | None = None) -> str:
    a, b, c = cascade(s, source, positive(length), 3, min_periods)
    return s.put(f"3 * {a} - 3 * {b} + {c}")


@indicator("ma.trima")
def trima(s: Sheet, length: int = 14, source: str = "close", min_periods: int | None = None) -> str:
    h = (positive(length) + 1) // 2
    return s.roll("avg", s.roll("avg", price(s, source), h if length % 2 else h + 1), h)


@indicator("ma.hma")
def hma(s: Sheet, length: int = 14, source: str = "close", min_periods: int | None = None) -> str:
    x, n = price(s, source), positive(length)
    raw = s.put(f"2 * {weighted(s, x, linear(max(1, n // 2)))} - {weighted(s, x, linear(n))}")
    y = weighted(s, s.bfill(raw), linear(max(1, round(sqrt(n)))))
    return s.put(f"CASE WHEN {raw} IS NOT NULL THEN {y} END")


@indicator("ma.zlema")
def zlema(s: Sheet, length: int = 14, source: str = "close", min_periods: int | None = None) -> str:
    x = price(s, source)
    return ema_of(s, s.put(f"2 * {x} - {s.lag(x, (positive(length) - 1) // 2)}") if length > 2 else x, length, min_periods)


@indicator("ma.kama")
def kama(s: Sheet, length: int = 10, fast_len: int = 2, slow_len: int = 30, source: str = "close") -> str:
    x, n = price(s, source), positive(length)
    fast, slow = 2 / (fast_len + 1), 2 / (slow_len + 1)
    path = s.roll("sum", s.put(f"abs({x} - {s.lag(x)})"), n)
    ratio = s.put(s.div(f"abs({x} - {s.lag(x, n)})", path, "0.0"))
    seed = s.put(f"CASE WHEN count({x}) {s.past} >= {n} THEN {x} END")
    return s.fold(seed, s.put(f"power({ratio} * {fast - slow!r} + {slow!r}, 2)"), x)


@indicator("ma.alma")
def alma(s: Sheet, length: int = 9, offset_alma: float = 0.85, sigma: float = 6.0, source: str = "close") -> str:
    m, width = floor(offset_alma * (positive(length) - 1)), length / sigma
    w = [exp(-((i - m) ** 2) / (2 * width * width)) for i in range(length)]
    return weighted(s, price(s, source), [v / sum(w) for v in w])


@indicator("ma.t3")
def t3(s: Sheet, length: int = 5, vfactor: float = 0.7, source: str = "close", min_periods: int | None = None) -> str:
    e, a = cascade(s, source, positive(length), 6, min_periods), vfactor
    c = (-(a**3), 3 * a**2 + 3 * a**3, -6 * a**2 - 3 * a - 3 * a**3, 1 + 3 * a + a**3 + 3 * a**2)
    return s.put(f"{c[0]!r} * {e[5]} + {c[1]!r} * {e[4]} + {c[2]!r} * {e[3]} + {c[3]!r} * {e[2]}")


@indicator("ma.mcginley_dynamic", machine=True)
def mcginley_dynamic(s: Sheet, length: int = 14, k: float = 0.6, source: str = "close") -> str:
    n = positive(length)

    def make():
        last = [None]

        def step(values):
            out = []
            for x in values:
                md = last[0]
                if x is not None:
                    if md is None or md <= 1e-10:
                        md = x
                    else:
                        md += (x - md) / max(k * n * (x / md) ** 4, 1e-10)
                last[0] = md
                out.append(md)
            return [out]

        return step

    def sql(sheet: Sheet, table: str, inputs: list[str], outputs: list[str]) -> str:
        x = inputs[0]
        form = f"CASE WHEN {x} IS NULL THEN r_md WHEN r_md IS NULL OR r_md <= 1e-10 THEN {x} ELSE r_md + ({x} - r_md) / greatest({k!r} * {n} * power({x} / r_md, 4), 1e-10) END"
        return sheet.recursion(table, {"md": "NULL::DOUBLE"}, [{"n_md": form}], {outputs[0]: "n_md"})

    return s.machine(make, [price(s, source)], ["y"], ("mcginley", n, k, source), sql=sql)["y"]


@indicator("ma.vidya")
def vidya(s: Sheet, length: int = 9, source: str = "close") -> str:
    """Missing prices count as unchanged, and their bars have no value; the first price is a step from zero."""
    x, n = price(s, source), positive(length)
    held = s.ffill(x)
    step = s.put(f"{held} - coalesce({s.lag(held)}, 0)")
    up, down = (s.roll("sum", s.put(f"CASE WHEN {step} IS NOT NULL THEN greatest({sign}{step}, 0.0) END"), n) for sign in ("", "-"))
    strength = s.put(s.div(f"abs({up} - {down})", f"{up} + {down}", "0.0"))
    y = s.fold(s.put(f"CASE WHEN {counted(s, held)} >= {n} THEN {held} END"), s.put(f"{2 / (n + 1)!r} * {strength}"), held)
    return s.gate(y, f"{x} IS NOT NULL")


__all__ = ["alias", "numbers"]

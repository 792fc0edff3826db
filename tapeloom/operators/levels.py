"""Support, resistance, pivots, zones, gaps and confluence (names sr.*).

Swing values stand at their own bar, which is known only ``length`` bars later; the confirmed_* forms are free of that.
"""

from __future__ import annotations

from tapeloom.functions.sheet import Sheet, plain

from .averages import ema_raw
from .base import alias, indicator, positive, price
from .momentum import true_range
from .volume import OUTPUTS, clock, profile_sql, rank_share, rolling_profile, window_sql

EPS = "1e-10"


def boolean(s: Sheet, test: str) -> str:
    return s.mark(s.flag(test), "boolean")


def average_range(s: Sheet, n: int = 14) -> str:
    return s.ffill(s.roll("avg", true_range(s), n))


# pivots -----------------------------------------------------------------------------------------------------------

_H, _L, _C, _O = "{h}", "{l}", "{c}", "{o}"
_REACH = "({h} - {l})"
_CLASSIC = "(({h} + {l} + {c}) / 3)"
_WOODIE = "(({h} + {l} + 2 * {c}) / 4)"
_DEMARK = "CASE WHEN {c} < {o} THEN {h} + 2 * {l} + {c} WHEN {c} > {o} THEN 2 * {h} + {l} + {c} ELSE {h} + {l} + 2 * {c} END"


def _standard(pp: str) -> dict[str, str]:
    return {
        "PP": pp, "R1": f"2 * {pp} - {_L}", "S1": f"2 * {pp} - {_H}", "R2": f"{pp} + {_REACH}", "S2": f"{pp} - {_REACH}",
        "R3": f"{_H} + 2 * ({pp} - {_L})", "S3": f"{_L} - 2 * ({_H} - {pp})",
    }


def _camarilla() -> dict[str, str]:
    out = {"PP": _CLASSIC}
    for k, d in (("1", 12), ("2", 6), ("3", 4), ("4", 2)):
        out[f"H{k}"], out[f"L{k}"] = f"{_C} + {_REACH} * 1.1 / {d}", f"{_C} - {_REACH} * 1.1 / {d}"
    five = f"{_REACH} * (1.1 / 2 + 1.168 * (1.1 / 2 - 1.1 / 4))"
    six = f"({_H} / nullif({_L}, 0) * {_C} - {_C})"
    return out | {"H5": f"{_C} + {five}", "L5": f"{_C} - {five}", "H6": f"{_C} + {six}", "L6": f"{_C} - {six}"}


PIVOTS = {
    "classic_pivot_levels": _standard(_CLASSIC), "woodie_levels": _standard(_WOODIE), "camarilla_levels": _camarilla(),
    "demark_levels": {"PP": f"({_DEMARK}) / 4", "R1": f"({_DEMARK}) / 2 - {_L}", "S1": f"({_DEMARK}) / 2 - {_H}"},
}


def _pivot(forms: dict[str, str]):
    def build(s: Sheet) -> dict[str, str]:
        before = {"o": s.lag("open"), "h": s.lag("high"), "l": s.lag("low"), "c": s.lag("close")}
        return {k: s.put(f.format(**before)) for k, f in forms.items()}

    return build


for _name, _forms in PIVOTS.items():
    indicator(f"sr.{_name}")(_pivot(_forms))
for _k in ("1", "2", "3"):
    alias(f"sr.pivot_support_{_k}", "sr.classic_pivot_levels", f"S{_k}")
    alias(f"sr.pivot_resistance_{_k}", "sr.classic_pivot_levels", f"R{_k}")
    for _side in "sr":
        alias(f"sr.floor_{_side}{_k}", "sr.classic_pivot_levels", f"{_side.upper()}{_k}")
        alias(f"sr.woodie_{_side}{_k}", "sr.woodie_levels", f"{_side.upper()}{_k}")
for _name, _of in (("pivot_point", "classic_pivot_levels"), ("floor_pivot", "classic_pivot_levels"), ("woodie_pivot", "woodie_levels"), ("camarilla_pivot", "camarilla_levels"), ("demark_pivot", "demark_levels")):
    alias(f"sr.{_name}", f"sr.{_of}", "PP")
for _k in "123456":
    alias(f"sr.camarilla_h{_k}", "sr.camarilla_levels", f"H{_k}")
    alias(f"sr.camarilla_l{_k}", "sr.camarilla_levels", f"L{_k}")
alias("sr.demark_resistance", "sr.demark_levels", "R1")
alias("sr.demark_support", "sr.demark_levels", "S1")

# swings -----------------------------------------------------------------------------------------------------------


def swing(s: Sheet, side: str, n: int) -> str:
    """The price at a pivot: not passed by the n bars before, nor reached by the n bars after."""
    x, f, worse, far = ("high", "max", ">=", ">") if side == "high" else ("low", "min", "<=", "<")
    before, after = s.put(f"{f}({x}) {s.rows(positive(n), 1)}"), s.put(f"{f}({x}) {s.rows(n, -n)}")
    inside = f"{s.lag(x, n)} IS NOT NULL AND {s.lag(x, -n)} IS NOT NULL"
    return s.put(f"CASE WHEN {inside} AND {x} {worse} {before} AND {x} {far} {after} THEN {x} END")


def last_swing(s: Sheet, side: str, n: int) -> str:
    return s.ffill(swing(s, side, n))


def confirmed(s: Sheet, side: str, n: int) -> str:
    return s.lag(last_swing(s, side, n), n)


def _sided(make, side: str):
    def build(s: Sheet, length: int = 5) -> str:
        return make(s, side, positive(length))

    return build


for _side in ("high", "low"):
    for _name, _make in ((f"swing_{_side}", swing), (f"last_swing_{_side}", last_swing), (f"confirmed_swing_{_side}", confirmed)):
        indicator(f"sr.{_name}")(_sided(_make, _side))
    alias(f"sr.market_structure_{_side}", f"sr.swing_{_side}")


def _widest(side: str, f: str):
    def build(s: Sheet, length: int = 20, swing_len: int = 5) -> str:
        return s.ffill(s.roll(f, swing(s, side, swing_len), positive(length), 1))

    return build


indicator("sr.highest_swing")(_widest("high", "max"))
indicator("sr.lowest_swing")(_widest("low", "min"))


@indicator("sr.adaptive_swing")
def adaptive_swing(s: Sheet) -> dict[str, str]:
    a = average_range(s)
    ratio = s.put(s.div(a, s.roll("avg", a, 50), "1.0"))
    return {f"swing_{n}": last_swing(s, "high", n) for n in (2, 5, 10, 20)} | {"adaptive_len": s.put(f"CASE WHEN {ratio} > 1.5 THEN 20 WHEN {ratio} > 1.0 THEN 10 ELSE 5 END")}


def top(s: Sheet, n: int) -> str:
    return s.roll("max", "high", positive(n))


def bottom(s: Sheet, n: int) -> str:
    return s.roll("min", "low", positive(n))


@indicator("sr.highest_high_breakout")
def highest_high_breakout(s: Sheet, length: int = 20) -> str:
    return boolean(s, f"close > {s.lag(top(s, length))}")


@indicator("sr.lowest_low_breakdown")
def lowest_low_breakdown(s: Sheet, length: int = 20) -> str:
    return boolean(s, f"close < {s.lag(bottom(s, length))}")


@indicator("sr.previous_high_breakout")
def previous_high_breakout(s: Sheet) -> str:
    return boolean(s, f"close > {s.lag('high')}")


@indicator("sr.previous_low_breakdown")
def previous_low_breakdown(s: Sheet) -> str:
    return boolean(s, f"close < {s.lag('low')}")


@indicator("sr.donchian_breakout")
def donchian_breakout(s: Sheet, length: int = 20) -> str:
    return s.put(f"CASE WHEN {highest_high_breakout(s, length)} THEN 1 WHEN {lowest_low_breakdown(s, length)} THEN -1 ELSE 0 END")


@indicator("sr.range_breakout")
def range_breakout(s: Sheet, length: int = 20) -> str:
    up, low = s.lag(top(s, length)), s.lag(bottom(s, length))
    return boolean(s, f"{up} - {low} < 1.5 * {s.lag(s.roll('avg', 'high - low', length))} AND (close > {up} OR close < {low})")


@indicator("sr.bill_williams_fractal_high")
def fractal_high(s: Sheet) -> str:
    return s.put(f"CASE WHEN {' AND '.join(f'high > {s.lag('high', k)}' for k in (1, 2, -1, -2))} THEN high END")


@indicator("sr.bill_williams_fractal_low")
def fractal_low(s: Sheet) -> str:
    return s.put(f"CASE WHEN {' AND '.join(f'low < {s.lag('low', k)}' for k in (1, 2, -1, -2))} THEN low END")


@indicator("sr.fractal_support")
def fractal_support(s: Sheet) -> str:
    return s.ffill(fractal_low(s))


@indicator("sr.fractal_resistance")
def fractal_resistance(s: Sheet) -> str:
    return s.ffill(fractal_high(s))


@indicator("sr.fractal_pivot")
def fractal_pivot(s: Sheet) -> str:
    return s.put(f"({fractal_support(s)} + {fractal_resistance(s)}) / 2")


@indicator("sr.rolling_lowest_low")
def rolling_lowest_low(s: Sheet, length: int = 20) -> str:
    return bottom(s, length)


@indicator("sr.rolling_highest_high")
def rolling_highest_high(s: Sheet, length: int = 20) -> str:
    return top(s, length)


alias("sr.rolling_support", "sr.rolling_lowest_low")
alias("sr.rolling_resistance", "sr.rolling_highest_high")


@indicator("sr.dynamic_support")
def dynamic_support(s: Sheet, length: int = 20) -> str:
    return ema_raw(s, bottom(s, length), length)


@indicator("sr.dynamic_resistance")
def dynamic_resistance(s: Sheet, length: int = 20) -> str:
    return ema_raw(s, top(s, length), length)


def _by_volume(x: str):
    def build(s: Sheet, length: int = 20) -> str:
        return s.put(s.div(s.roll("sum", f"{x} * volume", positive(length)), s.roll("sum", "volume", length)))

    return build


indicator("sr.adaptive_support")(_by_volume("low"))
indicator("sr.adaptive_resistance")(_by_volume("high"))


@indicator("sr.donchian_channel")
def donchian_channel(s: Sheet, length: int = 20) -> dict[str, str]:
    return {"upper": top(s, length), "middle": s.put(f"({top(s, length)} + {bottom(s, length)}) / 2"), "lower": bottom(s, length)}


alias("sr.price_channel", "sr.donchian_channel")
for _name, _c in (("highest_channel", "upper"), ("lowest_channel", "lower"), ("channel_midline", "middle")):
    alias(f"sr.{_name}", "sr.donchian_channel", _c)
for _name, _n in (("daily_levels", 1), ("weekly_levels", 5), ("monthly_levels", 21), ("yearly_levels", 252)):
    alias(f"sr.{_name}", "sr.donchian_channel", length=_n)


@indicator("sr.support_zone")
def support_zone(s: Sheet, length: int = 5) -> dict[str, str]:
    x = last_swing(s, "low", length)
    return {"lower": x, "upper": s.put(f"{x} + 0.2 * {average_range(s)}")}


@indicator("sr.resistance_zone")
def resistance_zone(s: Sheet, length: int = 5) -> dict[str, str]:
    x = last_swing(s, "high", length)
    return {"lower": s.put(f"{x} - 0.2 * {average_range(s)}"), "upper": x}


@indicator("sr.demand_zone")
def demand_zone(s: Sheet, length: int = 20) -> str:
    return s.ffill(f"CASE WHEN close > open AND high - low > 1.5 * {average_range(s)} THEN {s.lag('low')} END")


@indicator("sr.supply_zone")
def supply_zone(s: Sheet, length: int = 20) -> str:
    return s.ffill(f"CASE WHEN close < open AND high - low > 1.5 * {average_range(s)} THEN {s.lag('high')} END")


@indicator("sr.reaction_zone")
def reaction_zone(s: Sheet) -> dict[str, str]:
    return {"demand": demand_zone(s), "supply": supply_zone(s)}


@indicator("sr.congestion_zone")
def congestion_zone(s: Sheet, length: int = 20) -> str:
    return boolean(s, f"{top(s, length)} - {bottom(s, length)} < {s.lag(s.roll('avg', 'high - low', 2 * length))}")


# gaps and order blocks --------------------------------------------------------------------------------------------


@indicator("sr.bullish_fvg")
def bullish_fvg(s: Sheet) -> dict[str, str]:
    edge = s.lag("high", 2)
    is_gap = boolean(s, f"low > {edge} AND low - {edge} > 0.1 * {average_range(s)}")
    return {"is_fvg": is_gap, "top": s.put(f"CASE WHEN {is_gap} THEN low END"), "bottom": s.put(f"CASE WHEN {is_gap} THEN {edge} END")}


@indicator("sr.bearish_fvg")
def bearish_fvg(s: Sheet) -> dict[str, str]:
    edge = s.lag("low", 2)
    is_gap = boolean(s, f"high < {edge} AND {edge} - high > 0.1 * {average_range(s)}")
    return {"is_fvg": is_gap, "top": s.put(f"CASE WHEN {is_gap} THEN {edge} END"), "bottom": s.put(f"CASE WHEN {is_gap} THEN high END")}


@indicator("sr.mitigated_fvg", machine=True)
def mitigated_fvg(s: Sheet) -> dict[str, str]:
    """What later bars leave of each gap. Rows without a gap are active and not mitigated."""
    up, down = bullish_fvg(s), bearish_fvg(s)

    def make():
        def step(high, low, up_top, up_bottom, down_top, down_bottom):
            n, (high, low) = len(high), plain(high, low)
            done, tops, bottoms = [0.0] * n, [None] * n, [None] * n
            rising: list[int] = []
            falling: list[int] = []
            for i in range(n):
                still = []
                for k in rising:
                    if low[i] <= bottoms[k]:
                        done[k] = 1.0
                    else:
                        tops[k] = min(tops[k], low[i])
                        still.append(k)
                rising, still = still, []
                for k in falling:
                    if high[i] >= tops[k]:
                        done[k] = 1.0
                    else:
                        bottoms[k] = max(bottoms[k], high[i])
                        still.append(k)
                falling = still
                if up_top[i] is not None:
                    tops[i], bottoms[i] = up_top[i], up_bottom[i]
                    rising.append(i)
                elif down_top[i] is not None:
                    tops[i], bottoms[i] = down_top[i], down_bottom[i]
                    falling.append(i)
            return done, tops, bottoms

        return step

    def sql(sheet: Sheet, table: str, inputs: list[str], outputs: list[str]) -> str:
        """Every gap with the first later bar that closes it, and the extremes of the bars before that one."""
        h, lo, ut, ub, dt, db = inputs
        rising = f"{ut} IS NOT NULL"
        end = f"SELECT a.{sheet.key} AS k_, a.rn_ AS b_, min(f.rn_) AS e_ FROM {table} a JOIN {table} f ON f.{sheet.key} = a.{sheet.key} AND f.rn_ > a.rn_ AND CASE WHEN a.{rising} THEN f.{lo} <= a.{ub} ELSE f.{h} >= a.{dt} END WHERE a.{ut} IS NOT NULL OR a.{dt} IS NOT NULL GROUP BY 1, 2"
        reach = f"SELECT a.{sheet.key} AS k_, a.rn_ AS b_, any_value(e.e_) AS e_, min(f.{lo}) AS lo_, max(f.{h}) AS hi_ FROM {table} a LEFT JOIN ({end}) e ON e.k_ = a.{sheet.key} AND e.b_ = a.rn_ LEFT JOIN {table} f ON f.{sheet.key} = a.{sheet.key} AND f.rn_ > a.rn_ AND f.rn_ < coalesce(e.e_, 9000000000) WHERE a.{ut} IS NOT NULL OR a.{dt} IS NOT NULL GROUP BY 1, 2"
        forms = ("CASE WHEN z.e_ IS NOT NULL THEN 1 ELSE 0 END", f"CASE WHEN t.{rising} THEN least(t.{ut}, z.lo_) ELSE t.{dt} END", f"CASE WHEN t.{rising} THEN t.{ub} ELSE greatest(t.{db}, z.hi_) END")
        return f"SELECT t.*, {', '.join(f'({f})::DOUBLE AS {o}' for f, o in zip(forms, outputs))} FROM {table} t LEFT JOIN ({reach}) z ON z.k_ = t.{sheet.key} AND z.b_ = t.rn_"

    got = s.machine(make, ["high", "low", up["top"], up["bottom"], down["top"], down["bottom"]], ["done", "unfilled_top", "unfilled_bottom"], ("mitigated",), whole=True, sql=sql)
    hit = boolean(s, f"{got['done']} > 0")
    return {"is_mitigated": hit, "unfilled_top": got["unfilled_top"], "unfilled_bottom": got["unfilled_bottom"], "is_active": boolean(s, f"NOT {hit}")}


@indicator("sr.balanced_price_range")
def balanced_price_range(s: Sheet) -> str:
    a, b = bullish_fvg(s)["is_fvg"], bearish_fvg(s)["is_fvg"]
    return boolean(s, f"(coalesce({s.lag(a)}, false) AND {b}) OR (coalesce({s.lag(b)}, false) AND {a})")


@indicator("sr.smc_structure")
def smc_structure(s: Sheet, length: int = 5) -> dict[str, str]:
    high, low = confirmed(s, "high", length), confirmed(s, "low", length)
    trend = s.ffill(f"CASE WHEN close > {high} THEN 1 WHEN close < {low} THEN -1 END")
    old = s.lag(trend)
    return {
        "bos_up": boolean(s, f"{trend} = 1 AND close > {high}"), "bos_dn": boolean(s, f"{trend} = -1 AND close < {low}"),
        "choch_up": boolean(s, f"{old} = -1 AND close > {high}"), "choch_dn": boolean(s, f"{old} = 1 AND close < {low}"), "trend": trend,
    }


@indicator("sr.bos_level")
def bos_level(s: Sheet) -> str:
    m = smc_structure(s)
    return s.put(f"CASE WHEN {m['bos_up']} THEN 1 WHEN {m['bos_dn']} THEN -1 ELSE 0 END")


@indicator("sr.choch_level")
def choch_level(s: Sheet) -> str:
    m = smc_structure(s)
    return s.put(f"CASE WHEN {m['choch_up']} THEN 1 WHEN {m['choch_dn']} THEN -1 ELSE 0 END")


@indicator("sr.market_structure_shift")
def market_structure_shift(s: Sheet, length: int = 5) -> dict[str, str]:
    m = smc_structure(s, length)
    gap = f"({bullish_fvg(s)['is_fvg']} OR {bearish_fvg(s)['is_fvg']})"
    return {"mss_bullish": boolean(s, f"{m['bos_up']} AND {gap}"), "mss_bearish": boolean(s, f"{m['bos_dn']} AND {gap}")}


@indicator("sr.order_blocks")
def order_blocks(s: Sheet, length: int = 20) -> dict[str, str]:
    """The bar before a gap that breaks structure; its state follows from the extremes of all later bars."""
    m = market_structure_shift(s, length)
    up = boolean(s, f"{m['mss_bullish']} AND {bullish_fvg(s)['is_fvg']}")
    down = boolean(s, f"{m['mss_bearish']} AND {bearish_fvg(s)['is_fvg']}")
    high = s.put(f"CASE WHEN {up} OR {down} THEN {s.lag('high')} END")
    low = s.put(f"CASE WHEN {up} OR {down} THEN {s.lag('low')} END")
    later = s.over("ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING")
    deepest, highest = s.put(f"min(low) {later}"), s.put(f"max(high) {later}")
    gone = f"CASE WHEN {up} THEN {deepest} < {low} ELSE {highest} > {high} END"
    touched = f"CASE WHEN {up} THEN {deepest} <= {high} ELSE {highest} >= {low} END"
    known = f"{high} IS NOT NULL"
    return {
        "fresh_ob": boolean(s, f"{known} AND NOT coalesce({gone}, false) AND NOT coalesce({touched}, false)"), "mitigated_ob": boolean(s, f"{known} AND NOT coalesce({gone}, false) AND {touched}"),
        "invalidated_ob": boolean(s, f"{known} AND {gone}"), "ob_high": high, "ob_low": low, "is_bullish": up,
    }


alias("sr.breaker_block", "sr.order_blocks", "invalidated_ob")
alias("sr.flip_zone", "sr.order_blocks", "invalidated_ob")


@indicator("sr.premium_discount_zone")
def premium_discount_zone(s: Sheet, length: int = 20) -> dict[str, str]:
    c = donchian_channel(s, length)
    return {"premium_level": c["upper"], "equilibrium": c["middle"], "discount_level": c["lower"]}


# liquidity --------------------------------------------------------------------------------------------------------

alias("sr.inducement_level", "sr.last_swing_low", length=2)
alias("sr.internal_liquidity", "sr.last_swing_low")
alias("sr.external_liquidity", "sr.rolling_lowest_low")
alias("sr.liquidity_high", "sr.highest_swing", length=50)
alias("sr.liquidity_low", "sr.lowest_swing", length=50)
alias("sr.institutional_resistance", "sr.liquidity_high")
alias("sr.institutional_support", "sr.liquidity_low")


def equals(s: Sheet, x: str, mult: float) -> dict[str, str]:
    """How many of the 49 levels before lie within ``mult`` average ranges of this one, it included."""
    x = s.put(x)
    w = s.put(f"collect_list({x}) {s.rows(49, 1)}", f"coalesce(list({x}) FILTER (WHERE {x} IS NOT NULL) {s.rows(49, 1)}, [])")
    n = s.count_if(w, f"abs({x} - v) <= {average_range(s)} * {mult!r}")
    is_equal = boolean(s, f"{x} IS NOT NULL AND {n} > 0")
    return {"is_equal": is_equal, "cluster_size": s.put(f"CASE WHEN {is_equal} THEN {n} + 1 ELSE 0 END"), "cluster_strength": s.put(f"CASE WHEN {is_equal} THEN 10.0 * ({n} + 1) ELSE 0.0 END")}


@indicator("sr.equal_highs")
def equal_highs(s: Sheet, epsilon_mult: float = 0.1) -> dict[str, str]:
    return equals(s, swing(s, "high", 5), epsilon_mult)


@indicator("sr.equal_lows")
def equal_lows(s: Sheet, epsilon_mult: float = 0.1) -> dict[str, str]:
    return equals(s, swing(s, "low", 5), epsilon_mult)


def _pool(side: str):
    def build(s: Sheet) -> str:
        x = last_swing(s, side, 5)
        return s.ffill(f"CASE WHEN {equals(s, x, 0.1)['is_equal']} THEN {x} END")

    return build


indicator("sr.buy_side_liquidity")(_pool("high"))
indicator("sr.sell_side_liquidity")(_pool("low"))


@indicator("sr.liquidity_pool")
def liquidity_pool(s: Sheet) -> str:
    return boolean(s, f"{equal_highs(s)['is_equal']} OR {equal_lows(s)['is_equal']}")


alias("sr.smart_money_level", "sr.liquidity_pool")


@indicator("sr.liquidity_sweep_level")
def liquidity_sweep_level(s: Sheet, length: int = 20) -> str:
    up, low = s.lag(top(s, length)), s.lag(bottom(s, length))
    return boolean(s, f"(high > {up} AND close < {up}) OR (low < {low} AND close > {low})")


alias("sr.stop_hunt_zone", "sr.liquidity_sweep_level")


@indicator("sr.turtle_soup")
def turtle_soup(s: Sheet, length: int = 20) -> str:
    up, low = s.lag(top(s, length)), s.lag(bottom(s, length))
    return boolean(s, f"{liquidity_sweep_level(s, length)} AND ((high > {up} AND close < open) OR (low < {low} AND close > open))")


@indicator("sr.false_breakout")
def false_breakout(s: Sheet, length: int = 20) -> str:
    up = s.lag(top(s, length))
    return boolean(s, f"high > {up} AND close <= {up}")


@indicator("sr.false_breakdown")
def false_breakdown(s: Sheet, length: int = 20) -> str:
    low = s.lag(bottom(s, length))
    return boolean(s, f"low < {low} AND close >= {low}")


alias("sr.judas_swing", "sr.false_breakout", length=10)


@indicator("sr.kill_zones")
def kill_zones(s: Sheet) -> dict[str, str]:
    t = clock(s)
    return {"Asian_KZ": boolean(s, f"{t} >= '20:00' OR {t} <= '00:00'"), "London_KZ": boolean(s, f"{t} >= '02:00' AND {t} <= '05:00'"), "NY_KZ": boolean(s, f"{t} >= '07:00' AND {t} <= '10:00'")}


@indicator("sr.initial_balance")
def initial_balance(s: Sheet) -> dict[str, str]:
    """High and low of a session's first hour, known from its end on (so far, within it)."""
    day = s.put("cast(ts AS date)")
    first = s.put(f"min(ts) OVER (PARTITION BY {s.key}, {day})")
    early = s.put(f"ts < {first} + INTERVAL '1' HOUR")
    return {k: s.cum(f, f"CASE WHEN {early} THEN {x} END", day) for k, f, x in (("IB_High", "max", "high"), ("IB_Low", "min", "low"))}


@indicator("sr.amd_cycle")
def amd_cycle(s: Sheet) -> dict[str, str]:
    b = initial_balance(s)
    return {
        "Accumulation": boolean(s, f"{b['IB_High']} - {b['IB_Low']} < 1.5 * {average_range(s)}"), "Manipulation": turtle_soup(s),
        "Distribution": boolean(s, f"close > {confirmed(s, 'high', 5)} OR close < {confirmed(s, 'low', 5)}"),
    }


# strength of levels -----------------------------------------------------------------------------------------------


def touches(s: Sheet, x: str, target: str, n: int, mult: float) -> str:
    w = s.values(x, positive(n), 1)
    near = s.count_if(w, f"abs(v - {target}) / CASE WHEN {target} = 0 THEN {EPS} ELSE {target} END <= {mult!r} * {average_range(s)}")
    return s.put(f"coalesce(CASE WHEN {target} IS NOT NULL THEN {near} END, 0)")


@indicator("sr.support_touch_count")
def support_touch_count(s: Sheet, length: int = 50, epsilon_mult: float = 0.1) -> str:
    return touches(s, "low", last_swing(s, "low", 5), length, epsilon_mult)


@indicator("sr.resistance_touch_count")
def resistance_touch_count(s: Sheet, length: int = 50, epsilon_mult: float = 0.1) -> str:
    return touches(s, "high", last_swing(s, "high", 5), length, epsilon_mult)


@indicator("sr.level_strength")
def level_strength(s: Sheet) -> str:
    return s.put(f"{support_touch_count(s)} + {resistance_touch_count(s)}")


alias("sr.bounce_count", "sr.level_strength")


@indicator("sr.level_confidence")
def level_confidence(s: Sheet) -> str:
    return s.put(f"least(greatest({level_strength(s)} / 5.0, 0.0), 1.0)")


@indicator("sr.zone_width")
def zone_width(s: Sheet) -> str:
    z = support_zone(s)
    return s.put(f"{z['upper']} - {z['lower']}")


@indicator("sr.distance_to_support")
def distance_to_support(s: Sheet) -> str:
    return s.put(f"close - {last_swing(s, 'low', 5)}")


@indicator("sr.distance_to_resistance")
def distance_to_resistance(s: Sheet) -> str:
    return s.put(f"{last_swing(s, 'high', 5)} - close")


alias("sr.risk_distance", "sr.distance_to_support")
alias("sr.reward_distance", "sr.distance_to_resistance")
alias("sr.nearest_support", "sr.last_swing_low")
alias("sr.nearest_resistance", "sr.last_swing_high")


@indicator("sr.confirmed_breakout")
def confirmed_breakout(s: Sheet, length: int = 20) -> str:
    return boolean(s, f"{highest_high_breakout(s, length)} AND abs(close - open) > {s.lag(s.roll('avg', 'abs(close - open)', length))}")


@indicator("sr.confirmed_breakdown")
def confirmed_breakdown(s: Sheet, length: int = 20) -> str:
    return boolean(s, f"{lowest_low_breakdown(s, length)} AND abs(close - open) > {s.lag(s.roll('avg', 'abs(close - open)', length))}")


@indicator("sr.retest_level")
def retest_level(s: Sheet) -> str:
    high, low, eps = confirmed(s, "high", 5), confirmed(s, "low", 5), f"0.1 * {average_range(s)}"
    return boolean(s, f"coalesce(low <= {high} + {eps} AND close >= {high}, false) OR coalesce(high >= {low} - {eps} AND close <= {low}, false)")


@indicator("sr.break_strength")
def break_strength(s: Sheet) -> str:
    return s.put(s.div("abs(close - open)", s.lag(s.roll("avg", "abs(close - open)", 20)), "1.0"))


@indicator("sr.support_percentile")
def support_percentile(s: Sheet, length: int = 252) -> str:
    return rank_share(s, bottom(s, 20), length)


@indicator("sr.resistance_percentile")
def resistance_percentile(s: Sheet, length: int = 252) -> str:
    return rank_share(s, top(s, 20), length)


def _score(s: Sheet, x: str, n: int) -> str:
    return s.put(s.div(f"{x} - {s.roll('avg', x, positive(n))}", s.roll("stddev_samp", x, n)))


@indicator("sr.support_zscore")
def support_zscore(s: Sheet, length: int = 50) -> str:
    return _score(s, bottom(s, 20), length)


@indicator("sr.resistance_zscore")
def resistance_zscore(s: Sheet, length: int = 50) -> str:
    return _score(s, top(s, 20), length)


@indicator("sr.atr_support")
def atr_support(s: Sheet, length: int = 14, mult: float = 2.0) -> str:
    return s.put(f"close - {mult!r} * {average_range(s)}")


@indicator("sr.atr_resistance")
def atr_resistance(s: Sheet, length: int = 14, mult: float = 2.0) -> str:
    return s.put(f"close + {mult!r} * {average_range(s)}")


alias("sr.volatility_support", "sr.atr_support")
alias("sr.volatility_resistance", "sr.atr_resistance")


@indicator("sr.adaptive_breakout")
def adaptive_breakout(s: Sheet, length: int = 20, mult: float = 2.0) -> dict[str, str]:
    return {"upper": atr_resistance(s, length, mult), "lower": atr_support(s, length, mult)}


def _merged(s: Sheet, f: str, parts: list[str]) -> str:
    return s.put(f"CASE WHEN {' AND '.join(f'{p} IS NOT NULL' for p in parts)} THEN {f}({', '.join(parts)}) END")


@indicator("sr.merged_support")
def merged_support(s: Sheet) -> str:
    return _merged(s, "greatest", [bottom(s, n) for n in (1, 5, 21)])


@indicator("sr.merged_resistance")
def merged_resistance(s: Sheet) -> str:
    return _merged(s, "least", [top(s, n) for n in (1, 5, 21)])


@indicator("sr.price_cluster")
def price_cluster(s: Sheet, length: int = 50, bins: int = 10) -> str:
    """Middle of the fullest bin of the window's prices, the lowest one if several are as full."""
    x, n = price(s, "hlc3"), positive(length)
    w, low, high = s.values(x, n), s.roll("min", x, n), s.roll("max", x, n)
    width = s.put(f"nullif(({high} - {low}) / {bins}, 0)")
    counts = [s.count_if(w, f"least(floor((v - {low}) / {width}), {bins - 1}) = {b}") for b in range(bins)]
    most = s.put(f"greatest({', '.join(counts)})")
    first = " ".join(f"WHEN {c} = {most} THEN {b}" for b, c in enumerate(counts))
    return s.put(f"CASE WHEN {w} IS NULL THEN NULL WHEN {width} IS NULL THEN {x} ELSE {low} + {width} * ((CASE {first} END) + 0.5) END")


@indicator("sr.cluster_support")
def cluster_support(s: Sheet, length: int = 50, bins: int = 10) -> str:
    return s.put(f"{price_cluster(s, length, bins)} - 0.5 * {average_range(s)}")


@indicator("sr.cluster_resistance")
def cluster_resistance(s: Sheet, length: int = 50, bins: int = 10) -> str:
    return s.put(f"{price_cluster(s, length, bins)} + 0.5 * {average_range(s)}")


@indicator("sr.cluster_density")
def cluster_density(s: Sheet, length: int = 50) -> str:
    c = price_cluster(s, length)
    near = s.count_if(s.values("close", length, 1), f"abs(v - {c}) <= 0.5 * {average_range(s)}")
    return s.put(f"coalesce(CASE WHEN {c} IS NOT NULL THEN {near} END, 0)")


@indicator("sr.cluster_strength")
def cluster_strength(s: Sheet, length: int = 50) -> str:
    return s.put(f"{cluster_density(s, length)} / {float(length)!r}")


alias("sr.structure_resistance", "sr.last_swing_high")
alias("sr.structure_support", "sr.last_swing_low")


def _moved(side: str, sign: str):
    def build(s: Sheet, length: int = 5) -> str:
        x = confirmed(s, side, length)
        return boolean(s, f"{x} {sign} {s.lag(x)}")

    return build


for _name, _side, _sign in (("higher_high", "high", ">"), ("lower_high", "high", "<"), ("higher_low", "low", ">"), ("lower_low", "low", "<")):
    indicator(f"sr.{_name}")(_moved(_side, _sign))


def _bins(reach: float, width: float | None) -> int:
    return int(min(50, max(3, reach / (0.1 * width)))) if width else 10


@indicator("sr.adaptive_volume_profile", machine=True)
def adaptive_volume_profile(s: Sheet, length: int = 20) -> dict[str, str]:
    def sql(sheet: Sheet, table: str, inputs: list[str], outputs: list[str]) -> str:
        p, v, w = inputs
        bins = f"CASE WHEN coalesce({w}, 0) = 0 THEN 10 ELSE least(50, greatest(3, trunc((hi_ - lo_) / (0.1 * {w}))))::INT END"
        return profile_sql(table, window_sql(sheet, p, v, length), p, bins, outputs)

    got = s.machine(rolling_profile(positive(length), _bins), [price(s, "hlc3"), "volume", average_range(s)], OUTPUTS, ("adaptive profile", length), sql=sql)
    return {k: got[k] for k in OUTPUTS[:3]}


def _anchored(side: str):
    def build(s: Sheet) -> str:
        x = confirmed(s, side, 5)
        run = s.cum("sum", f"CASE WHEN {s.flag(f'{x} <> {s.lag(x)}')} OR ({x} IS NOT NULL AND {s.lag(x)} IS NULL) THEN 1 ELSE 0 END")
        p = price(s, "hlc3")
        return s.put(f"CASE WHEN {run} > 0 THEN {s.div(s.cum('sum', f'{p} * volume', run), s.cum('sum', 'volume', run))} END")

    return build


indicator("sr.swing_high_vwap")(_anchored("high"))
indicator("sr.swing_low_vwap")(_anchored("low"))


@indicator("sr.fibonacci_levels")
def fibonacci_levels(s: Sheet, length: int = 20) -> dict[str, str]:
    low, reach = bottom(s, length), s.put(f"{top(s, length)} - {bottom(s, length)}")
    parts = {"Fib_0": 0.0, "Fib_236": 0.236, "Fib_382": 0.382, "Fib_500": 0.5, "Fib_618": 0.618, "Fib_786": 0.786, "Fib_100": 1.0, "GoldenZone_Upper": 0.618, "GoldenZone_Lower": 0.5}
    return {k: s.put(f"{low} + {v!r} * {reach}") for k, v in parts.items()}


@indicator("sr.gann_levels")
def gann_levels(s: Sheet, length: int = 20) -> dict[str, str]:
    low, reach = bottom(s, length), s.put(f"{top(s, length)} - {bottom(s, length)}")
    return {f"Gann_{i}_8": s.put(f"{low} + {i / 8!r} * {reach}") for i in range(9)}


@indicator("sr.murrey_math_levels")
def murrey_math_levels(s: Sheet, length: int = 64) -> dict[str, str]:
    low = bottom(s, length)
    reach = s.put(f"CASE WHEN {top(s, length)} = {low} THEN {EPS} ELSE {top(s, length)} - {low} END")
    unit = s.put(f"power(10.0, floor(log10({reach}))) * 0.125")
    base = s.put(f"floor({low} / {unit}) * {unit}")
    return {f"MM_{i}_8": s.put(f"{base} + {i} * {unit}") for i in range(9)}


#: fixed values: round distances between psychological levels
LADDER = (10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)


@indicator("sr.psychological_levels")
def psychological_levels(s: Sheet) -> str:
    want = s.put(f"greatest(5 * {average_range(s)}, {EPS})")
    between = [(a + b) / 2 for a, b in zip(LADDER, LADDER[1:])]  # the nearer step; the smaller one in the middle
    step = s.put(f"CASE WHEN {want} IS NULL OR {average_range(s)} IS NULL THEN NULL " + " ".join(f"WHEN {want} <= {m!r} THEN {a}.0" for m, a in zip(between, LADDER)) + f" ELSE {LADDER[-1]}.0 END")
    return s.put(f"bround(close / {step}) * {step}", f"round_even(close / {step}, 0) * {step}")


@indicator("sr.gap_levels")
def gap_levels(s: Sheet) -> dict[str, str]:
    c = s.lag("close")
    return {"gap_support": s.ffill(f"CASE WHEN open > {c} THEN {c} END"), "gap_resistance": s.ffill(f"CASE WHEN open < {c} THEN {c} END")}


@indicator("sr.previous_session_levels")
def previous_session_levels(s: Sheet, completed: bool = False) -> dict[str, str]:
    """Extremes of the date of the bar before; ``completed``: of the date before this one (free of look-ahead)."""
    day = s.put("cast(ts AS date)")
    by = f"OVER (PARTITION BY {s.key}, {day})"
    out = {"PDH": s.put(f"max(high) {by}"), "PDL": s.put(f"min(low) {by}")}
    if not completed:
        return {k: s.lag(v) for k, v in out.items()}
    first = s.put(f"{s.lag(day)} IS NULL OR {s.lag(day)} <> {day}")
    return {k: s.ffill(f"CASE WHEN {first} THEN {s.lag(v)} END") for k, v in out.items()}


@indicator("sr.institutional_confluence_score", machine=True)
def institutional_confluence_score(s: Sheet, epsilon_pct: float = 0.005) -> str:
    levels = [
        last_swing(s, "high", 5), last_swing(s, "low", 5), PIVOT_POINT(s), fibonacci_levels(s)["Fib_618"], psychological_levels(s),
        gap_levels(s)["gap_support"], murrey_math_levels(s, 20)["MM_4_8"], adaptive_volume_profile(s)["poc"],
    ]
    near = " + ".join(f"CASE WHEN {s.flag(f'{x} > 0 AND abs(close - {x}) / {x} <= {epsilon_pct!r}')} THEN 1.0 ELSE 0.0 END" for x in levels)
    return s.put(f"100 * ({near}) / {len(levels)}")


def PIVOT_POINT(s: Sheet) -> str:
    return s.put(_CLASSIC.format(h=s.lag("high"), l=s.lag("low"), c=s.lag("close")))


@indicator("sr.mtf_confluence_score", machine=True)
def mtf_confluence_score(s: Sheet) -> str:
    extra = " + ".join(f"CASE WHEN {s.flag(f'abs(close - {bottom(s, n)}) <= 0.005 * close')} THEN {p} ELSE 0.0 END" for n, p in ((1, 10.0), (5, 15.0), (21, 25.0)))
    return s.put(f"least(greatest({institutional_confluence_score(s)} + {extra}, 0.0), 100.0)")


@indicator("sr.level_reliability_ranking", machine=True)
def level_reliability_ranking(s: Sheet) -> str:
    x = s.put(f"coalesce({mtf_confluence_score(s)}, 0.0)")
    return s.mark(f"CASE WHEN {x} >= 90 THEN 'Elite' WHEN {x} >= 75 THEN 'Institutional' WHEN {x} >= 50 THEN 'Strong' WHEN {x} >= 30 THEN 'Moderate' WHEN {x} >= 15 THEN 'Weak' ELSE 'Very Weak' END", "string")

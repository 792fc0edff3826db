"""Market structure, liquidity, order blocks and fair value gaps (names smc.*).

Swings stand at their own bar (``levels.swing``); what follows from them is therefore known ``length`` bars later. States of
order blocks and gaps stand at the bar where the block or gap lies and tell what the next 50 bars made of it. With ``known``
everything is as each bar can know it.
"""

from __future__ import annotations

from tapeloom.functions.sheet import Sheet, plain

from .base import alias, indicator, positive
from .levels import boolean, bottom, confirmed, swing, top
from .momentum import true_range

#: fixed values: codes of the states
FRESH, MITIGATED, FILLED, INVALIDATED, INVERTED, RECLAIMED, BLOCK = 1, 2, 3, 4, 5, 6, 7
HORIZON, BACK, SWEPT = 50, 14, 10


def mean_range(s: Sheet, n: int = 14) -> str:
    return s.put(f"coalesce({s.roll('avg', true_range(s), n)}, 0.0)")


def previous(s: Sheet, x: str) -> str:
    """The last value before this bar."""
    x, w = s.put(x), s.over("ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    return s.put(f"last_value({x}) IGNORE NULLS {w}", f"last_value({x} IGNORE NULLS) {w}")


def structure(s: Sheet, n: int, known: bool = False) -> dict[str, str]:
    """bos, choch and trend (-1, 0, 1): crossings of the last swings, in the trend's direction or against it.

    ``known``: of the last swings that the bar can know of, ``n`` bars after them.
    """

    def make():
        held = [0, None]

        def step(close, up, down):
            rows, (close,) = [], plain(close)
            for c, h, low in zip(close, up, down):
                trend, old = held
                bos = choch = 0
                crossed = {
                    1: h is not None and c > h and (trend == 0 or (old is not None and old <= h)),
                    -1: low is not None and c < low and (trend == 0 or (old is not None and old >= low)),
                }
                order = (trend, -trend) if trend else (1, -1)
                for side in order:
                    if crossed[side]:
                        if side == trend:
                            bos = side
                        else:
                            choch = trend = side
                        break
                held[:] = [trend, c]
                rows.append((bos, choch, trend))
            return list(zip(*rows))

        return step

    def sql(sheet: Sheet, table: str, inputs: list[str], outputs: list[str]) -> str:
        c, h, low = inputs
        layers = [
            {"up": f"coalesce({c} > {h} AND (r_trend = 0 OR coalesce(r_was <= {h}, false)), false)", "down": f"coalesce({c} < {low} AND (r_trend = 0 OR coalesce(r_was >= {low}, false)), false)"},
            {"hit": "CASE WHEN r_trend >= 0 THEN CASE WHEN up THEN 1 WHEN down THEN -1 ELSE 0 END WHEN down THEN -1 WHEN up THEN 1 ELSE 0 END"},
            {"n_trend": "CASE WHEN hit <> 0 THEN hit ELSE r_trend END", "n_was": c, "bos_": "CASE WHEN hit = r_trend THEN hit ELSE 0 END", "choch_": "CASE WHEN hit = r_trend THEN 0 ELSE hit END"},
        ]
        return sheet.recursion(table, {"trend": "0", "was": "NULL::DOUBLE"}, layers, dict(zip(outputs, ("bos_", "choch_", "n_trend"))))

    ends = [confirmed(s, "high", n), confirmed(s, "low", n)] if known else [s.ffill(swing(s, "high", n)), s.ffill(swing(s, "low", n))]
    return s.machine(make, ["close", *ends], ["bos", "choch", "trend"], ("structure", n, known), sql=sql)


def liquidity(s: Sheet, n: int, known: bool = False) -> dict[str, str]:
    """Levels of swings that no bar has passed yet: their extremes, sweeps of them, and swings equal to one of the last four.

    ``known``: a swing becomes a level at the bar that can know of it, ``n`` bars later.
    """

    def make():
        active: dict[int, list[float]] = {1: [], -1: []}

        def step(high, low, close, up, down, width):
            rows, (high, low, close, width) = [], plain(high, low, close, width)
            for h, lo, c, u, d, w in zip(high, low, close, up, down, width):
                row = {}
                for side, new, reach in ((1, u, h), (-1, d, lo)):
                    levels = active[side]
                    row["eq", side] = 0.0
                    if new is not None:
                        row["eq", side] = float(any(abs(new - x) <= 0.1 * w for x in levels[-4:]))
                        levels.append(new)
                    row["rest", side] = max(levels, key=lambda x: side * x) if levels else None
                    passed = [x for x in levels if side * (reach - x) > 0]
                    row["swept", side] = float(any(side * (c - x) <= 0 for x in passed))
                    if passed:
                        active[side] = [x for x in levels if side * (reach - x) <= 0]
                rows.append([row[k, side] for k in ("swept", "eq", "rest") for side in (1, -1)])
            return list(zip(*rows))

        return step

    def sql(sheet: Sheet, table: str, inputs: list[str], outputs: list[str]) -> str:
        h, lo, c, u, d, w = inputs
        layers = [
            {"ups": f"CASE WHEN {u} IS NULL THEN r_high ELSE list_append(r_high, {u}) END", "downs": f"CASE WHEN {d} IS NULL THEN r_low ELSE list_append(r_low, {d}) END"},
            {
                "n_high": f"list_filter(ups, lambda x: NOT coalesce({h} > x, false))", "n_low": f"list_filter(downs, lambda x: NOT coalesce({lo} < x, false))",
                "eh": f"CASE WHEN {u} IS NOT NULL AND len(list_filter(list_slice(r_high, greatest(len(r_high) - 3, 1), len(r_high)), lambda x: abs({u} - x) <= 0.1 * {w})) > 0 THEN 1 ELSE 0 END",
                "el": f"CASE WHEN {d} IS NOT NULL AND len(list_filter(list_slice(r_low, greatest(len(r_low) - 3, 1), len(r_low)), lambda x: abs({d} - x) <= 0.1 * {w})) > 0 THEN 1 ELSE 0 END",
                "sh": f"CASE WHEN len(list_filter(ups, lambda x: {h} > x AND {c} <= x)) > 0 THEN 1 ELSE 0 END", "sl": f"CASE WHEN len(list_filter(downs, lambda x: {lo} < x AND {c} >= x)) > 0 THEN 1 ELSE 0 END",
            },
        ]
        return sheet.recursion(table, {"high": "[]::DOUBLE[]", "low": "[]::DOUBLE[]"}, layers, dict(zip(outputs, ("sh", "sl", "eh", "el", "list_max(ups)", "list_min(downs)"))))

    at = [s.lag(swing(s, side, n), n) if known else swing(s, side, n) for side in ("high", "low")]
    return s.machine(make, ["high", "low", "close", *at, mean_range(s)], ["bsl_sweep", "ssl_sweep", "eqh", "eql", "bsl", "ssl"], ("liquidity", n, known), sql=sql)


def _births(s: Sheet, n: int, known: bool) -> tuple[str, str, str, str, str]:
    """(gap, push, bos, sweep of buyers, sweep of sellers): what gaps and order blocks come from."""
    st, lq, width = structure(s, n, known), liquidity(s, n, known), mean_range(s)
    strong = s.put(s.flag(f"high - low > 1.5 * {width} AND volume > 1.2 * coalesce({s.lag(s.roll('avg', 'volume', 20))}, 0.0)"))
    gap = s.put(
        f"CASE WHEN {s.flag(f'low > {s.lag('high', 2)} AND low - {s.lag('high', 2)} > 0.1 * {width}')} THEN 1 "
        f"WHEN {s.flag(f'high < {s.lag('low', 2)} AND {s.lag('low', 2)} - high > 0.1 * {width}')} THEN -1 ELSE 0 END"
    )
    push = s.put(f"CASE WHEN {strong} AND close > open THEN 1 WHEN {strong} AND close < open THEN -1 ELSE 0 END")
    return gap, push, st["bos"], lq["bsl_sweep"], lq["ssl_sweep"]


def lifecycle(s: Sheet, n: int) -> dict[str, str]:
    """Gaps and order blocks with what the bars after them did, and structure shifts: a bar waits for its horizon to pass."""
    births = _births(s, n, False)

    def make():
        def step(o, h, low, c, gap_, push_, bos, bsl, ssl):
            size, (o, h, low, c) = len(o), plain(o, h, low, c)
            gaps: dict[int, list] = {}
            blocks: dict[int, list] = {}
            f, b = [[0, None, None, 0.0] for _ in range(size)], [[0, None, None, 0.0] for _ in range(size)]
            shift = [0.0] * size
            for i in range(size):
                side = gap_[i]
                if i >= 2 and side and side == push_[i]:
                    near, far = (low[i], h[i - 2]) if side > 0 else (h[i], low[i - 2])
                    gaps[i] = [side, FRESH, near, far]
                    if bos[i] == side:
                        shift[i] = float(side)
                if i >= 2 and side and bos[i] == side:
                    swept = any((ssl if side > 0 else bsl)[max(0, i - SWEPT) : i])
                    for j in range(i - 1, max(-1, i - BACK - 1), -1):
                        if side * (c[j] - o[j]) < 0:
                            near, far = (h[j], low[j]) if side > 0 else (low[j], h[j])
                            blocks[j] = [side, FRESH if swept else BLOCK, near, far]
                            break
                for held, out, is_gap in ((gaps, f, True), (blocks, b, False)):
                    for k in list(held):
                        if k < i - HORIZON:
                            _settle(out, k, held.pop(k))
                        elif k < i and i >= 2:
                            item = held[k]
                            out[k][3] += item[1] in (FRESH, MITIGATED)
                            _meet(item, low[i] if item[0] > 0 else h[i], c[i], is_gap)
            for held, out in ((gaps, f), (blocks, b)):
                for k, item in held.items():
                    _settle(out, k, item)
            return [*zip(*f), *zip(*b), shift] if size else [[]] * 9

        return step

    outputs = ["fvg", "fvg_top", "fvg_bottom", "fvg_age", "ob", "ob_top", "ob_bottom", "ob_age", "mss"]
    return s.machine(make, ["open", "high", "low", "close", *births], outputs, ("lifecycle", n), sql=_lifecycle_sql, reach=max(BACK, SWEPT, 2), ahead=HORIZON)


def _met_sql(state: str, near: str, far: str, side: str, reach: str, close: str, is_gap: bool) -> tuple[str, str]:
    """(state, near edge) after a later bar has met a gap or block, as ``_meet`` has it."""
    live, broken, touched = f"{state} IN ({FRESH}, {MITIGATED})", f"coalesce({side} * ({close} - {far}) < 0, false)", f"coalesce({side} * ({reach} - {near}) < 0, false)"
    if is_gap:
        filled = f"coalesce({side} * ({reach} - {far}) <= 0, false)"
        after = f"CASE WHEN {live} AND {touched} THEN CASE WHEN {broken} THEN {INVERTED} WHEN {filled} THEN {FILLED} ELSE {MITIGATED} END ELSE {state} END"
        return after, f"CASE WHEN {live} AND {touched} AND NOT {broken} AND NOT {filled} THEN {reach} ELSE {near} END"
    after = f"CASE WHEN {live} AND {broken} THEN {INVERTED} WHEN {live} AND {touched} THEN {MITIGATED} WHEN {state} = {BLOCK} AND {broken} THEN {INVALIDATED} ELSE {state} END"
    return f"CASE WHEN {after} = {INVERTED} AND coalesce({side} * ({close} - {near}) > 0, false) THEN {RECLAIMED} ELSE {after} END", near


def _cause_sql(sheet: Sheet, table: str, inputs: list[str]) -> str:
    """The table with cause_ (the row whose candle becomes an order block at this bar) and swept_ (after a sweep)."""
    o, _, _, c, gap, _, bos, bsl, ssl = inputs
    before, ago = sheet.over(f"ROWS BETWEEN {BACK} PRECEDING AND 1 PRECEDING"), sheet.over(f"ROWS BETWEEN {SWEPT} PRECEDING AND 1 PRECEDING")
    last = {side: f"last_value(CASE WHEN {c} {sign} {o} THEN rn_ END IGNORE NULLS) {before}" for side, sign in ((1, "<"), (-1, ">"))}
    return (
        f"SELECT *, CASE WHEN rn_ >= 3 AND {gap} <> 0 AND {bos} = {gap} THEN CASE WHEN {gap} > 0 THEN {last[1]} ELSE {last[-1]} END END AS cause_, "
        f"coalesce(CASE WHEN {gap} > 0 THEN max({ssl}) {ago} ELSE max({bsl}) {ago} END > 0, false) AS swept_ FROM {table}"
    )


def _lifecycle_sql(sheet: Sheet, table: str, inputs: list[str], outputs: list[str]) -> str:
    """Every bar with the bars of its horizon as a list, and a fold over that list for the bar's gap and its block."""
    _, h, lo, c, gap, push, bos, _, _ = inputs
    ahead = sheet.over(f"ROWS BETWEEN 1 FOLLOWING AND {HORIZON} FOLLOWING")
    bar = f"struct_pack(h := {h}, l := {lo}, c := {c}, cause := cause_, side := {gap}::INT, swept := swept_, st := 0, nr := NULL::DOUBLE, fr := NULL::DOUBLE, sd := 0, age := 0)"
    born = f"({gap} <> 0 AND {gap} = {push} AND rn_ >= 3)"
    listed = f"SELECT *, coalesce(list({bar}) {ahead}, []) AS ahead_, lag({h}, 2) {sheet.over()} AS h2_, lag({lo}, 2) {sheet.over()} AS l2_ FROM ({_cause_sql(sheet, table, inputs)})"
    state, near = _met_sql("a.st", "a.nr", "a.fr", "a.sd", "(CASE WHEN a.sd > 0 THEN x.l ELSE x.h END)", "x.c", True)
    same = "h := x.h, l := x.l, c := x.c, cause := x.cause, side := x.side, swept := x.swept"
    first = f"struct_pack(h := {h}, l := {lo}, c := {c}, cause := cause_, side := {gap}::INT, swept := swept_, st := CASE WHEN {born} THEN {FRESH} ELSE 0 END, nr := CASE WHEN {gap} > 0 THEN {lo} ELSE {h} END, fr := CASE WHEN {gap} > 0 THEN h2_ ELSE l2_ END, sd := {gap}::INT, age := 0)"
    gaps = f"list_reduce(list_concat([{first}], ahead_), lambda a, x: struct_pack({same}, st := {state}, nr := {near}, fr := a.fr, sd := a.sd, age := a.age + CASE WHEN a.st IN ({FRESH}, {MITIGATED}) THEN 1 ELSE 0 END))"
    # a bar that makes this one a block does so before it meets it
    made = "coalesce(x.cause = rn_, false)"
    st, sd = f"(CASE WHEN {made} THEN CASE WHEN x.swept THEN {FRESH} ELSE {BLOCK} END ELSE a.st END)", f"(CASE WHEN {made} THEN x.side ELSE a.sd END)"
    nr, fr = f"(CASE WHEN {sd} > 0 THEN {h} ELSE {lo} END)", f"(CASE WHEN {sd} > 0 THEN {lo} ELSE {h} END)"
    state, _ = _met_sql(st, nr, fr, sd, f"(CASE WHEN {sd} > 0 THEN x.l ELSE x.h END)", "x.c", False)
    none = f"struct_pack(h := {h}, l := {lo}, c := {c}, cause := cause_, side := 0, swept := false, st := 0, nr := NULL::DOUBLE, fr := NULL::DOUBLE, sd := 0, age := 0)"
    blocks = f"list_reduce(list_concat([{none}], ahead_), lambda a, x: struct_pack({same}, st := {state}, nr := a.nr, fr := a.fr, sd := {sd}, age := a.age + CASE WHEN {st} IN ({FRESH}, {MITIGATED}) THEN 1 ELSE 0 END))"
    held = f"SELECT *, {gaps} AS g_, {blocks} AS b_ FROM ({listed})"
    forms = (
        "g_.sd * g_.st", "CASE WHEN g_.st > 0 THEN CASE WHEN g_.sd > 0 THEN g_.nr ELSE g_.fr END END", "CASE WHEN g_.st > 0 THEN CASE WHEN g_.sd > 0 THEN g_.fr ELSE g_.nr END END", "CASE WHEN g_.st > 0 THEN g_.age ELSE 0 END",
        "b_.sd * b_.st", f"CASE WHEN b_.st > 0 THEN {h} END", f"CASE WHEN b_.st > 0 THEN {lo} END", "b_.age", f"CASE WHEN {born} AND {bos} = {gap} THEN {gap} ELSE 0 END",
    )
    return f"SELECT * EXCLUDE (cause_, swept_, ahead_, h2_, l2_, g_, b_), {', '.join(f'({f})::DOUBLE AS {o}' for f, o in zip(forms, outputs))} FROM ({held})"


def open_zones(s: Sheet, n: int) -> dict[str, str]:
    """The newest gap and order block as each bar can know them: the same lifecycles, without any look-ahead.

    Codes, edges and ages are those after this bar; a zone ends with its horizon or when it is filled or invalidated. mss is
    known at its own bar.
    """

    def make():
        past: list[tuple] = []  # the last bars: open, high, low, close, sweeps
        zones: dict[str, list] = {"fvg": [], "ob": []}  # [born, side, state, near, far, age]
        at = [0]

        def step(o, h, low, c, gap_, push_, bos, bsl, ssl):
            rows, (o, h, low, c) = [], plain(o, h, low, c)
            for row in zip(o, h, low, c, gap_, push_, bos, bsl, ssl):
                i, (_, hi, lo, cl, side, push, broke, _, _) = at[0], row
                at[0] += 1
                shift = float(side) if i >= 2 and side and side == push and broke == side else 0.0
                if i >= 2 and side and broke == side:
                    swept = any(p[8 if side > 0 else 7] for p in past[-SWEPT:])
                    for k in range(1, min(BACK, len(past)) + 1):
                        po, ph, pl, pc = past[-k][:4]
                        if side * (pc - po) < 0:
                            near, far = (ph, pl) if side > 0 else (pl, ph)
                            zones["ob"] = [z for z in zones["ob"] if z[0] != i - k] + [[i - k, side, FRESH if swept else BLOCK, near, far, 0]]
                            break
                out = []
                for name, held in zones.items():
                    for z in held:
                        item = [z[1], z[2], z[3], z[4]]
                        z[5] += item[1] in (FRESH, MITIGATED)
                        _meet(item, lo if z[1] > 0 else hi, cl, name == "fvg")
                        z[2:5] = item[1:4]
                    zones[name] = [z for z in held if z[2] not in (FILLED, INVALIDATED) and z[0] > i - HORIZON]
                if i >= 2 and side and side == push:
                    near, far = (lo, past[-2][1]) if side > 0 else (hi, past[-2][2])
                    zones["fvg"].append([i, side, FRESH, near, far, 0])
                for held in zones.values():
                    z = held[-1] if held else None
                    out += [0.0, None, None, 0.0] if z is None else [float(z[1] * z[2]), *((z[3], z[4]) if z[1] > 0 else (z[4], z[3])), float(z[5])]
                rows.append((*out, shift))
                past.append(row)
                del past[: -max(BACK, SWEPT)]
            return list(zip(*rows))

        return step

    outputs = ["fvg", "fvg_top", "fvg_bottom", "fvg_age", "ob", "ob_top", "ob_bottom", "ob_age", "mss"]
    return s.machine(make, ["open", "high", "low", "close", *_births(s, n, True)], outputs, ("open zones", n), sql=_open_zones_sql)


def _open_zones_sql(sheet: Sheet, table: str, inputs: list[str], outputs: list[str]) -> str:
    """One row after another, with the zones that are open as lists of the state."""
    _, h, lo, c, gap, push, bos, _, _ = inputs
    base = f"SELECT t.*, (cause_ IS NOT NULL) AS made_, p.{h} AS ch_, p.{lo} AS cl_, lag(t.{h}, 2) OVER (PARTITION BY t.{sheet.key} ORDER BY t.rn_) AS h2_, lag(t.{lo}, 2) OVER (PARTITION BY t.{sheet.key} ORDER BY t.rn_) AS l2_ FROM ({_cause_sql(sheet, table, inputs)}) t LEFT JOIN {table} p ON p.{sheet.key} = t.{sheet.key} AND p.rn_ = t.cause_"
    kind = "STRUCT(b BIGINT, sd INT, st INT, nr DOUBLE, fr DOUBLE, age INT)[]"

    def met(is_gap: bool) -> str:
        state, near = _met_sql("z.st", "z.nr", "z.fr", "z.sd", f"(CASE WHEN z.sd > 0 THEN {lo} ELSE {h} END)", c, is_gap)
        return f"lambda z: struct_pack(b := z.b, sd := z.sd, st := {state}, nr := {near}, fr := z.fr, age := z.age + CASE WHEN z.st IN ({FRESH}, {MITIGATED}) THEN 1 ELSE 0 END)"

    kept = f"lambda z: z.st NOT IN ({FILLED}, {INVALIDATED}) AND z.b > rn_ - {HORIZON}"
    block = f"struct_pack(b := cause_, sd := {gap}::INT, st := CASE WHEN swept_ THEN {FRESH} ELSE {BLOCK} END, nr := CASE WHEN {gap} > 0 THEN ch_ ELSE cl_ END, fr := CASE WHEN {gap} > 0 THEN cl_ ELSE ch_ END, age := 0)"
    fresh = f"struct_pack(b := rn_, sd := {gap}::INT, st := {FRESH}, nr := CASE WHEN {gap} > 0 THEN {lo} ELSE {h} END, fr := CASE WHEN {gap} > 0 THEN h2_ ELSE l2_ END, age := 0)"
    born = f"coalesce({gap} <> 0 AND {gap} = {push} AND rn_ >= 3, false)"
    layers = [
        {"blocks_": f"CASE WHEN made_ THEN list_append(list_filter(r_ob, lambda z: z.b <> cause_), {block}) ELSE r_ob END"},
        {"n_ob": f"list_filter(list_transform(blocks_, {met(False)}), {kept})", "gaps_": f"list_filter(list_transform(r_fvg, {met(True)}), {kept})"},
        {"n_fvg": f"CASE WHEN {born} THEN list_append(gaps_, {fresh}) ELSE gaps_ END"},
        {"g_": "n_fvg[len(n_fvg)]", "b_": "n_ob[len(n_ob)]"},
    ]
    forms = []
    for z in ("g_", "b_"):
        forms += [f"coalesce({z}.sd * {z}.st, 0)", f"CASE WHEN {z}.sd > 0 THEN {z}.nr ELSE {z}.fr END", f"CASE WHEN {z}.sd > 0 THEN {z}.fr ELSE {z}.nr END", f"coalesce({z}.age, 0)"]
    forms.append(f"CASE WHEN {born} AND {bos} = {gap} THEN {gap} ELSE 0 END")
    walked = sheet.recursion("zones_", {"fvg": f"[]::{kind}", "ob": f"[]::{kind}"}, layers, dict(zip(outputs, forms)))
    return f"WITH zones_ AS MATERIALIZED ({base}) SELECT * EXCLUDE (cause_, swept_, made_, ch_, cl_, h2_, l2_) FROM ({walked})"




def _meet(item: list, reach: float, close: float, is_gap: bool) -> None:
    """A later bar meets a gap or block (side, state, near edge, far edge)."""
    side, state, near, far = item
    broken = side * (close - far) < 0
    if state in (FRESH, MITIGATED):
        touched = side * (reach - near) < 0
        if is_gap:
            if touched:
                if broken:
                    item[1] = INVERTED
                elif side * (reach - far) <= 0:
                    item[1] = FILLED
                else:
                    item[1:3] = [MITIGATED, reach]
        elif broken:
            item[1] = INVERTED
        elif touched:
            item[1] = MITIGATED
    elif state == BLOCK and broken:
        item[1] = INVALIDATED
    if not is_gap and item[1] == INVERTED and side * (close - near) > 0:
        item[1] = RECLAIMED


def _settle(out: list, k: int, item: list) -> None:
    side, state, near, far = item
    out[k][:3] = [float(side * state), *((near, far) if side > 0 else (far, near))]


def zones(s: Sheet, n: int, known: bool) -> dict[str, str]:
    return open_zones(s, n) if known else lifecycle(s, n)


@indicator("smc.structure", machine=True)
def structure_(s: Sheet, length: int = 5) -> dict[str, str]:
    return structure(s, positive(length))


@indicator("smc.swing_high")
def swing_high(s: Sheet, length: int = 5) -> str:
    return swing(s, "high", positive(length))


@indicator("smc.swing_low")
def swing_low(s: Sheet, length: int = 5) -> str:
    return swing(s, "low", positive(length))


def _pivot(side: str, sign: str):
    def build(s: Sheet, length: int = 5) -> str:
        x = swing(s, side, positive(length))
        return boolean(s, f"{x} {sign} {previous(s, x)}")

    return build


for _name, _side, _sign in (("higher_high", "high", ">"), ("lower_high", "high", "<="), ("higher_low", "low", ">"), ("lower_low", "low", "<=")):
    indicator(f"smc.{_name}")(_pivot(_side, _sign))


def _of(stage, c: str, form: str = "{}", kind: str = "double"):
    def build(s: Sheet, length: int = 5) -> str:
        text = form.format(stage(s, positive(length))[c])
        return boolean(s, text) if kind == "boolean" else s.put(text)

    return build


for _name, _c in (("bos", "bos"), ("choch", "choch"), ("trend_state", "trend")):
    indicator(f"smc.{_name}", machine=True)(_of(structure, _c))
for _kind, _n in (("internal", 5), ("external", 20)):
    alias(f"smc.{_kind}_bos", "smc.bos", length=_n)
    alias(f"smc.{_kind}_choch", "smc.choch", length=_n)
alias("smc.trend_bias", "smc.trend_state", length=20)
indicator("smc.market_structure_shift", machine=True)(_of(lifecycle, "mss"))


@indicator("smc.structure_strength", machine=True)
def structure_strength(s: Sheet, known: bool = False) -> str:
    return s.put(f"CASE WHEN {structure(s, 5, known)['trend']} = {structure(s, 20, known)['trend']} THEN 100.0 ELSE 50.0 END")


alias("smc.trend_score", "smc.structure_strength")

for _name, _c in (("buy_side_liquidity", "bsl"), ("sell_side_liquidity", "ssl")):
    indicator(f"smc.{_name}", machine=True)(_of(liquidity, _c))
for _name, _c in (("equal_high", "eqh"), ("equal_low", "eql")):
    indicator(f"smc.{_name}", machine=True)(_of(liquidity, _c, "{} > 0", "boolean"))
alias("smc.internal_liquidity", "smc.buy_side_liquidity", length=5)
alias("smc.external_liquidity", "smc.buy_side_liquidity", length=20)


@indicator("smc.liquidity_pool", machine=True)
def liquidity_pool(s: Sheet, length: int = 5) -> dict[str, str]:
    got = liquidity(s, positive(length))
    return {"BSL": got["bsl"], "SSL": got["ssl"]}


alias("smc.resting_liquidity", "smc.liquidity_pool")


@indicator("smc.liquidity_sweep", machine=True)
def liquidity_sweep(s: Sheet, length: int = 5, known: bool = False) -> str:
    got = liquidity(s, positive(length), known)
    return s.put(f"CASE WHEN {got['bsl_sweep']} > 0 THEN -1 WHEN {got['ssl_sweep']} > 0 THEN 1 ELSE 0 END")


alias("smc.liquidity_grab", "smc.liquidity_sweep")
alias("smc.stop_hunt", "smc.liquidity_sweep")


@indicator("smc.liquidity_density", machine=True)
def liquidity_density(s: Sheet, length: int = 5, known: bool = False) -> str:
    got = liquidity(s, positive(length), known)
    return s.roll("sum", f"{got['eqh']} + {got['eql']}", 20)


@indicator("smc.liquidity_strength", machine=True)
def liquidity_strength(s: Sheet, length: int = 5, known: bool = False) -> str:
    return s.put(f"least(greatest(10 * {liquidity_density(s, length, known)}, 0.0), 100.0)")


def _zone(what: str, sign: str):
    def build(s: Sheet, length: int = 5) -> dict[str, str]:
        got = lifecycle(s, positive(length))
        state = got[what]
        on = boolean(s, f"{state} IN ({sign}{FRESH}, {sign}{MITIGATED})")
        return {"active": on, "top": s.put(f"CASE WHEN {on} THEN {got[what + '_top']} END"), "bottom": s.put(f"CASE WHEN {on} THEN {got[what + '_bottom']} END")}

    return build


for _name, _what, _sign in (("bullish_order_block", "ob", ""), ("bearish_order_block", "ob", "-"), ("bullish_fvg", "fvg", ""), ("bearish_fvg", "fvg", "-")):
    indicator(f"smc.{_name}", machine=True)(_zone(_what, _sign))
for _name, _what, _states in (
    ("fresh_order_block", "ob", (FRESH,)), ("mitigated_order_block", "ob", (MITIGATED,)), ("invalidated_order_block", "ob", (INVALIDATED,)), ("reclaimed_order_block", "ob", (RECLAIMED,)), ("breaker_block", "ob", (INVERTED,)),
    ("mitigation_block", "ob", (BLOCK,)), ("inverse_fvg", "fvg", (INVERTED,)), ("active_fvg", "fvg", (FRESH, MITIGATED)), ("mitigated_fvg", "fvg", (MITIGATED,)), ("filled_fvg", "fvg", (FILLED,)),
):
    indicator(f"smc.{_name}", machine=True)(_of(lifecycle, _what, "abs({}) IN (" + ", ".join(map(str, _states)) + ")", "boolean"))
indicator("smc.order_block_age", machine=True)(_of(lifecycle, "ob_age"))
indicator("smc.fvg_age", machine=True)(_of(lifecycle, "fvg_age"))


@indicator("smc.order_block_strength", machine=True)
def order_block_strength(s: Sheet, length: int = 5, known: bool = False) -> str:
    g = zones(s, positive(length), known)
    return s.put(f"CASE WHEN {g['ob']} <> 0 THEN volume / CASE WHEN {g['ob_top']} = {g['ob_bottom']} THEN 1e-10 ELSE {g['ob_top']} - {g['ob_bottom']} END ELSE 0.0 END")


@indicator("smc.order_block_score", machine=True)
def order_block_score(s: Sheet, length: int = 5) -> str:
    x = order_block_strength(s, length)
    return s.put(f"least(greatest(10 * {s.div(x, s.roll('avg', x, 50), '1.0')}, 0.0), 100.0)")


@indicator("smc.fvg_strength", machine=True)
def fvg_strength(s: Sheet, length: int = 5, known: bool = False) -> str:
    g = zones(s, positive(length), known)
    return s.put(f"CASE WHEN {g['fvg']} <> 0 THEN abs({g['fvg_top']} - {g['fvg_bottom']}) ELSE 0.0 END")


alias("smc.fvg_width", "smc.fvg_strength")


@indicator("smc.fvg_score", machine=True)
def fvg_score(s: Sheet) -> str:
    w = fvg_strength(s)
    on = _of(lifecycle, "fvg", f"abs({{}}) IN ({FRESH}, {MITIGATED})", "boolean")(s)
    return s.put(f"CASE WHEN {on} THEN 100 * {s.div(w, s.all('max', w), '0.0')} ELSE 0.0 END")


def middle(s: Sheet, n: int) -> str:
    return s.put(f"({top(s, positive(n))} + {bottom(s, n)}) / 2")


@indicator("smc.premium_zone")
def premium_zone(s: Sheet, length: int = 20) -> str:
    return boolean(s, f"close > {middle(s, length)}")


@indicator("smc.discount_zone")
def discount_zone(s: Sheet, length: int = 20) -> str:
    return boolean(s, f"close < {middle(s, length)}")


@indicator("smc.equilibrium")
def equilibrium(s: Sheet, length: int = 20) -> str:
    return middle(s, length)


@indicator("smc.ote_zone")
def ote_zone(s: Sheet, length: int = 20) -> dict[str, str]:
    low = bottom(s, length)
    return {k: s.put(f"{low} + {v!r} * ({top(s, length)} - {low})") for k, v in (("618", 0.618), ("786", 0.786))}


@indicator("smc.premium_score")
def premium_score(s: Sheet, length: int = 20) -> str:
    low = bottom(s, length)
    return s.put(f"least(greatest(100 * {s.div(f'close - {low}', f'{top(s, length)} - {low}')}, 0.0), 100.0)")


@indicator("smc.discount_score")
def discount_score(s: Sheet, length: int = 20) -> str:
    return s.put(f"100 - {premium_score(s, length)}")


@indicator("smc.displacement_candle")
def displacement_candle(s: Sheet) -> str:
    return boolean(s, f"abs(close - open) > 1.5 * {mean_range(s)}")


alias("smc.impulse_candle", "smc.displacement_candle")
alias("smc.expansion_candle", "smc.displacement_candle")


@indicator("smc.absorption_candle")
def absorption_candle(s: Sheet) -> str:
    return boolean(s, f"volume > 1.5 * {s.roll('avg', 'volume', 20)} AND abs(close - open) < 0.3 * (high - low)")


@indicator("smc.delta_proxy")
def delta_proxy(s: Sheet) -> str:
    return s.put(f"volume * {s.div('(close - low) - (high - close)', 'high - low', '0.0')}")


@indicator("smc.institutional_volume_proxy")
def institutional_volume_proxy(s: Sheet) -> str:
    return s.put("volume * (high - low)")


@indicator("smc.smart_money_footprint")
def smart_money_footprint(s: Sheet) -> str:
    return boolean(s, f"{displacement_candle(s)} AND volume > 2 * {s.roll('avg', 'volume', 20)}")


for _name, _stage, _form in (("bos_score", structure, "bos"), ("choch_score", structure, "choch")):
    indicator(f"smc.{_name}", machine=True)(_of(_stage, _form, "100.0 * abs({})"))


@indicator("smc.liquidity_score", machine=True)
def liquidity_score(s: Sheet, known: bool = False) -> str:
    return s.put(f"100.0 * abs({liquidity_sweep(s, 5, known)})")


def against_mean(s: Sheet, factor: float, most: float) -> str:
    x = institutional_volume_proxy(s)
    mean = s.roll("avg", x, 50)
    return s.put(f"least(greatest({factor!r} * {x} / CASE WHEN {mean} = 0 THEN 1e-10 ELSE {mean} END, 0.0), {most!r})")


@indicator("smc.institutional_score")
def institutional_score(s: Sheet) -> str:
    x = against_mean(s, 20.0, 100.0)
    return s.put(f"CASE WHEN {s.roll('avg', institutional_volume_proxy(s), 50)} IS NOT NULL THEN {x} END")


@indicator("smc.smart_money_score", machine=True)
def smart_money_score(s: Sheet, known: bool = False) -> str:
    st, g = structure(s, 5, known), zones(s, 5, known)
    marks = f"15 * abs({st['bos']}) + 15 * abs({st['choch']}) + 20 * abs({liquidity_sweep(s, 5, known)}) + CASE WHEN {g['ob']} <> 0 THEN 20 ELSE 0 END + CASE WHEN {g['fvg']} <> 0 THEN 10 ELSE 0 END + CASE WHEN {st['trend']} <> 0 THEN 10 ELSE 0 END"
    return s.put(f"CASE WHEN {s.roll('avg', institutional_volume_proxy(s), 50)} IS NOT NULL THEN least(greatest({marks} + {against_mean(s, 2.0, 10.0)}, 0.0), 100.0) END")


alias("smc.confidence_score", "smc.smart_money_score")

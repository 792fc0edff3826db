"""Column sheets over time slices: a symbol with a third of all bars is many tasks, not one.

``ranked`` gives every bar its place in its symbol's order without gathering a symbol: bars are dealt by range, sorted and
written, and the places follow from the counts of each symbol in each part. A slice is a run of ``rows`` places.

* A recursion ``y += gain * (x - y)`` over a slice is one affine map, ``y -> keep * y + add``. A first pass reduces each slice
  to its map (and to the state it ends in should it begin without one), a scan over the few slices of a symbol gives the state
  each begins with, and a second pass replays the slices. Recursions that read others are reduced level by level.
* A window of n rows sees the last rows of the slice before as a copy, a look ahead the first of the one behind. How many
  follows from the expressions: windows over windows add up.
* Counts, sums, extremes and last values of all bars so far are those of the slice, put together with those of all before it.

State machines without a bound, windows over a symbol's whole series, and windows within days or sessions need a symbol's bars together:
``sliced`` names them in its error, and ``Sheet.spark`` has another way for them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tapeloom.functions.scratch import Scratch
from tapeloom.functions.sheet import CONSTANT, TOKEN, Sheet, _select, _shown

#: places of a slice
ROWS = 1 << 20
OVER = re.compile(r"OVER \(([^()]*)\)")
FRAME = re.compile(r"ROWS BETWEEN (?:(\d+) (PRECEDING|FOLLOWING)|CURRENT ROW) AND (?:(\d+) (PRECEDING|FOLLOWING)|CURRENT ROW)\Z")
STEP = re.compile(r"\b(lag|lead)\(\w+, (\d+)\) OVER \(([^()]*)\)")
SO_FAR = re.compile(r"\b(count|sum|min|max|last_value)\((\w+)\)( IGNORE NULLS)? OVER \(([^()]*) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW\)")
#: how the part so far of a slice goes together with what is before it
TOGETHER = {"count": "coalesce({b}, 0) + {a}", "sum": "CASE WHEN {a} IS NULL THEN {b} ELSE coalesce({b}, 0) + {a} END", "min": "least({b}, {a})", "max": "greatest({b}, {a})", "last_value": "coalesce({a}, {b})"}


class NotSliceable(ValueError):
    """Columns that need all bars of a symbol at once."""


def ranked(bars: DataFrame, sheet: Sheet, scratch: Scratch) -> DataFrame:
    """The bars with ``key_`` (their symbol, never null) and ``rn_``, their place in the symbol's order from 0."""
    key = F.coalesce(F.concat(F.lit("="), F.col(sheet.key).cast("string")), F.lit(""))
    order = ["key_", *sheet.order]
    dealt = bars.withColumn("key_", key).repartitionByRange(*order).sortWithinPartitions(*order)
    # the number grows with the row in a part, and with the part; it is written, so it is drawn once
    dealt = scratch.cut(dealt.withColumn("id_", F.monotonically_increasing_id()), "ranked").withColumn("part_", F.shiftright("id_", 33))
    counts = dealt.groupBy("key_", "part_").agg(F.min("id_").alias("first_"), F.count("*").alias("n_"))
    before = F.expr("coalesce(sum(n_) OVER (PARTITION BY key_ ORDER BY part_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    places = counts.select("key_", "part_", (before - F.col("first_")).alias("shift_"))
    return dealt.join(places, ["key_", "part_"]).withColumn("rn_", F.col("id_") + F.col("shift_")).drop("part_", "id_", "shift_")


# windows --------------------------------------------------------------------------------------------------------------


def _reach(text: str, own: str) -> tuple[int, int] | None:
    """Rows that the windows of an expression look back and ahead; None: more than a slice can know."""
    text = SO_FAR.sub(lambda m: "0" if m[4].startswith(own) else m[0], text)
    back = ahead = 0
    for kind, n, window in STEP.findall(text):
        if not window.startswith(own):
            return None
        back, ahead = (max(back, int(n)), ahead) if kind == "lag" else (back, max(ahead, int(n)))
    for window in OVER.findall(STEP.sub("0", text)):
        frame = FRAME.search(window)
        if frame is None or not window.startswith(own):
            return None
        ends = [int(n) * (1 if side == "FOLLOWING" else -1) if n else 0 for n, side in (frame.group(1, 2), frame.group(3, 4))]
        back, ahead = max(back, -min(ends)), max(ahead, max(ends))
    return back, ahead


def reaches(sheet: Sheet, depth: dict[str, int]) -> tuple[dict[int, tuple[int, int]], dict[str, tuple[int, int]]]:
    """For each pass, and for each column, how many rows the windows behind it look back and ahead, one over the other."""
    own, found, out = f"PARTITION BY {sheet.key} ORDER BY ", {}, {}
    made_by = {c: m for m in sheet.machines for c in m.outputs}
    bad = [c for c in depth if c in made_by and (made_by[c].reach is None or made_by[c].ahead)]
    for c, k in depth.items():
        if c in sheet.folds and any(depth.get(n) == k and n in made_by for n in (sheet.folds[c].seed, sheet.folds[c].gain, sheet.folds[c].x)):
            bad.append(c)
        if c not in sheet.cells:
            continue
        got = _reach(sheet.cells[c].spark, own)
        if got is None:
            bad.append(c)
            continue
        below = [found[t] for t in TOKEN.findall(sheet.cells[c].spark) if t in found and depth[t] == k]
        found[c] = tuple(got[i] + max((b[i] for b in below), default=0) for i in (0, 1))
        out[k] = tuple(max(a, b) for a, b in zip(out.get(k, (0, 0)), found[c]))
    if bad:
        raise NotSliceable(f"all bars of a symbol are needed at once for {len(bad)} columns, the first: {sheet.cells[bad[0]].spark if bad[0] in sheet.cells else 'a state machine or what reads one'}")
    return out, found


def _windows(sheet: Sheet, df: DataFrame, cells: list[str], rows: int, reach: tuple[int, int], found: dict[str, tuple[int, int]], scratch: Scratch) -> DataFrame:
    """``df`` with the cells of one pass; each slice gets copies of the ``back`` rows before it and the ``ahead`` rows behind."""
    if not any("OVER (" in sheet.cells[c].spark for c in cells):
        return _select(df, *(["*", *(f"{sheet.cells[c].spark} AS {c}" for c in cells if sheet.layers[c] == at)] for at in sorted({sheet.layers[c] for c in cells})))
    (back, ahead), slice_, place = reach, f"rn_ div {rows}", f"rn_ % {rows}"
    seen = f"array_compact(array({slice_}, CASE WHEN {place} >= {rows - back} THEN {slice_} + 1 END, CASE WHEN {place} < {ahead} AND rn_ >= {rows} THEN {slice_} - 1 END))"
    df = df.withColumn("slice_", F.explode(F.expr(seen))).repartition("key_", "slice_")
    own, now = f"PARTITION BY {sheet.key} ORDER BY {', '.join(sheet.order)}", "PARTITION BY key_, slice_ ORDER BY rn_"
    joined = False
    for at in sorted({sheet.layers[c] for c in cells}):
        texts = {c: sheet.cells[c].spark for c in cells if sheet.layers[c] == at}
        so_far = list(dict.fromkeys((m[1], m[2], m[3] or "") for t in texts.values() for m in SO_FAR.finditer(t)))
        if so_far and joined:  # the sums read all that is below them again
            df = scratch.cut(df, "so_far").repartition("key_", "slice_")
        joined |= bool(so_far)
        names = {item: f"before{i}_" for i, item in enumerate(so_far)}
        # The first copies of a slice lack what their own windows look back on: what is summed begins behind these. All rows
        # before that place go by the slice that begins there.
        begin = {(f, x, i): back - found.get(x, (0, 0))[0] for f, x, i in so_far}
        for start in sorted(set(begin.values())):
            items = [item for item in so_far if begin[item] == start]
            last = "max_by({x}, rn_) FILTER (WHERE {x} IS NOT NULL)"
            sums = [F.expr(last.format(x=x) if f == "last_value" else f"{f}({x})").alias(names[f, x, i]) for f, x, i in items]
            sums = df.where(f"{slice_} = slice_").groupBy("key_", F.expr(f"(rn_ + {start}) div {rows}").alias("slice_")).agg(*sums)
            frame = "OVER (PARTITION BY key_ ORDER BY slice_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
            carried = [F.expr(f"{'sum' if f == 'count' else f}({names[f, x, i]}){i} {frame}").alias(names[f, x, i]) for f, x, i in items]
            df = df.join(sums.select("key_", "slice_", *carried), ["key_", "slice_"], "left")

        def whole(m: re.Match) -> str:
            item = m[1], m[2], m[3] or ""
            x = f"CASE WHEN rn_ >= slice_ * {rows} - {begin[item]} THEN {m[2]} END"
            a = f"{m[1]}({x}){item[2]} OVER ({now} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
            return "(" + TOGETHER[m[1]].format(a=a, b=names[item]) + ")"

        texts = {c: SO_FAR.sub(whole, t) for c, t in texts.items()}
        df = _select(df, ["*", *(f"{t.replace(own, now)} AS {c}" for c, t in texts.items())])
        df = df.drop(*names.values())
    return df.where(f"{slice_} = slice_").drop("slice_")


# recursions -----------------------------------------------------------------------------------------------------------


def maps(gain: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keep, add) of y -> keep * y + add after each step of a recursion; where gain or x is missing, y stays."""
    n = len(x)
    if not n:
        return np.zeros(0), np.zeros(0)
    still = np.isnan(x) | np.isnan(gain)
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    keep, add = np.ones(rows * width), np.zeros(rows * width)
    keep[:n], add[:n] = np.where(still, 1.0, 1 - gain), np.where(still, 0.0, gain * x)
    keep, add = keep.reshape(rows, width), add.reshape(rows, width)
    for k in range(1, width):  # all blocks at once, each from its own beginning
        add[:, k] += keep[:, k] * add[:, k - 1]
        keep[:, k] *= keep[:, k - 1]
    for i in range(1, rows):
        add[i] += keep[i] * add[i - 1, -1]
        keep[i] *= keep[i - 1, -1]
    return keep.ravel()[:n], add.ravel()[:n]


def values(seed: np.ndarray, gain: np.ndarray, x: np.ndarray, y: float) -> np.ndarray:
    """The recursion over a stretch that begins with the state y (NaN: none yet)."""
    out, at = np.full(len(x), np.nan), 0
    if y != y:
        there = np.flatnonzero(~np.isnan(seed))
        if not len(there):
            return out
        at = int(there[0])
        y = out[at] = seed[at]
        at += 1
    keep, add = maps(gain[at:], x[at:])
    out[at:] = keep * y + add
    return out


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """(symbol and slice, whether it begins here, its rows) of sorted batches."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, at = (pc.dictionary_encode(batch.column(batch.schema.get_field_index(c))) for c in ("key_", "slice_"))
        code = np.stack([c.indices.to_numpy() for c in (key, at)])
        cuts = [0, *(np.flatnonzero((code[:, 1:] != code[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            now = key[a].as_py(), at[a].as_py()
            yield now, now != before, batch.slice(a, b - a)
            before = now


class Recursions:
    """The folds of one pass: by levels, and what they read."""

    def __init__(self, sheet: Sheet, folds: list[str]):
        self.folds = {c: sheet.folds[c] for c in folds}
        self.gates = {c: g for c, g in sheet.gates.items() if self._over_fold(sheet, c)}
        self.levels: dict[str, int] = {}
        for c in folds:
            self._level(c)
        self.columns = sorted({x for c in folds for x in self._plain(c)})

    def _over_fold(self, sheet: Sheet, c: str) -> bool:
        return c in sheet.gates and (sheet.gates[c][0] in self.folds or self._over_fold(sheet, sheet.gates[c][0]))

    def _read(self, c: str) -> list[str]:
        """Folds and plain columns that a fold or a gate reads at once."""
        f = self.folds.get(c)
        return [n for n in ((f.seed, f.gain, f.x) if f else self.gates[c]) if not CONSTANT.fullmatch(n)]

    def _plain(self, c: str) -> set[str]:
        return set().union(*(self._plain(n) if n in self.gates else set() if n in self.folds else {n} for n in self._read(c)))

    def _level(self, c: str) -> int:
        if c in self.folds and c in self.levels:
            return self.levels[c]
        f = self.folds.get(c)
        if f and (f.gain in self.folds or f.gain in self.gates):
            raise NotSliceable("a gain that is itself a recursion of the same pass")
        below = max((self._level(n) for n in self._read(c) if n in self.folds or n in self.gates), default=0)
        if f:
            self.levels[c] = below = below + 1
        return below

    def of(self, name: str, part: pa.RecordBatch, known: dict[str, np.ndarray]) -> np.ndarray:
        """A column, a gate or a constant over a stretch, as doubles."""
        if CONSTANT.fullmatch(name):
            return np.full(part.num_rows, float(CONSTANT.fullmatch(name)[1]))
        if name not in known:
            if name in self.gates:
                y, test = self.gates[name]
                known[name] = np.where(self.of(test, part, known) == 1, self.of(y, part, known), np.nan)
            else:
                column = part.column(part.schema.get_field_index(name))
                known[name] = pc.cast(column, pa.float64(), safe=False).to_numpy(zero_copy_only=False)
        return known[name]

    def over(self, level: int, rows: bool):
        """A task over sorted slices. rows: all folds up to ``level`` beside each row; else each slice's maps of that level."""
        names = [c for c in self.folds if self.levels[c] < level + rows]
        made = [c for c in self.folds if self.levels[c] == level] if not rows else []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state: dict[str, float] = {}
            found: dict[str, list] = {}
            last = None

            def told() -> pa.RecordBatch:
                cols = [pa.array([last[0]], pa.string()), pa.array([last[1]], pa.int64())]
                return pa.RecordBatch.from_arrays([*cols, *(pa.array([v], pa.float64(), from_pandas=True) for c in made for v in found[c])], names=["key_", "slice_", *(f"{k}_{c}" for c in made for k in ("keep", "add", "fresh"))])

            for now, new, part in stretches(batches):
                if new:
                    if last is not None and made:
                        yield told()
                    state = {c: float(self.of(f"start_{c}", part, {})[0]) for c in names}
                    found, last = {c: [1.0, 0.0, np.nan] for c in made}, now
                known: dict[str, np.ndarray] = {}
                for c in sorted(names, key=self.levels.get):
                    f = self.folds[c]
                    known[c] = values(self.of(f.seed, part, known), self.of(f.gain, part, known), self.of(f.x, part, known), state[c])
                    state[c] = float(known[c][-1])
                for c in made:
                    f = self.folds[c]
                    seed, gain, x = (self.of(n, part, known) for n in (f.seed, f.gain, f.x))
                    keep, add = maps(gain, x)
                    k, a, fresh = found[c]
                    fresh = values(seed, gain, x, fresh)[-1] if fresh != fresh else keep[-1] * fresh + add[-1]
                    found[c] = [float(k * keep[-1]), float(keep[-1] * a + add[-1]), float(fresh)]
                if rows:
                    kept = [i for i, n in enumerate(part.schema.names) if not n.startswith("start_")]
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *(pa.array(known[c], pa.float64(), from_pandas=True) for c in names)], names=[*(part.schema.names[i] for i in kept), *names])
            if made and last is not None:
                yield told()

        return run

    def scan(self, level: int):
        """The states that each slice of a symbol begins with, from the maps of all of them; a slice is one short row."""
        names = [c for c in self.folds if self.levels[c] == level]

        def run(slices: pa.Table) -> pa.Table:
            slices = slices.sort_by("slice_")
            out = {}
            for c in names:
                keep, add, fresh = (slices.column(f"{k}_{c}").to_numpy() for k in ("keep", "add", "fresh"))
                y, begin = np.nan, np.empty(len(keep))
                for i in range(len(keep)):
                    begin[i] = y
                    y = fresh[i] if y != y else keep[i] * y + add[i]
                out[f"start_{c}"] = pa.array(begin, pa.float64(), from_pandas=True)
            return pa.table({"key_": slices.column("key_"), "slice_": slices.column("slice_")} | out)

        return run, "key_ string, slice_ bigint, " + ", ".join(f"start_{c} double" for c in names)


def _bounded(sheet: Sheet, df: DataFrame, made: list[str], rows: int) -> DataFrame:
    """``df`` with the outputs of machines that look back so many rows: each slice begins anew with copies of these."""
    machines = [m for m in sheet.machines if set(m.outputs) & set(made)]
    gates = {c for m in machines for c in m.inputs if c in sheet.gates and c not in df.columns}
    df = _select(df, ["*", *(f"{sheet.cells[c].spark} AS {c}" for c in sorted(gates))]) if gates else df
    back = max(m.reach for m in machines)
    place, now = f"rn_ % {rows}", f"rn_ div {rows}"
    seen = f"array_compact(array({now}, CASE WHEN {place} >= {rows - back} THEN {now} + 1 END))"
    kept = [c for c in df.columns if c not in gates]
    kinds = dict(df.dtypes)
    df = df.withColumn("slice_", F.explode(F.expr(seen))).repartition("key_", "slice_").sortWithinPartitions("key_", "slice_", "rn_")
    outputs = [o for m in machines for o in m.outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps: list = []
        for _, new, part in stretches(batches):
            if new:
                steps = [m.make() for m in machines]
            lists = [part.column(part.schema.get_field_index(c)) for m in machines for c in m.inputs]
            lists = iter([c.to_pylist() for c in lists])
            got = [pa.array(o, pa.float64()) for m, step in zip(machines, steps) for o in step(*(next(lists) for _ in m.inputs))]
            own = pc.equal(pc.divide(part.column(part.schema.get_field_index("rn_")), rows), part.column(part.schema.get_field_index("slice_")))
            cols = [part.column(part.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, *got], names=[*kept, *outputs]).filter(own)

    return df.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *(f"`{c}` double" for c in outputs)]))


def _folds(sheet: Sheet, df: DataFrame, folds: list[str], rows: int, scratch: Scratch) -> DataFrame:
    """``df`` with all recursions of one pass."""
    work = Recursions(sheet, folds)
    df = df.withColumn("slice_", F.expr(f"rn_ div {rows}"))
    narrow, starts = df.select("key_", "slice_", "rn_", *work.columns), None

    def slices_of(rows_: DataFrame) -> DataFrame:
        rows_ = rows_.repartition("key_", "slice_")
        return (rows_.join(starts, ["key_", "slice_"]) if starts is not None else rows_).sortWithinPartitions("key_", "slice_", "rn_")

    for level in range(1, max(work.levels.values()) + 1):
        made = [c for c in folds if work.levels[c] == level]
        schema = "key_ string, slice_ bigint, " + ", ".join(f"{k}_{c} double" for c in made for k in ("keep", "add", "fresh"))
        run, kinds = work.scan(level)
        got = slices_of(narrow).mapInArrow(work.over(level, rows=False), schema).groupBy("key_").applyInArrow(run, kinds)
        starts = scratch.cut(got if starts is None else starts.join(got, ["key_", "slice_"]), f"starts{level}")
    whole = slices_of(df)
    kept = [f"`{c}` {k}" for c, k in whole.dtypes if not c.startswith("start_")]
    return whole.mapInArrow(work.over(max(work.levels.values()), rows=True), ", ".join([*kept, *(f"`{c}` double" for c in work.folds)])).drop("slice_")


def can_slice(sheet: Sheet, outputs: dict[str, str]) -> bool:
    depth = sheet._depths(sheet.needed([sheet.put(e) for e in outputs.values()]))
    try:
        reaches(sheet, depth)
        for k in set(depth.values()):
            Recursions(sheet, [c for c in depth if depth[c] == k and c in sheet.folds])
    except NotSliceable:
        return False
    return True


def sliced(sheet: Sheet, bars: DataFrame, outputs: dict[str, str], digits: int | None = None, rows: int = ROWS) -> DataFrame:
    """``Sheet.spark`` with slices of ``rows`` bars (or as many as the longest window takes) as the unit of work.

    Null symbols are one symbol, equal bars keep one order from the first table on, an empty table gives no rows. Columns of
    ``bars`` pass through. Raises ``NotSliceable`` for columns that can't be had from slices.
    """
    out = {name: sheet.put(e) for name, e in outputs.items()}
    depth = sheet._depths(sheet.needed(list(out.values())))
    last, here = sheet._last_use(depth, list(out.values())), list(bars.columns)
    reach, found = reaches(sheet, depth)
    backs = [m.reach for m in sheet.machines if m.reach and set(m.outputs) & depth.keys()]
    rows = max(rows, 1, *backs, *(n for pair in reach.values() for n in pair))
    scratch = Scratch(bars.sparkSession, "slices")
    df = ranked(bars, sheet, scratch)
    for k in range(max(depth.values(), default=0) + 1):
        folds = [c for c in depth if depth[c] == k and c in sheet.folds]
        made_by = {c: m for m in sheet.machines for c in m.outputs}
        machines = [c for c in depth if depth[c] == k and c in made_by]
        if folds:
            later = [c for c in df.columns if c in here or c in ("key_", "rn_") or last.get(c, -1) >= 2 * k - 1]
            df = _folds(sheet, scratch.cut(df.select(*(f"`{c}`" for c in later)), f"pass{k}"), folds, rows, scratch)
        if machines:
            df = _bounded(sheet, df, machines, rows)
        cells = [c for c in depth if c in sheet.cells and depth[c] == k]
        if (folds or machines) and any(SO_FAR.search(sheet.cells[c].spark) for c in cells):
            df = scratch.cut(df, f"folded{k}")  # what follows reads it more than once
        df = _windows(sheet, df, cells, rows, reach.get(k, (0, 0)), found, scratch) if cells else df
    kinds = dict(df.dtypes)
    return _select(df, [*(f"`{c}`" for c in here), *(f"{_shown(c, kinds[c], digits)} AS `{name}`" for name, c in out.items())])

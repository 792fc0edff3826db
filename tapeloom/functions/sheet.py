"""Column sheets: layered SQL expressions over bars, for Spark and for any SQL engine.

An indicator is written once as SQL expressions over named columns. ``Sheet.put`` gives an expression a name and a layer:
one more than the highest layer it reads, so an expression over a window result lands in a later projection and Catalyst
sees one chain of windows over one partitioning and sort. Equal expressions share one column. Recursions are folds and state
machines, which run in passes over the sorted bars, a few numbers of state per symbol, in Arrow batches. Folds and machines
that read each other run in one pass; a pass more is needed only where an expression stands between two recursions.

Missing values are NULL. A rolling value needs a full window unless ``least`` says otherwise. Bars of one symbol and time are
ordered by their prices and volume, so all windows and recursions see them in one order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tapeloom.functions import ordered

NAME = re.compile(r"[A-Za-z_]\w*\Z")
#: added before rounding, so that values with few decimals don't lie on a tie, where the last bit would decide
SHIFT = 1.37e-6
#: beyond this, in which a double has few decimals left, values are rounded to whole numbers
LARGE = "1e8"
TOKEN = re.compile(r"'(?:[^']|'')*'|[A-Za-z_]\w*")
CONSTANT = re.compile(r"cast\(([-+.\de]+) AS double\)")
#: values of a stretch from which on a fold is computed in blocks
LONG = 4096
#: rows that machines with a look ahead take at once, at least
CHUNK = 4096

NUMBER = re.compile(r"'(?:[^']|'')*'|(?<![\w.])\d+\.\d+(?![\w.])")


def doubles(text: str) -> str:
    """Decimal literals as doubles, in a form that both dialects take: 6.0 would divide as a decimal."""
    return NUMBER.sub(lambda m: m[0] if m[0][0] == "'" else f"{m[0]}e0", text)


@dataclass
class Cell:
    layer: int
    spark: str
    duck: str


@dataclass
class Fold:
    """y = seed while there is no y; y stays where x or gain is missing; else y += gain * (x - y)."""

    layer: int
    seed: str
    gain: str
    x: str


@dataclass
class Machine:
    """A state machine over the rows of a symbol: ``make()`` gives a function from input lists to output lists.

    It is called with consecutive stretches of a symbol's rows and keeps what it needs between calls. ``sql``: the same for
    DuckDB, a function of (sheet, table, inputs, outputs) that gives a SELECT of the table with the outputs.
    """

    layer: int
    make: Callable
    inputs: list[str]
    outputs: list[str]
    whole: bool = False  # needs all rows of a symbol at once
    sql: Callable | None = None
    reach: int | None = None  # its outputs follow from so many rows before a row; None: from all
    ahead: int = 0  # ... and from so many behind it, for which the row waits


class Delayed:
    """Machines that look ahead, over batches of one symbol: a row comes out once the rows that it waits for are there.

    Held are the rows that wait, and of those that are out as many as the machines look back on; each run of the machines
    begins anew on them.
    """

    def __init__(self, machines: list[Machine], names: list[list[str]], chunk: int):
        self.machines, self.names, self.chunk = machines, names, chunk
        self.back, self.ahead = max(m.reach for m in machines), max(m.ahead for m in machines)
        self.held: list[pa.RecordBatch] = []
        self.size = self.out = 0  # rows held, and how many of them are out

    def push(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.held.append(batch)
        self.size += batch.num_rows
        if self.size - self.out >= self.chunk + self.ahead:
            yield self.run(self.size - self.ahead)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.size > self.out:
            yield self.run(self.size)

    def run(self, until: int) -> pa.RecordBatch:
        """The rows held up to ``until`` that aren't out yet, with the machines' outputs."""
        rows = pa.Table.from_batches(self.held).combine_chunks().to_batches()[0]
        got: dict[str, pa.Array] = {}
        for m, inputs in zip(self.machines, self.names):
            for o, values in zip(m.outputs, m.make()(*(rows.column(rows.schema.get_field_index(c)).to_pylist() for c in inputs))):
                got[o] = pa.array([None if v is None or v != v else float(v) for v in values], pa.float64())
        done = pa.RecordBatch.from_arrays([*rows.columns, *got.values()], names=[*rows.schema.names, *got]).slice(self.out, until - self.out)
        first = max(0, until - self.back)
        self.held, self.out, self.size = [rows.slice(first)], until - first, rows.num_rows - first
        return done


@dataclass
class Sheet:
    columns: dict[str, str]
    key: str = "symbol"
    time: str = "ts"
    cells: dict[str, Cell] = field(default_factory=dict)
    folds: dict[str, Fold] = field(default_factory=dict)
    machines: list[Machine] = field(default_factory=list)
    gates: dict[str, tuple[str, str]] = field(default_factory=dict)
    names: dict[tuple, str] = field(default_factory=dict)
    made: int = 0

    def layer(self, text: str) -> int:
        found = {t for t in TOKEN.findall(text) if t[0] != "'"}
        return max((self.layers[t] for t in found & self.layers.keys()), default=0)

    @property
    def layers(self) -> dict[str, int]:
        if not hasattr(self, "_layers"):
            self._layers = {}
        return self._layers

    def _name(self) -> str:
        self.made += 1
        return f"c{self.made}_"

    def put(self, spark: str, duck: str | None = None) -> str:
        """The name of a column with this expression (``duck``: its form for DuckDB, where it differs)."""
        if NAME.match(spark) and (spark in self.layers or spark in self.columns):
            return spark
        spark, duck = doubles(spark), duck and doubles(duck)
        known = self.names.get((spark, duck))
        if known is None:
            known = self.names[spark, duck] = self._name()
            self.cells[known] = Cell(max(self.layer(spark), self.layer(duck or "")) + 1, spark, duck or spark)
            self.layers[known] = self.cells[known].layer
        return known

    def fold(self, seed: str, gain: str, x: str) -> str:
        seed, x = self.put(seed), self.put(x)
        gain = gain if CONSTANT.fullmatch(gain) else self.put(gain)
        known = self.names.get(("fold", seed, gain, x))
        if known is None:
            known = self.names["fold", seed, gain, x] = self._name()
            self.folds[known] = Fold(max(self.layers.get(c, 0) for c in (seed, gain, x)) + 1, seed, gain, x)
            self.layers[known] = self.folds[known].layer
        return known

    def gate(self, y: str, test: str) -> str:
        """y where ``test`` holds. Folds can read it in the pass in which the fold y is made."""
        y, test = self.put(y), self.put(test)
        out = self.put(f"CASE WHEN {test} THEN {y} END")
        if y in self.folds or y in self.gates:
            self.gates[out] = y, test
        return out

    def machine(self, make: Callable, inputs: list[str], outputs: list[str], tag: tuple, whole: bool = False, sql: Callable | None = None, reach: int | None = None, ahead: int = 0) -> dict[str, str]:
        known = self.names.get(("machine", *tag))
        if known is None:
            inputs = [self.put(i) for i in inputs]
            layer = max(self.layers.get(c, 0) for c in inputs) + 1
            known = {o: self._name() for o in outputs}
            self.machines.append(Machine(layer, make, inputs, list(known.values()), whole, sql, reach, ahead))
            for c in known.values():
                self.layers[c] = layer
            self.names["machine", *tag] = known
        return known

    # windows ------------------------------------------------------------------------------------------------------

    def over(self, frame: str = "", by: str = "") -> str:
        return f"OVER (PARTITION BY {self.key}{', ' + by if by else ''} ORDER BY {', '.join(self.order)}{' ' + frame if frame else ''})"

    @property
    def order(self) -> list[str]:
        """Time, and what tells bars of one time apart."""
        return [self.time, *(c for c in ("open", "high", "low", "close", "volume") if c in self.columns)]

    def rows(self, n: int, end: int = 0) -> str:
        """The n rows that end ``end`` rows before this one."""
        stop = "CURRENT ROW" if end == 0 else f"{end} PRECEDING" if end > 0 else f"{-end} FOLLOWING"
        first = n - 1 + end
        begin = f"{first} PRECEDING" if first > 0 else "CURRENT ROW" if first == 0 else f"{-first} FOLLOWING"
        return self.over(f"ROWS BETWEEN {begin} AND {stop}")

    @property
    def past(self) -> str:
        return self.over("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")

    @property
    def whole(self) -> str:
        return f"OVER (PARTITION BY {self.key})"

    def lag(self, x: str, k: int = 1) -> str:
        if k == 0:
            return self.put(x)
        return self.put(f"{'lag' if k > 0 else 'lead'}({self.put(x)}, {abs(k)}) {self.over()}")

    def roll(self, f: str, x: str, n: int, least: int | None = None, end: int = 0) -> str:
        x, w = self.put(x), self.rows(n, end)
        return self.put(f"CASE WHEN count({x}) {w} >= {n if least is None else least} THEN {f}({x}) {w} END")

    def roll2(self, f: str, y: str, x: str, n: int) -> str:
        y, x = self.put(y), self.put(x)
        both = self.put(f"CASE WHEN {y} IS NOT NULL AND {x} IS NOT NULL THEN 1 END")
        w = self.rows(n)
        return self.put(f"CASE WHEN count({both}) {w} >= {n} THEN {f}({y}, {x}) {w} END")

    def cum(self, f: str, x: str, by: str = "") -> str:
        return self.put(f"{f}({self.put(x)}) {self.over('ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW', self.put(by) if by else '')}")

    def all(self, f: str, x: str) -> str:
        return self.put(f"{f}({self.put(x)}) {self.whole}")

    def ffill(self, x: str) -> str:
        x = self.put(x)
        return self.put(f"last_value({x}) IGNORE NULLS {self.past}", f"last_value({x} IGNORE NULLS) {self.past}")

    def bfill(self, x: str) -> str:
        x, w = self.put(x), self.over("ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING")
        return self.put(f"first_value({x}) IGNORE NULLS {w}", f"first_value({x} IGNORE NULLS) {w}")

    def ordered(self, x: str, n: int, *measures: tuple) -> list[str]:
        """Order statistics of the last n values (``ordered.window``), in one pass with the recursions."""
        outputs = ["_".join(map(str, m)) for m in measures]
        got = self.machine(ordered.window(n, measures), [self.put(x)], outputs, ("ordered", self.put(x), n, *measures), reach=n - 1)
        return [got[o] for o in outputs]

    def quantile(self, x: str, q: float, n: int) -> str:
        x, w = self.put(x), self.rows(n)
        full = f"CASE WHEN count({x}) {w} >= {n} THEN"
        if n >= ordered.LONG_WINDOW:
            return self.put(f"({self.ordered(x, n, ('quantile', q))[0]})", f"{full} quantile_cont({x}, {q}) {w} END")
        return self.put(f"{full} percentile({x}, {q}) {w} END", f"{full} quantile_cont({x}, {q}) {w} END")

    def ranked(self, x: str, n: int) -> tuple[str, str]:
        """How many of the last n values are less than the last one, and how many equal it."""
        x = self.put(x)
        w = f"{self.rows(n)}"
        held = f"CASE WHEN count({x}) {w} >= {n} THEN list({x}) {w} END"
        tests = [f"CASE WHEN {{a}} IS NOT NULL THEN len(list_filter({{a}}, lambda v: v {sign} {x})) END" for sign in ("<", "=")]
        if n < ordered.LONG_WINDOW:
            a = self.values(x, n)
            return self.count_if(a, f"v < {x}"), self.count_if(a, f"v = {x}")
        below, same = self.ordered(x, n, ("below",), ("same",))
        a = self.put("NULL", held)
        return self.put(f"({below})", tests[0].format(a=a)), self.put(f"({same})", tests[1].format(a=a))

    def all_quantile(self, x: str, q: float) -> str:
        x = self.put(x)
        return self.put(f"percentile({x}, {q}) {self.whole}", f"quantile_cont({x}, {q}) {self.whole}")

    def values(self, x: str, n: int, end: int = 0) -> str:
        """Array of the values of a full window that aren't missing, oldest first; else NULL."""
        x, w = self.put(x), self.rows(n, end)
        return self.put(f"CASE WHEN count({x}) {w} >= {n} THEN collect_list({x}) {w} END", f"CASE WHEN count({x}) {w} >= {n} THEN list({x}) {w} END")

    def count_if(self, array: str, test: str, v: str = "v") -> str:
        """How many elements v of an array column fulfil ``test``."""
        return self.put(
            f"CASE WHEN {array} IS NOT NULL THEN size(filter({array}, {v} -> {test})) END",
            f"CASE WHEN {array} IS NOT NULL THEN len(list_filter({array}, lambda {v}: {test})) END",
        )

    def mean_of(self, array: str, form: str, n: int, v: str = "v") -> str:
        """Sum of ``form`` over the elements v of an array column, divided by n."""
        return self.put(
            f"aggregate(transform({array}, {v} -> {form}), cast(0 AS double), (s, t) -> s + t) / {n}", f"list_sum(list_transform({array}, lambda {v}: {form})) / {n}"
        )

    @staticmethod
    def div(a: str, b: str, default: str = "NULL") -> str:
        """a / b, or ``default`` where b is zero or either is missing."""
        quotient = f"(({a}) / nullif({b}, 0))"
        return quotient if default == "NULL" else f"coalesce({quotient}, {default})"

    @staticmethod
    def flag(test: str) -> str:
        return f"coalesce({test}, false)"

    # rendering ----------------------------------------------------------------------------------------------------

    def needed(self, wanted: list[str], duck: bool = False) -> set[str]:
        """``wanted`` and all columns below them."""
        made_by = {c: m for m in self.machines for c in m.outputs}
        todo, found = list(wanted), set()
        while todo:
            c = todo.pop()
            if c in found or c in self.columns:
                continue
            found.add(c)
            if c in self.cells:
                todo += [t for t in TOKEN.findall(self.cells[c].duck if duck else self.cells[c].spark) if t in self.layers]
            elif c in self.folds:
                f = self.folds[c]
                todo += [x for x in (f.seed, f.gain, f.x) if x in self.layers]
            elif c in made_by:
                todo += [x for x in (*made_by[c].inputs, *made_by[c].outputs) if x in self.layers]
        return found

    def spark(self, bars: DataFrame, outputs: dict[str, str], digits: int | None = None) -> DataFrame:
        """``bars`` with the columns ``outputs`` (name -> column of the sheet or expression over such)."""
        out = {name: self.put(e) for name, e in outputs.items()}
        depth = self._depths(self.needed(list(out.values())))
        last, here = self._last_use(depth, list(out.values())), list(bars.columns)
        df, deepest = bars, max(depth.values(), default=0)
        if any(c in self.folds or c not in self.cells for c in depth):
            # windows before the first pass and the pass itself stand on this one; a number keeps few bars with much to
            # compute from being drawn into one task
            df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(self.key))
        for k in range(deepest + 1):
            if k:
                df = self._pass(df, [c for c in depth if depth[c] == k], here, {c for c, n in last.items() if n >= 2 * k})
            cells = [c for c in depth if c in self.cells and depth[c] == k]
            df = _select(df, *(["*", *(f"{self.cells[c].spark} AS {c}" for c in cells if self.layers[c] == layer)] for layer in sorted({self.layers[c] for c in cells})))
        kinds = dict(df.dtypes)
        return _select(df, [*(f"`{c}`" for c in here), *(f"{_shown(c, kinds[c], digits)} AS `{name}`" for name, c in out.items())])

    def _depths(self, needed: set[str]) -> dict[str, int]:
        """For each column, in an order in which they can be made, the number of the pass that makes it or after which it is
        made (0: before the first one)."""
        made_by = {c: m for m in self.machines for c in m.outputs}
        out: dict[str, int] = {}

        def at(c: str) -> int:
            """The first pass that can read c: that which makes it, if a recursion or a gate over one does."""
            if c in self.folds or c in made_by:
                return out[c]
            if c in self.gates:
                y, test = self.gates[c]
                return max(at(y), out.get(test, 0) + 1)
            return out.get(c, 0) + 1

        for c in sorted(needed, key=lambda c: (self.layers[c], c)):
            if c in self.cells:
                out[c] = max((out[t] for t in TOKEN.findall(self.cells[c].spark) if t in needed), default=0)
            elif c in self.folds:
                f = self.folds[c]
                out[c] = max(at(x) for x in (f.seed, f.gain, f.x) if not CONSTANT.fullmatch(x))
            else:
                out[c] = max((at(x) for x in made_by[c].inputs), default=1)
        return out

    def _last_use(self, depth: dict[str, int], outputs: list[str]) -> dict[str, int]:
        """Where each column is read last: 2 * k by expressions after pass k, 2 * k - 1 by pass k itself."""
        out: dict[str, int] = dict.fromkeys(outputs, 10**9)

        def read(names, at: int) -> None:
            for n in names:
                out[n] = max(out.get(n, 0), at)
                if n in self.gates and at % 2:  # a pass makes a gate of its own folds from what the gate reads
                    read(self.gates[n], at)

        for c, k in depth.items():
            if c in self.cells:
                read((t for t in TOKEN.findall(self.cells[c].spark) if t in depth), 2 * k)
            elif c in self.folds:
                read((self.folds[c].seed, self.folds[c].gain, self.folds[c].x), 2 * k - 1)
        for m in self.machines:
            if m.outputs[0] in depth or set(m.outputs) & depth.keys():
                read(m.inputs, 2 * max(depth[o] for o in m.outputs if o in depth) - 1)
        return out

    def _pass(self, df: DataFrame, made: list[str], here: list[str], later: set[str]) -> DataFrame:
        """All recursions among the columns ``made``, in one run over the sorted bars; what ``later`` doesn't name is dropped."""
        machines = [m for m in self.machines if set(m.outputs) & set(made)]
        own = {o: m for m in machines for o in m.outputs}
        todo = list(dict.fromkeys(c if c in self.folds else tuple(own[c].outputs) for c in made if c in self.folds or c in own))
        folds = {c: (f.seed, float(CONSTANT.fullmatch(f.gain)[1]) if CONSTANT.fullmatch(f.gain) else f.gain, f.x) for c, f in self.folds.items() if c in made}
        steps: list[tuple[str, object]] = [("fold", c) if isinstance(c, str) else ("machine", next((m.make, m.inputs, m.outputs, m.whole) for m in machines if tuple(m.outputs) == c)) for c in todo]
        made_here = {c for c in todo if isinstance(c, str)} | own.keys()

        def gated(c: str) -> bool:
            """A gate over something that this pass makes."""
            return c in self.gates and (self.gates[c][0] in made_here or gated(self.gates[c][0]))

        gates = {c: g for c, g in self.gates.items() if gated(c)}
        read: set[str] = set()

        def reads(c) -> None:
            if isinstance(c, float) or c in made_here:
                return
            if c in gates:
                for x in gates[c]:
                    reads(x)
            else:
                read.add(c)

        for c in [x for c in folds for x in folds[c]] + [x for m in machines for x in m.inputs]:
            reads(c)
        there = df.columns
        taken = [c for c in there if c in here or c in read or c in later]
        kept = [c for c in taken if c in here or c in later]
        new = [c for c in made_here if c in later]
        df = _select(df, [f"`{c}`" for c in taken]) if len(taken) < len(there) else df
        df = df.sortWithinPartitions(self.key, *self.order)
        kinds = dict(df.dtypes)
        schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *(f"`{c}` double" for c in new)])
        any_whole, key = any(m.whole for m in machines), self.key
        # what waits for rows to come is made last, so nothing of the same pass may read it
        read_here = {x for c in folds for x in folds[c] if isinstance(x, str)} | {x for m in machines for x in m.inputs}
        read_here |= {x for c in read_here for x in self.gates.get(c, ())}
        late = [m for m in machines if m.ahead and not read_here & set(m.outputs)]
        any_whole |= any(m.ahead and m not in late for m in machines)
        last_made = [o for m in late for o in m.outputs]
        steps = [x for x in steps if x[0] == "fold" or not set(x[1][2]) & set(last_made)]
        passed = list(dict.fromkeys(c for m in late for c in m.inputs))
        inputs, chunk = [[f"for late {c}" for c in m.inputs] for m in late], CHUNK

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, state, parts, waiting = None, None, [], None

            def emitted(done: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                return shown(waiting.push(done)) if waiting else iter([done])

            def work(part: pa.RecordBatch) -> pa.RecordBatch:
                lists: dict[str, list] = {}

                def of(c: str) -> list:
                    if c not in lists:
                        if c in gates:
                            y, test = gates[c]
                            lists[c] = [v if t else None for v, t in zip(of(y), of(test))]
                        else:
                            lists[c] = part.column(part.schema.get_field_index(c)).to_pylist()
                    return lists[c]

                for i, (kind, what) in enumerate(steps):
                    if kind == "fold":
                        seed, gain, x = folds[what]
                        xs = of(x)
                        gains = gain if isinstance(gain, float) else of(gain)
                        lists[what], state[i] = folded(xs if seed == x else of(seed), gains, xs, state[i])
                    else:
                        for c, got in zip(what[2], state[i](*(of(c) for c in what[1]))):
                            lists[c] = [None if v is None or v != v else float(v) for v in got]
                cols = [part.column(part.schema.get_field_index(c)) for c in kept]
                early = [c for c in new if c not in last_made]
                there = part.schema.names
                more = [part.column(there.index(c)) if c in there and c not in made_here else pa.array(of(c), pa.float64()) for c in passed]
                return pa.RecordBatch.from_arrays([*cols, *(pa.array(lists[c], pa.float64()) for c in early), *more], names=[*kept, *early, *(f"for late {c}" for c in passed)])

            def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in (*kept, *new)], names=[*kept, *new])

            def joined() -> pa.RecordBatch:
                return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
                cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
                for a, b in zip(cuts, cuts[1:]):
                    if state is None or keys[a] != now:
                        if parts:
                            yield from emitted(work(joined()))
                            parts = []
                        if waiting:
                            yield from shown(waiting.rest())
                        waiting = Delayed(late, inputs, chunk) if late else None
                        now, state = keys[a], [None if kind == "fold" else what[0]() for kind, what in steps]
                    if any_whole:
                        parts.append(batch.slice(a, b - a))
                    else:
                        yield from emitted(work(batch.slice(a, b - a)))
            if parts:
                yield from emitted(work(joined()))
            if waiting:
                yield from shown(waiting.rest())

        return df.mapInArrow(run, schema)

    def duck(self, source: str, outputs: dict[str, str], digits: int | None = None) -> str:
        """DuckDB SQL for the same table, over the SQL ``source`` of the bars."""
        out = {name: self.put(e) for name, e in outputs.items()}
        needed = self.needed(list(out.values()), duck=True)
        steps, last = [f"l0 AS MATERIALIZED (SELECT *, row_number() {self.over()} AS rn_ FROM ({source}))"], "l0"
        for k in range(1, max((self.layers[c] for c in needed), default=0) + 1):
            cells = {c: self.cells[c].duck for c in needed if c in self.cells and self.layers[c] == k}
            if cells:
                steps.append(f"l{k} AS MATERIALIZED (SELECT *, {', '.join(f'{e} AS {c}' for c, e in cells.items())} FROM {last})")
                last = f"l{k}"
            folds = {c: self.folds[c] for c in needed if c in self.folds and self.layers[c] == k}
            if folds:
                gain = lambda f: doubles(f.gain) if CONSTANT.fullmatch(f.gain) else f"t.{f.gain}"
                first = ", ".join(f"t.{f.seed}::DOUBLE AS {c}" for c, f in folds.items())
                more = ", ".join(f"CASE WHEN r.{c} IS NULL THEN t.{f.seed} WHEN t.{f.x} IS NULL OR {gain(f)} IS NULL THEN r.{c} ELSE r.{c} + {gain(f)} * (t.{f.x} - r.{c}) END" for c, f in folds.items())
                steps.append(f"f{k}({self.key}, rn_, {', '.join(folds)}) AS (SELECT t.{self.key}, t.rn_, {first} FROM {last} t WHERE rn_ = 1 UNION ALL SELECT t.{self.key}, t.rn_, {more} FROM f{k} r JOIN {last} t ON t.{self.key} = r.{self.key} AND t.rn_ = r.rn_ + 1)")
                steps.append(f"g{k} AS MATERIALIZED (SELECT t.*, {', '.join(f'f.{c}' for c in folds)} FROM {last} t JOIN f{k} f ON t.{self.key} = f.{self.key} AND t.rn_ = f.rn_)")
                last = f"g{k}"
            for i, m in enumerate(m for m in self.machines if m.layer == k and needed & set(m.outputs)):
                if m.sql is None:
                    raise ValueError("a state machine without an SQL form")
                steps.append(f"m{k}_{i} AS MATERIALIZED ({m.sql(self, last, m.inputs, m.outputs)})")
                last = f"m{k}_{i}"
        shown = [*self.columns, *(f"{_duck_shown(c, self.kind(c), digits)} AS {name}" for name, c in out.items())]
        return f"WITH RECURSIVE {', '.join(steps)} SELECT {', '.join(shown)} FROM {last}"

    def recursion(self, table: str, state: dict[str, str], layers: list[dict[str, str]], outputs: dict[str, str]) -> str:
        """A SELECT of ``table`` with ``outputs`` (name -> expression over the state after a row), one row after another.

        state: name -> its value before the first row. layers: expressions, each over the columns of ``t`` (the row), ``r``
        (the state before it) and the layers before; a name of the state in a layer's last mention is its next value.
        """
        inner = f"SELECT t.*, {', '.join(f'r.{c} AS r_{c}' for c in state)} FROM walk r JOIN {table} t ON t.{self.key} = r.{self.key} AND t.rn_ = r.rn_ + 1"
        for one in layers:
            inner = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in one.items())} FROM ({inner})"
        first = f"SELECT DISTINCT {self.key}, 0::BIGINT AS rn_, {', '.join(f'{v} AS {c}' for c, v in state.items())}, {', '.join(f'NULL::DOUBLE AS {c}' for c in outputs)} FROM {table}"
        step = f"SELECT {self.key}, rn_, {', '.join(f'n_{c}' for c in state)}, {', '.join(f'({e})::DOUBLE' for e in outputs.values())} FROM ({inner})"
        names = ", ".join([self.key, "rn_", *state, *outputs])
        shown = ", ".join(f"w.{c}" for c in outputs)
        return f"WITH RECURSIVE walk({names}) AS ({first} UNION ALL {step}) SELECT t.*, {shown} FROM {table} t JOIN walk w ON t.{self.key} = w.{self.key} AND t.rn_ = w.rn_"

    def kind(self, c: str) -> str:
        """double unless an expression is marked as something else."""
        return self.kinds.get(c, self.columns.get(c, "double"))

    @property
    def kinds(self) -> dict[str, str]:
        if not hasattr(self, "_kinds"):
            self._kinds = {}
        return self._kinds

    def mark(self, c: str, kind: str) -> str:
        c = self.put(c)
        self.kinds[c] = kind
        return c


def _select(df: DataFrame, *layers: list[str]) -> DataFrame:
    """SELECTs over each other as one text: wide tables are told to the engine in one call."""
    text = "{rows_}"
    for columns in layers:
        text = f"(SELECT {', '.join(columns)} FROM {text})"
    return df.sparkSession.sql(text[1:-1], rows_=df) if layers else df


def _shown(c: str, kind: str, digits: int | None) -> str:
    if digits is None or kind not in ("double", "int", "bigint") and not kind.startswith("decimal"):
        return c
    x = f"cast({c} AS double)"
    return f"CASE WHEN abs({x}) >= {LARGE} THEN round({x}, 0) ELSE round({x} + {SHIFT!r}D, {digits}) END + 0.0D"


def folded(seed: list, gain: float | list, x: list, y: float | None) -> tuple[list, float | None]:
    """The values of a fold over a stretch that begins with the state y, and the state after it."""
    if len(x) >= LONG:
        return _folded_in_blocks(seed, gain, x, y)
    out = []
    if isinstance(gain, float):
        for s, v in zip(seed, x):
            if y is None:
                y = s
            elif v is not None:
                y += gain * (v - y)
            out.append(y)
    else:
        for s, g, v in zip(seed, gain, x):
            if y is None:
                y = s
            elif v is not None and g is not None:
                y += g * (v - y)
            out.append(y)
    return out, y


def _folded_in_blocks(seed: list, gain: float | list, x: list, y: float | None) -> tuple[list, float | None]:
    """The same for a long stretch. A step is y -> (1 - g) * y + g * x, and steps compose: all blocks of the stretch are walked
    at once, each from its own beginning, and the states at the blocks' beginnings follow from the composed steps."""
    n, begin = len(x), 0
    if y is None:
        begin = next((i for i, s in enumerate(seed) if s is not None), n)
        if begin == n:
            return [None] * n, None
        y = seed[begin]
        begin += 1
    v = np.array([np.nan if a is None else a for a in x[begin:]], np.float64)
    g = np.full(len(v), gain) if isinstance(gain, float) else np.array([np.nan if a is None else a for a in gain[begin:]], np.float64)
    still = np.isnan(v) | np.isnan(g)
    width = max(1, int(np.sqrt(len(v))))
    rows = -(-len(v) // width) if len(v) else 0
    keep, add = np.ones(rows * width), np.zeros(rows * width)
    keep[: len(v)], add[: len(v)] = np.where(still, 1.0, 1 - g), np.where(still, 0.0, g * v)
    keep, add = keep.reshape(rows, width), add.reshape(rows, width)
    for k in range(1, width):
        add[:, k] += keep[:, k] * add[:, k - 1]
        keep[:, k] *= keep[:, k - 1]
    at = np.empty(rows)
    for i in range(rows):
        at[i] = y
        y = float(keep[i, -1] * y + add[i, -1])
    made = (keep * at[:, None] + add).ravel()[: len(v)].tolist()
    head = [] if begin == 0 else [None] * (begin - 1) + [seed[begin - 1]]
    return head + made, made[-1] if made else (y if not head else head[-1])


def _duck_shown(c: str, kind: str, digits: int | None) -> str:
    if digits is None or kind in ("boolean", "string"):
        return c
    return f"CASE WHEN abs({c}::DOUBLE) >= {LARGE} THEN round({c}::DOUBLE, 0) ELSE round({c}::DOUBLE + {SHIFT!r}, {digits}) END + 0.0"


def plain(*columns: list) -> list[list[float]]:
    """Columns with NaN for what is missing: every comparison with it is false."""
    return [[np.nan if v is None else v for v in c] for c in columns]


def numbers(values: list) -> np.ndarray:
    """A list with missing values as a float array."""
    return np.array([np.nan if v is None else v for v in values], np.float64)

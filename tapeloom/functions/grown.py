"""Recursions over bars that tasks make of shorter rows, in time slices of a symbol: the rows are shuffled, the bars never.

Where one row stands for many bars, the bars are too many to be written or dealt, however narrow. What is known of them without
making them is where they lie: a row's bars begin at its time and end ``reach`` seconds later. So

1. rows are counted by symbol and cell of time, and runs of cells with about ``slice_rows`` bars are a slice; a row goes to each
   slice that its bars touch (mostly one);
2. a task makes the bars of a slice, drops those outside it, sorts them, and reduces each recursion to one affine map and the
   state it ends in without one before. The first few bars, whose windows reach back beyond the slice, go along as they are;
3. a scan over a symbol's slices, short rows all, gives the state that each begins with;
4. tasks make the bars again, replay the recursions from that state and sum up what they show.

Bars are made twice, which costs less than to keep them. Unlike ``slices``, which takes any table of bars and the expressions of
a sheet, this takes recursions with a steady gain over closes and gives sums, not a row a bar.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tapeloom.functions.scratch import Scratch

#: seconds of a cell; the cell of rows without a time, which come first
CELL, UNTIMED = 6 * 3600, -(1 << 40)
#: so many cells go to all tasks at once, more by a join of both sides
FEW_CELLS = 1 << 18


@dataclass(frozen=True)
class Growth:
    """A row becomes ``each`` bars, ``step`` seconds apart. ``prices``: values of n rows -> open and close, n x each; bars of one
    time are in the order of these (what else tells them apart must follow from the open)."""

    each: int
    step: int
    prices: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]

    @property
    def reach(self) -> int:
        return (self.each - 1) * self.step


@dataclass(frozen=True)
class Fold:
    """``y += gain * (x - y)``, from the mean of the first ``seed`` values without a gap; a missing x leaves y as it is.
    ``x``: closes -> values, each of which reads ``back`` closes before its own."""

    gain: float
    seed: int = 1
    back: int = 0
    x: Callable[[np.ndarray], np.ndarray] = lambda closes: closes


@dataclass(frozen=True)
class Measure:
    """What ``show`` makes of the states of ``folds`` after each bar and the number of closes seen until then."""

    folds: tuple[Fold, ...]
    show: Callable[[list[np.ndarray], np.ndarray], np.ndarray]


def _since(n: int) -> Callable[[list[np.ndarray], np.ndarray], np.ndarray]:
    return lambda ys, seen: np.where(seen >= n, ys[0], np.nan)


def ema(n: int) -> Measure:
    return Measure((Fold(2 / (n + 1)),), _since(n))


def smma(n: int) -> Measure:
    return Measure((Fold(1 / n),), _since(n))


def _change(closes: np.ndarray, sign: float) -> np.ndarray:
    return np.maximum(np.diff(closes, prepend=np.nan) * sign, 0.0)  # missing where one of the two is


def rsi(n: int) -> Measure:
    def show(ys: list[np.ndarray], _: np.ndarray) -> np.ndarray:
        gain, loss = ys
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(loss == 0, np.where(gain == 0, 50.0, np.where(gain == gain, 100.0, np.nan)), 100 - 100 / (1 + gain / loss))

    return Measure(tuple(Fold(1 / n, n, 1, lambda closes, s=s: _change(closes, s)) for s in (1.0, -1.0)), show)


# recursions over arrays -------------------------------------------------------------------------------------------------


def first_mean(x: np.ndarray, n: int, least: int) -> tuple[int, float] | None:
    """The first place from ``least`` on that ends n values without a gap, and their mean."""
    gaps = np.concatenate([[0], np.cumsum(np.isnan(x))])
    ends = np.flatnonzero(gaps[n:] == gaps[:-n]) + n - 1 if len(x) >= n else np.zeros(0, int)
    ends = ends[np.searchsorted(ends, least) :]
    return (int(ends[0]), float(x[ends[0] - n + 1 : ends[0] + 1].mean())) if len(ends) else None


def end_map(x: np.ndarray, gain: float) -> tuple[float, float]:
    """(keep, add) of y -> keep * y + add over all of x."""
    x, q = x[~np.isnan(x)], 1 - gain
    weights = q ** np.arange(min(len(x), 1 + int(-750 / np.log(q)) if 0 < q < 1 else 1), dtype=float)  # what follows is 0 as a double
    return float(q ** len(x)), float(gain * np.dot(x[::-1][: len(weights)], weights))


def steady(x: np.ndarray, gain: float, y: float) -> np.ndarray:
    """The states after each of x, from y on: blocks side by side, each from 0, then what the one before leaves to it."""
    there = ~np.isnan(x)
    if not there.all():
        return np.concatenate([[y], steady(x[there], gain, y)])[np.cumsum(there)]
    n, q = len(x), 1 - gain
    width = max(1, int(np.sqrt(n)))
    blocks = -(-n // width)
    out = np.zeros(blocks * width)
    out[:n] = x
    out = np.ascontiguousarray(out.reshape(blocks, width).T)
    out *= gain
    for k in range(1, width):
        out[k] += q * out[k - 1]
    begin, whole = np.empty(blocks), q**width
    for b, end in enumerate(out[-1].tolist()):
        begin[b] = y
        y = whole * y + end
    out += np.outer(q ** np.arange(1, width + 1), begin)
    return out.T.ravel()[:n]


def walk(x: np.ndarray, fold: Fold, y: float, least: int) -> np.ndarray:
    """The states at the places of x from ``least`` on, the one before them being y (NaN: none yet)."""
    if y == y:
        return steady(x[least:], fold.gain, y)
    out, got = np.full(len(x) - least, np.nan), first_mean(x, fold.seed, least)
    if got is not None:
        at, y = got
        out[at - least] = y
        out[at - least + 1 :] = steady(x[at + 1 :], fold.gain, y)
    return out


def body_map(x: np.ndarray, fold: Fold, least: int) -> tuple[float, float, float]:
    """(keep, add, fresh) from ``least`` on; fresh: the last state if there is none before."""
    got = first_mean(x, fold.seed, least)
    if got is None:
        return *end_map(x[least:], fold.gain), np.nan
    at, y = got
    (k, a), (keep, add) = end_map(x[least : at + 1], fold.gain), end_map(x[at + 1 :], fold.gain)
    return keep * k, keep * a + add, keep * y + add


def closes(rows: pa.Table, growth: Growth, begin: int, end: int | None) -> np.ndarray:
    """The closes of a slice's bars in their order; missing ones are NaN, and missing opens come first in their time."""
    at, value = rows.column("at_").combine_chunks(), rows.column("value_").to_numpy()
    untimed = at.is_null().to_numpy(zero_copy_only=False)
    at = at.fill_null(UNTIMED * CELL).to_numpy()
    first, close = growth.prices(value)
    time = at[:, None] + np.where(untimed, 0, growth.step)[:, None] * np.arange(growth.each)
    inside = time >= begin if end is None else (time >= begin) & (time < end)
    time, first, close = time[inside], first[inside], close[inside]
    tie, then = (np.where(np.isnan(v), -np.inf, v) for v in (close, first))
    return close[np.lexsort((tie, then, time))]


# slices -----------------------------------------------------------------------------------------------------------------


def dealt(rows: DataFrame, growth: Growth, slice_rows: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows by slice: key_, slice_, at_, value_; slices: key_, slice_, begin_, end_) of rows (symbol, at, value)."""
    cell = f"(at_ - pmod(at_, {CELL})) div {CELL}"
    last = cell.replace("at_", f"(at_ + {growth.reach})")
    touched = f"CASE WHEN at_ IS NULL THEN array({UNTIMED}L) ELSE sequence({cell}, {last}) END"
    key = F.coalesce(F.concat(F.lit("="), F.col("symbol").cast("string")), F.lit(""))
    named = rows.select(key.alias("key_"), F.col("at").cast("long").alias("at_"), F.col("value").cast("double").alias("value_"))
    named = named.select("*", F.posexplode(F.expr(touched)).alias("nth_", "cell_"))
    counts = named.groupBy("key_", "cell_").agg(F.count("*").alias("n_"))
    before = "coalesce(sum(n_) OVER (PARTITION BY key_ ORDER BY cell_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)"
    cells = counts.select("key_", "cell_", F.expr(f"{before} * {growth.each} div {slice_rows}").alias("slice_"))
    opens = F.expr("NOT lag(slice_) OVER (PARTITION BY key_ ORDER BY cell_) <=> slice_")
    cells = scratch.cut(cells.withColumn("opens_", opens), "cells")
    end = F.expr("lead(cell_) OVER (PARTITION BY key_ ORDER BY cell_)") * CELL
    slices = scratch.cut(cells.where("opens_").select("key_", "slice_", (F.col("cell_") * CELL).alias("begin_"), end.alias("end_")), "slices")
    # a row that touches two cells of one slice is there by the first of them
    joined = named.join(F.broadcast(cells) if cells.count() <= FEW_CELLS else cells, ["key_", "cell_"]).where("nth_ = 0 OR opens_")
    return joined.select("key_", "slice_", "at_", "value_"), slices


def summed(rows: DataFrame, growth: Growth, measures: dict[str, Measure], slice_rows: int = 1 << 18) -> DataFrame:
    """(symbol, bars, and for each measure its ``sum_`` and ``n_``, the number of bars that have one) of the bars of ``rows``
    (symbol, at in seconds, value).

    A null symbol is one of its own, rows without a time come before all others and their bars have one time, a missing value
    (or NaN) gives bars without prices, rows that repeat count as often as they stand there; an empty table gives no rows.
    """
    folds = [f for m in measures.values() for f in m.folds]
    deep = max(f.back + f.seed - 1 for f in folds)  # so many closes before a bar tell all of its values and seeds
    doubles = pa.list_(pa.float64())
    own = ("key_", "slice_", "begin_", "end_")

    def bars(rows: pa.Table, slices: pa.Table) -> np.ndarray:
        return closes(rows, growth, slices.column("begin_")[0].as_py(), slices.column("end_")[0].as_py())

    def reduced(rows: pa.Table, slices: pa.Table) -> pa.Table:
        c = bars(rows, slices)
        maps = [v for f in folds for v in (body_map(f.x(c), f, deep) if len(c) > deep else (1.0, 0.0, np.nan))]
        lists = {"head": c[:deep], "tail": c[len(c) - min(deep, len(c)) :], "maps": np.array(maps)}
        seen = pa.array([(~np.isnan(c)).sum()], pa.int64())
        return pa.table({c: slices.column(c) for c in own} | {"seen": seen} | {c: pa.array([v], doubles) for c, v in lists.items()})

    def scanned(slices: pa.Table) -> pa.Table:
        slices = slices.sort_by("slice_")
        before, states, seen, told = np.zeros(0), [np.nan] * len(folds), 0, []
        for n, head, tail, maps in zip(*(slices.column(c).to_pylist() for c in ("seen", "head", "tail", "maps"))):
            told.append((seen, before.tolist(), states))
            here = np.concatenate([before, np.array(head, float)])
            states = [float(walk(f.x(here), f, y, len(before))[-1]) if head else y for f, y in zip(folds, states)]
            states = [fresh if y != y else keep * y + add for y, keep, add, fresh in zip(states, maps[::3], maps[1::3], maps[2::3])]
            before = np.array(tail, float) if len(head) == deep else here[len(here) - min(deep, len(here)) :]
            seen += n
        made = zip(("seen", "before", "states"), zip(*told), (pa.int64(), doubles, doubles))
        return pa.table({c: slices.column(c) for c in own} | {c: pa.array(v, k) for c, v, k in made})

    def replayed(rows: pa.Table, slices: pa.Table) -> pa.Table:
        c, before = bars(rows, slices), np.array(slices.column("before")[0].as_py(), float)
        whole, states = np.concatenate([before, c]), iter(slices.column("states")[0].as_py())
        seen = slices.column("seen")[0].as_py() + np.cumsum(~np.isnan(c))
        out = {"key_": slices.column("key_"), "bars": pa.array([len(c)], pa.int64())}
        for name, m in measures.items():
            shown = m.show([walk(f.x(whole), f, next(states), len(before)) for f in m.folds], seen)
            shown = shown[~np.isnan(shown)]
            out |= {f"sum_{name}": pa.array([shown.sum()], pa.float64()), f"n_{name}": pa.array([len(shown)], pa.int64())}
        return pa.table(out)

    scratch = Scratch(rows.sparkSession, "grown")
    by_slice, slices = dealt(rows, growth, slice_rows, scratch)
    by_slice, where = by_slice.groupBy("key_", "slice_"), "key_ string, slice_ bigint, begin_ bigint, end_ bigint"
    parts = by_slice.cogroup(slices.groupBy("key_", "slice_")).applyInArrow(reduced, f"{where}, seen bigint, head array<double>, tail array<double>, maps array<double>")
    starts = scratch.cut(parts.groupBy("key_").applyInArrow(scanned, f"{where}, seen bigint, before array<double>, states array<double>"), "starts")
    sums = by_slice.cogroup(starts.groupBy("key_", "slice_")).applyInArrow(replayed, "key_ string, bars bigint, " + ", ".join(f"sum_{m} double, n_{m} bigint" for m in measures))
    got = sums.groupBy("key_").agg(*(F.sum(c).alias(c) for c in sums.columns if c != "key_"))
    return got.select(F.expr("CASE WHEN key_ <> '' THEN substr(key_, 2) END").cast(rows.schema["symbol"].dataType).alias("symbol"), *(c for c in got.columns if c != "key_"))

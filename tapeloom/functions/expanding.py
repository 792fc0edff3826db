"""Expanding measures of any kind by accumulators: a state that takes values one by one and merges with the next stretch's.

The rows are cut into ranges of (symbol, time) of even size, so a symbol with a third of the rows is many ranges. Each range is
reduced to its states, a symbol's states are merged in order, and each range is walked again from the state before it. What
moves is the rows, twice, and one state for each symbol and range; nothing holds the values so far.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isfinite

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


@dataclass(frozen=True)
class Accumulator:
    """``step(state, x)`` and ``merge(earlier, later)`` give new states of bounded size; ``value(state)`` a number or None."""

    init: Callable
    step: Callable
    merge: Callable
    value: Callable


def _merged_moments(a: tuple, b: tuple) -> tuple:
    n = a[0] + b[0]
    if not n:
        return a
    apart = b[1] - a[1]
    return n, a[1] + apart * b[0] / n, a[2] + b[2] + apart * apart * a[0] * b[0] / n


#: sample variance: (n, mean, squares)
VARIANCE = Accumulator(lambda: (0, 0.0, 0.0), lambda s, x: _merged_moments(s, (1, x, 0.0)), _merged_moments, lambda s: s[2] / (s[0] - 1) if s[0] > 1 else None)


def _deeper(a: tuple, b: tuple) -> tuple:
    if a[0] is None or b[0] is None:
        return b if a[0] is None else a
    return max(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2], 1 - b[1] / a[0] if a[0] > 0 else 0.0)


#: the largest fall from a high so far, as a share of it: (high, low, fall)
DRAWDOWN = Accumulator(lambda: (None, None, 0.0), lambda s, x: _deeper(s, (x, x, 0.0)), _deeper, lambda s: s[2])


def _longer(a: tuple, b: tuple) -> tuple:
    if not a[0] or not b[0]:
        return b if not a[0] else a
    joined = b[1] > a[2]
    head = a[3] + b[3] if joined and a[3] == a[0] else a[3]
    tail = b[4] + a[4] if joined and b[4] == b[0] else b[4]
    return a[0] + b[0], a[1], b[2], head, tail, max(a[5], b[5], a[4] + b[3] if joined else 0)


#: the longest run of rising values so far: (n, first, last, run at the start, run at the end, longest)
LONGEST_RISE = Accumulator(lambda: (0, None, None, 0, 0, 0), lambda s, x: _longer(s, (1, x, x, 1, 1, 1)), _longer, lambda s: float(s[5]) if s[0] else None)


def accumulate(df: DataFrame, asked: dict[str, tuple[str, Accumulator]], least: int = 1, by: str = "symbol", order: tuple[str, ...] = ("ts",), ranges: int | None = None) -> DataFrame:
    """``df`` with the measures ``asked`` (name: column, accumulator) of the values up to each row.

    Missing and non-finite values are passed over; a measure has a value from ``least`` known values on. Rows that are equal in
    ``order`` go by all their numbers. A null symbol is a symbol; rows without a time come first; an empty table gives
    no rows. Names that are taken are an error. ``ranges``: how many, by the session's shuffle setting otherwise.
    """
    if taken := sorted({*asked} & set(df.columns)):
        raise ValueError(f"the rows have columns {taken} already")
    plain = {c: f"c{i}_" for i, c in enumerate(df.columns)}  # Arrow passes take no dots in names
    moved = {f"m{i}_": (plain[c], a) for i, (c, a) in enumerate(asked.values())}
    got = _accumulate(df.toDF(*plain.values()), moved, least, plain[by], tuple(plain[c] for c in order), ranges)
    return got.toDF(*df.columns, *asked)


def _accumulate(df: DataFrame, asked: dict[str, tuple[str, Accumulator]], least: int, by: str, order: tuple[str, ...], ranges: int | None) -> DataFrame:
    scratch = Scratch(df.sparkSession, "expanding")
    kinds = dict(df.dtypes)
    ties = [c for c, k in kinds.items() if k in ("double", "float", "int", "bigint") and c not in (by, *order)]
    keys = [F.col(c) for c in (by, *order)]
    dealt = df.repartitionByRange(*([ranges] if ranges else []), *keys)
    rows = scratch.cut(dealt.withColumn("part_", F.spark_partition_id()), "ranges")
    sorting = [F.col(c) for c in (by, "part_", *order, *ties)]
    folds = [(column, a) for column, a in asked.values()]
    columns = list(dict.fromkeys(c for c, _ in folds))

    def walked(part: pa.RecordBatch, states: list) -> list[list]:
        """The values after each row of one symbol's stretch; moves the states, [known values, state] each, on."""
        out = []
        numbers = {c: [float(v) if v is not None and isfinite(v) else None for v in part.column(part.schema.get_field_index(c)).to_pylist()] for c in columns}
        for held, (c, a) in zip(states, folds):
            n, state, found = *held, []
            for x in numbers[c]:
                if x is not None:
                    n, state = n + 1, a.step(state, x)
                found.append(a.value(state) if n >= least else None)
            held[:] = n, state
            out.append(found)
        return out

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        """Runs of rows of one (symbol, range)."""
        for batch in batches:
            names = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (by, "part_"))))
            at = 0
            for i in range(1, len(names) + 1):
                if i == len(names) or names[i] != names[at]:
                    yield names[at], batch.slice(at, i - at)
                    at = i

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, states = None, []

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*now, pickle.dumps(states)), (symbols, pa.int32(), pa.binary()))], names=[by, "part_", "starts_"])

        symbols = None
        for key, part in stretches(batches):
            if key != now:
                if now is not None:
                    yield told()
                now, states, symbols = key, [[0, a.init()] for _, a in folds], part.schema.field(by).type
            walked(part, states)
        if now is not None:
            yield told()

    def scanned(got: pd.DataFrame) -> pd.DataFrame:
        states, starts = [[0, a.init()] for _, a in folds], []
        got = got.sort_values("part_")
        for later in got["starts_"]:
            starts.append(pickle.dumps(states))
            states = [[n + m, a.merge(s, t)] for (n, s), (m, t), (_, a) in zip(states, pickle.loads(later), folds)]
        return got.assign(starts_=starts)

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, states = None, []
        for key, part in stretches(batches):
            if key != now:
                now, states = key, pickle.loads(part.column(part.schema.get_field_index("starts_"))[0].as_py())
            made = [pa.array(v, pa.float64()) for v in walked(part, states)]
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kinds), *made], names=[*kinds, *asked])

    kind = f"{by} {kinds[by]}, part_ int, starts_ binary"
    narrow = rows.select(*dict.fromkeys([by, "part_", *order, *ties, *columns]))
    ends = narrow.repartition(by, "part_").sortWithinPartitions(*sorting).mapInArrow(reduced, kind)
    starts = scratch.cut(ends.groupBy(by).applyInPandas(scanned, kind), "starts").withColumnRenamed(by, "by_").withColumnRenamed("part_", "range_")
    both = rows.join(starts, F.col(by).eqNullSafe(F.col("by_")) & (F.col("part_") == F.col("range_"))).drop("by_", "range_")
    schema = ", ".join([*(f"{c} {k}" for c, k in kinds.items()), *(f"{c} double" for c in asked)])
    return both.repartition(by, "part_").sortWithinPartitions(*sorting).mapInArrow(replayed, schema)

"""The indicator catalogue: name -> function of a sheet that gives one column or several named ones."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tapeloom.functions import slices
from tapeloom.functions.sheet import Sheet

BAR = {"symbol": "string", "ts": "timestamp", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "double"}
BENCH = BAR | {f"bench_{c}": "double" for c in ("open", "high", "low", "close", "volume")}


class IndicatorError(ValueError):
    """A parameter or a column that an indicator can't work with."""


@dataclass(frozen=True)
class Indicator:
    name: str
    build: Callable
    needs_bench: bool
    recursive: bool  # its machine has no SQL form

    @property
    def parameters(self) -> dict:
        return {p.name: p.default for p in list(inspect.signature(self.build).parameters.values())[1:]}


CATALOGUE: dict[str, Indicator] = {}


def indicator(name: str, bench: bool = False, machine: bool = False):
    def keep(build: Callable) -> Callable:
        CATALOGUE[name] = Indicator(name, build, bench, machine)
        return build

    return keep


def alias(name: str, of: str, pick: str | None = None, **fixed) -> None:
    """``name``: the indicator ``of``, or one of its columns, with some parameters fixed."""
    base = CATALOGUE[of]

    def build(s: Sheet, **kw):
        got = base.build(s, **(fixed | kw))
        return got[pick] if pick else got

    build.__signature__ = inspect.signature(base.build)
    CATALOGUE[name] = Indicator(name, build, base.needs_bench, base.recursive)


def positive(n: int, name: str = "length") -> int:
    if not isinstance(n, int) or isinstance(n, bool) or n <= 0:
        raise IndicatorError(f"{name} must be an integer above 0, not {n!r}")
    return n


def price(s: Sheet, source: str) -> str:
    """A column of the bars or one of the computed sources."""
    forms = {
        "hl2": "(high + low) / 2", "median_price": "(high + low) / 2", "hlc3": "(high + low + close) / 3", "typical_price": "(high + low + close) / 3",
        "ohlc4": "(open + high + low + close) / 4", "weighted_price": "(high + low + 2 * close) / 4",
    }
    if source in s.columns:
        return source
    if source not in forms:
        raise IndicatorError(f"no column or computed source {source!r}")
    return s.put(forms[source])


def columns(s: Sheet, name: str, **kw) -> dict[str, str]:
    """The output columns of an indicator, named after it."""
    offset, fill = kw.pop("offset", 0), kw.pop("fillna", None)
    got = CATALOGUE[name].build(s, **kw)
    family, last = name.split(".")
    if last in BAR:
        last = f"{family}_{last}"
    got = {last: got} if isinstance(got, str) else {f"{last}_{k}": v for k, v in got.items()}
    if offset or fill is not None:
        done = {}
        for k, v in got.items():
            c = s.lag(v, offset) if offset else s.put(v)
            done[k] = c if fill is None else s.put(f"coalesce({c}, {fill!r})")
        return done
    return got


def compute(bars: DataFrame, names: list[str] | dict[str, dict], digits: int | None = None, slice_rows: int | None = None) -> DataFrame:
    """``bars`` with the columns of the named indicators (dict: name -> parameters, offset and fillna among them).

    Null and repeated timestamps order as Spark orders them; a null symbol is a symbol of its own; columns of ``bars``
    beyond the bar columns are kept. An empty table gives no rows. ``slice_rows``: so many bars of a symbol are a unit of
    work, not all of them (``slices.sliced``, which tells what can't be had so); ``sliceable`` names what can.
    """
    asked = {n: {} for n in names} if not isinstance(names, dict) else names
    s = Sheet({f.name: f.dataType.simpleString() for f in bars.schema})
    out: dict[str, str] = {}
    for name, kw in asked.items():
        out |= columns(s, name, **kw)
    return s.spark(bars, out, digits) if slice_rows is None else slices.sliced(s, bars, out, digits, slice_rows)


def sliceable(name: str, **kw) -> bool:
    """Whether an indicator can be had from time slices of a symbol."""
    s = Sheet(dict(BENCH))
    return slices.can_slice(s, columns(s, name, **kw))


def sql(source: str, names: list[str] | dict[str, dict], digits: int | None = None, bench: bool = False) -> str:
    """DuckDB SQL of ``compute`` over the SQL ``source``."""
    asked = {n: {} for n in names} if not isinstance(names, dict) else names
    s = Sheet(dict(BENCH if bench else BAR))
    out: dict[str, str] = {}
    for name, kw in asked.items():
        out |= columns(s, name, **kw)
    return s.duck(source, out, digits)


def col(bars: DataFrame, name: str) -> Column:
    if name not in bars.columns:
        raise IndicatorError(f"the bars have no column {name!r}")
    return F.col(name)

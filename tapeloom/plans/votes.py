"""Evidence and looks back that all analyzers build on, as SQL expressions over a feature sheet."""

from __future__ import annotations

from dataclasses import dataclass, field

from tapeloom.functions.sheet import Sheet

TINY = "1e-9"


@dataclass
class Votes:
    """Evidence of one verdict: (type, weight, [(test, text, polarity)]); the first case that holds counts."""

    s: Sheet
    items: list[tuple[str, float, list[tuple[str, str, int]]]] = field(default_factory=list)

    def add(self, kind: str, weight: float, *cases: tuple[str, str, int]) -> None:
        self.items.append((kind, weight, list(cases)))

    def _case(self, cases: list, value, other: str) -> str:
        return "CASE " + " ".join(f"WHEN {t} THEN {value(x, p)}" for t, x, p in cases) + f" ELSE {other} END"

    def polarity(self, i: int) -> str:
        """The polarity of item i, missing where no case holds."""
        return self.s.put(self._case(self.items[i][2], lambda x, p: str(p), "cast(NULL AS int)"))

    def score(self) -> str:
        return self.s.put(" + ".join(f"{w!r} * coalesce({self.polarity(i)}, 0)" for i, (_, w, _) in enumerate(self.items)))

    def weight(self, test: str) -> str:
        """Weight of the items whose polarity p fulfils ``test``."""
        return self.s.put(" + ".join(f"CASE WHEN {test.format(p=self.polarity(i))} THEN {w!r} ELSE 0.0 END" for i, (_, w, _) in enumerate(self.items)))

    def confidence(self, side: str) -> str:
        return self.s.put(f"100 * {self.s.div(self.weight('{p} = ' + side), self.weight('{p} IS NOT NULL'), '0.0')}")

    def evidence(self) -> str:
        one = [f"CASE WHEN {self.polarity(i)} IS NOT NULL THEN named_struct('type', '{k}', 'weight', cast({w!r} AS double), 'value', {self._case(c, lambda x, p: repr(x), 'NULL')}, 'polarity', {self.polarity(i)}) END" for i, (k, w, c) in enumerate(self.items)]
        return self.s.put(f"filter(array({', '.join(one)}), e -> e IS NOT NULL)")


def band(x: str, *steps: tuple[float, str], other: str, sign: str = ">=") -> str:
    return "CASE " + " ".join(f"WHEN {x} {sign} {v!r} THEN '{t}'" for v, t in steps) + f" ELSE '{other}' END"


def shifted(x: str, top: str, high: str, middle: str, low: str, bottom: str, far: float = 60, near: float = 20) -> str:
    """Five labels of a score around zero."""
    return f"CASE WHEN {x} >= {far} THEN '{top}' WHEN {x} >= {near} THEN '{high}' WHEN {x} > -{near} THEN '{middle}' WHEN {x} > -{far} THEN '{low}' ELSE '{bottom}' END"


def clip(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, {low!r}), {high!r})"


class Look:
    """Aggregates over the last bars of a feature sheet; shorter histories count as they are."""

    def __init__(self, s: Sheet):
        self.s = s

    def f(self, name: str, x: str, n: int, end: int = 0) -> str:
        return self.s.put(f"{name}({self.s.put(x)}) {self.s.rows(n, end)}")

    def slope(self, x: str, n: int) -> str:
        """Mean step over the last n bars."""
        return self.f("avg", f"{self.s.put(x)} - {self.s.lag(x)}", n - 1)

    def seen(self, x: str, n: int) -> str:
        """Array of the values of the last n bars that aren't missing, oldest first."""
        x, w = self.s.put(x), self.s.rows(n)
        return self.s.put(f"collect_list({x}) {w}", f"coalesce(list({x}) FILTER (WHERE {x} IS NOT NULL) {w}, [])")

    def quantile(self, x: str, q: float, n: int) -> str:
        x, w = self.s.put(x), self.s.rows(n)
        return self.s.put(f"percentile({x}, {q}) {w}", f"quantile_cont({x}, {q}) {w}")

    def rank(self, x: str, n: int) -> str:
        """Place of the value among those of the last n bars in per cent, ties in their middle."""
        x = self.s.put(x)
        held = self.seen(x, n)
        return self.s.put(f"100.0 * ({self.s.count_if(held, f'v < {x}')} + ({self.s.count_if(held, f'v = {x}')} + 1) / 2.0) / nullif(count({x}) {self.s.rows(n)}, 0)")

    def run_of(self, array: str, test: str) -> str:
        """How many of the last elements v of an array fulfil ``test`` in a row."""
        return self.s.put(
            f"CASE WHEN array_position(reverse(transform({array}, v -> {test})), false) = 0 THEN size({array}) ELSE cast(array_position(reverse(transform({array}, v -> {test})), false) AS int) - 1 END",
            f"coalesce(nullif(list_position(list_reverse(list_transform({array}, lambda v: {test})), false), 0) - 1, len({array}))",
        )

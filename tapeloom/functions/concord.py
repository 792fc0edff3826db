"""Rank correlations of sliding windows: each row is one insertion and one deletion, no window is ranked anew.

Kept is a ring of the last n pairs and, for each of them, how many of the others lie below it less how many lie above it, on
either side: twice its centred average rank. A row's pair changes these counts by the signs of its differences from the
ring. Spearman's coefficient is the correlation of the counts; Kendall's follows from the sum of the products of the signs
and from the ties. All of it are whole numbers, so nothing drifts. A row costs a handful of vector operations over the ring.
"""

from __future__ import annotations

from collections.abc import Callable
from math import sqrt

import numpy as np

#: counts and their sums of squares stay whole in a double up to this length
LONGEST = 200_000


class Concordance:
    """The last n pairs. A pair with a missing side counts for nothing but holds its place."""

    def __init__(self, n: int):
        self.n, self.at, self.known = n, 0, 0
        self.x, self.y = np.full(n, np.nan), np.full(n, np.nan)
        self.a, self.b = np.zeros(n), np.zeros(n)  # below less above, of either side
        self.both = 0  # concordant less discordant pairs
        self.unlike_x = self.unlike_y = 0  # pairs that differ on a side
        self.more, self.less = np.empty(n, bool), np.empty(n, bool)
        self.signs_x, self.signs_y = np.empty(n), np.empty(n)

    def _signs(self, side: np.ndarray, v: float, out: np.ndarray) -> np.ndarray:
        """The signs of the ring's values less v; 0 where a value is missing."""
        np.greater(side, v, out=self.more)
        np.less(side, v, out=self.less)
        return np.subtract(self.more.view(np.int8), self.less.view(np.int8), out=out)

    def _move(self, x: float, y: float, by: int) -> None:
        g, h = self._signs(self.x, x, self.signs_x), self._signs(self.y, y, self.signs_y)
        self.both += by * int(g @ h)
        self.unlike_x += by * int(g @ g)
        self.unlike_y += by * int(h @ h)
        if by > 0:
            self.a += g
            self.b += h
            self.a[self.at], self.b[self.at] = -g.sum(), -h.sum()
        else:
            self.a -= g
            self.b -= h
            self.a[self.at] = self.b[self.at] = 0

    def push(self, x: float | None, y: float | None) -> None:
        at = self.at
        if self.x[at] == self.x[at]:
            gone = float(self.x[at]), float(self.y[at])
            self.x[at] = self.y[at] = np.nan
            self._move(*gone, -1)
            self.known -= 1
        if x is not None and y is not None and x == x and y == y:
            self._move(x, y, 1)
            self.x[at], self.y[at] = x, y
            self.known += 1
        self.at = (at + 1) % self.n

    def spearman(self) -> float | None:
        d = sqrt(float(self.a @ self.a) * float(self.b @ self.b))
        return float(self.a @ self.b) / d if d else None

    def kendall(self) -> float | None:
        d = sqrt(self.unlike_x * self.unlike_y)
        return self.both / d if d else None


def window(n: int, measure: str) -> Callable:
    """A machine over two columns: ``spearman`` or ``kendall`` of the last n pairs, where none of them is missing.

    Ties have average ranks (Spearman) or count as in tau-b (Kendall); a side that doesn't vary gives none. The first n - 1
    rows have no value.
    """
    if n > LONGEST:
        raise ValueError(f"a window of {n} pairs; {LONGEST} at most")

    def make():
        held = Concordance(n)
        value = getattr(held, measure)

        def step(x: list, y: list) -> list[list]:
            out = []
            for pair in zip(x, y):
                held.push(*pair)
                out.append(value() if held.known == n else None)
            return [out]

        return step

    return make

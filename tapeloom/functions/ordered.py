"""Order statistics of sliding windows in O(log n) a row: a Fenwick tree over the ranks of the values.

A stretch of rows and the window before it are ranked once; then every row adds one rank and removes one, and the k-th value
of the window is found by descending the tree. What a stretch leaves behind is its last ``n - 1`` values.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from math import floor

import numpy as np

#: windows from this length on are worth a pass over the rows; shorter ones are windows of the engine
LONG_WINDOW = 65


class Ranks:
    """How many values of each rank are there."""

    def __init__(self, n: int):
        self.n, self.tree = n, [0] * (n + 1)
        self.top = 1 << max(0, n.bit_length() - 1)

    def add(self, rank: int, by: int) -> None:
        tree, n, i = self.tree, self.n, rank + 1
        while i <= n:
            tree[i] += by
            i += i & -i

    def up_to(self, rank: int) -> int:
        """Values of this rank or a lower one."""
        tree, i, found = self.tree, rank + 1, 0
        while i:
            found += tree[i]
            i &= i - 1
        return found

    def kth(self, k: int) -> int:
        """The rank of the k-th value, from 0."""
        tree, n, at, step = self.tree, self.n, 0, self.top
        while step:
            nxt = at + step
            if nxt <= n and tree[nxt] <= k:
                at = nxt
                k -= tree[nxt]
            step >>= 1
        return at


def _between(ranks: Ranks, values: list[float], n: int, q: float) -> float:
    at = q * (n - 1)
    low = floor(at)
    a = values[ranks.kth(low)]
    if at == low:
        return a
    return (low + 1 - at) * a + (at - low) * values[ranks.kth(low + 1)]


def _kth_gap(ranks: Ranks, values: list[float], n: int, middle: float, below: int, k: int) -> float:
    """The k-th smallest distance from ``middle``: of the ``below`` values up to it, nearest first, and those above it."""
    left = lambda i: middle - values[ranks.kth(below - 1 - i)]
    right = lambda i: values[ranks.kth(below + i)] - middle
    low, high = max(0, k + 1 - (n - below)), min(below, k + 1)
    while low < high:  # how many of the k + 1 nearest lie below
        take = (low + high) // 2
        if left(take) < right(k - take):
            low = take + 1
        else:
            high = take
    ends = ([left(low - 1)] if low else []) + ([right(k - low)] if low <= k else [])
    return max(ends)


def _deviation(ranks: Ranks, values: list[float], n: int) -> float:
    """The median distance from the median."""
    middle = _between(ranks, values, n, 0.5)
    below = ranks.up_to(bisect_right(values, middle) - 1)
    gaps = [_kth_gap(ranks, values, n, middle, below, k) for k in {(n - 1) // 2, n // 2}]
    return sum(gaps) / len(gaps)


def window(n: int, measures: tuple) -> Callable:
    """A machine over one column: the measures of the last n values, where none of them is missing.

    ``("quantile", q)``, interpolated; ``("below",)`` and ``("same",)``: how many are less than the last one, and equal to it;
    ``("deviation",)``: the median distance from the median.
    """

    def make():
        held: list = []

        def step(column: list) -> list[list]:
            nonlocal held
            every = held + column
            x = np.array([np.nan if v is None else v for v in every], np.float64)
            values, rank = np.unique(x[~np.isnan(x)], return_inverse=True)
            of = np.full(len(x), -1)
            of[~np.isnan(x)] = rank
            of, values = of.tolist(), values.tolist()
            ranks, known, begin = Ranks(len(values)), 0, len(held)
            for r in of[:begin]:
                if r >= 0:
                    ranks.add(r, 1)
                    known += 1
            out: list[list] = [[] for _ in measures]
            for i in range(begin, len(of)):
                r = of[i]
                if r >= 0:
                    ranks.add(r, 1)
                    known += 1
                gone = of[i - n] if i >= n else -1
                if gone >= 0:
                    ranks.add(gone, -1)
                    known -= 1
                for found, m in zip(out, measures):
                    if known < n:
                        found.append(None)
                    elif m[0] == "quantile":
                        found.append(_between(ranks, values, n, m[1]))
                    elif m[0] == "below":
                        found.append(ranks.up_to(r - 1) if r else 0)
                    elif m[0] == "same":
                        found.append(ranks.up_to(r) - (ranks.up_to(r - 1) if r else 0))
                    else:
                        found.append(_deviation(ranks, values, n))
            held = every[len(every) - min(len(every), n - 1) :] if n > 1 else []
            return out

        return step

    return make

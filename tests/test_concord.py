"""Rank correlations of sliding windows against counting all pairs, and their cost against the window's length."""

import time

import numpy as np
import pytest

from tapeloom.functions import concord


def _both(x, y):
    """(Spearman, Kendall tau-b) from all pairs."""
    a, b = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    ra, rb = a.sum(1), b.sum(1)
    found = []
    for p, q in ((ra, rb), (a.ravel(), b.ravel())):
        d = np.sqrt((p @ p) * (q @ q))
        found.append(p @ q / d if d else None)
    return found


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
@pytest.mark.parametrize("different", [2, 6, 10**6])
def test_windows_equal_all_pairs_over_stretches_ties_and_gaps(n, different):
    rng = np.random.default_rng(n)
    x, y = ([None if rng.random() < 0.01 else float(v) for v in rng.integers(0, different, 400) / 7] for _ in range(2))
    x[5] = float("nan")
    steps, got = [concord.window(n, m)() for m in ("spearman", "kendall")], [[], []]
    at = 0
    while at < len(x):
        k = int(rng.integers(1, 60))
        for g, step in zip(got, steps):
            g += step(x[at : at + k], y[at : at + k])[0]
        at += k
    for i in range(len(x)):
        w = np.array([x[max(0, i - n + 1) : i + 1], y[max(0, i - n + 1) : i + 1]], float)
        want = [None, None] if w.shape[1] < n or np.isnan(w).any() else _both(*w)
        for g, v in zip(got, want):
            assert (g[i] is None) == (v is None)
            assert v is None or abs(g[i] - v) < 1e-12


def test_no_rows_and_only_gaps():
    step = concord.window(3, "kendall")()
    assert step([], []) == [[]] and step([None] * 4, [1.0] * 4) == [[None] * 4]
    with pytest.raises(ValueError):
        concord.window(concord.LONGEST + 1, "kendall")


def test_cost_hardly_grows_with_the_window():
    x, y = np.random.default_rng(3).normal(size=(2, 12_000)).tolist()

    def took(n):
        step, began = concord.window(n, "kendall")(), time.process_time()
        step(x, y)
        return time.process_time() - began

    took(20)
    assert min(took(5000), took(5000)) < 5 * min(took(20), took(20))

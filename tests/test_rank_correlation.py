"""Kendall's tau over range partitions against all pairs."""

import numpy as np
import pytest

from tapeloom.operators import rank_correlation as rc


def brute(x, y):
    a, b = np.sign(np.subtract.outer(x, x)), np.sign(np.subtract.outer(y, y))
    d = np.sqrt((abs(a).sum()) * (abs(b).sum()))
    return (a * b).sum() / d if d else None


def test_inversions_equal_all_pairs():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 200):
        rank, weight = rng.permutation(n), rng.integers(1, 5, n)
        want = sum(int(weight[i] * weight[j]) for i in range(n) for j in range(i + 1, n) if rank[i] > rank[j])
        assert rc.inversions(rank, weight) == want
        assert rc.inversions(rank, weight * (1 << 40)) == want << 80  # beyond a long


@pytest.mark.parametrize("levels", [3, 40, 10**6])
def test_tau_equals_all_pairs_over_many_parts(spark, levels):
    rng = np.random.default_rng(levels)
    rows = []
    for symbol, n in (("hot", 900), ("b", 50), (None, 20), ("one", 1), ("flat", 5)):
        x = rng.integers(0, levels, n).astype(float)
        y = np.round(x + rng.normal(0, levels / 3, n)) if symbol != "flat" else np.ones(n)
        rows += [(symbol, float(a), float(b)) for a, b in zip(x, y)]
    odd = [("hot", None, 1.0), ("b", 1.0, float("nan")), ("b", float("nan"), None), ("none", None, None)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.symbol: (r.n, r.tau) for r in rc.kendall(spark.createDataFrame(rows + odd, "symbol string, x double, y double").repartition(6), "x", "y").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(got) == {r[0] for r in rows}
    for s in got:
        x, y = (np.array([r[k] for r in rows if r[0] == s]) for k in (1, 2))
        want = brute(x, y)
        assert got[s][0] == len(x) and (got[s][1] is None if want is None else abs(got[s][1] - want) < 1e-12)


def test_no_rows(spark):
    assert rc.kendall(spark.createDataFrame([], "symbol string, x double, y double"), "x", "y").count() == 0

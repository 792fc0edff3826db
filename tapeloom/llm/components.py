"""Connected components of an edge table by alternating large-star and small-star steps, all in DataFrames.

Every step is a grouped minimum (combined before the shuffle) and a join back on the same key, which adaptive execution
splits if one node holds many edges. Links never reach the driver; it sees two numbers a round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .store import Scratch


def _mark(edges: DataFrame) -> tuple[int, int]:
    got = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
    return got["n"], got["x"]


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(a, b) long pairs -> (node, root), root the smallest node that can be reached; only nodes that have edges.

    Loops and nulls are dropped; repeated pairs don't matter; an empty table gives an empty table.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.cut(now, f"{tag}0")
    before, k = _mark(now), 0
    while before[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(low.select("a", F.col("m").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        k += 1
        now = scratch.cut(small, f"{tag}{k}")
        scratch.drop(f"{tag}{k - 1}")
        after = _mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n items under the links a-b, by minimum labels and pointer jumps."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new

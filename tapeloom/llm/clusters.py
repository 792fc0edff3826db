"""Centroid clustering of vectors in whole numbers: k-means rounds by Sort-means.

Components become integers, so distances, sums and means are exact and don't depend on how rows are dealt. Each round orders
the other centroids by their distance from each centroid. A vector begins at the centroid it had before and looks at the
others in that order; it stops at the first that lies strictly beyond twice its distance from where it began, for by the
triangle inequality none from there on can be nearer.

A round is one pass over the written vectors without a shuffle, which writes them again with their clusters, and one
grouped sum of k rows. Rounds that move no centroid are the last: all after them would be the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .store import Scratch
from .workers import in_arrow

ROWS = "vec_id long, v array<int>, cluster int, distance long"


def whole_numbers(df: DataFrame, dims: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<int>): floor(scale * x) of the vectors with exactly ``dims`` components, none null or non-finite.

    A vector with a component too large for squared distances to be longs (64 dimensions: beyond 2**17) is left out as well.
    """
    most = isqrt((1 << 62) // dims) // 2 // scale
    x: Column = F.col("embedding")
    fit = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float(most)))
    ints = F.transform(x, lambda c: F.floor(c.cast("double") * float(scale)).cast("int"))
    return df.where(x.isNotNull() & fit).select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:vec_id``; rows of one id go by their components, null ids come last."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    got = kept.select(rank.alias("rank"), "v").orderBy(F.col("rank").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in got], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    gap = x - c
    return np.einsum("ij,ij->i", gap, gap)


def orders(c: np.ndarray) -> tuple[list[list[int]], np.ndarray]:
    """For each centroid the others by distance from it, and of each pair the least squared distance of a vector from the first
    at which the second isn't strictly beyond twice that: a quarter of theirs, rounded up."""
    between = np.stack([squared(c, one) for one in c])
    order = [[q for q in np.lexsort((np.arange(len(c)), row)).tolist() if q != p] for p, row in enumerate(between)]
    return order, -(-between // 4)


def nearest(x: np.ndarray, was: np.ndarray, c: np.ndarray, order: list[list[int]], reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid (of equals the smaller number) and the squared distance of each row, from the cluster it was in."""
    found, distance = was.copy(), np.zeros(len(x), np.int64)
    for p in np.unique(was).tolist():
        rows = np.flatnonzero(was == p)
        y = x[rows]
        current = squared(y, c[p])
        low, at, live = current.copy(), np.full(len(rows), p), np.arange(len(rows))
        for q in order[p]:
            live = live[reach[p, q] <= current[live]]
            if not len(live):
                break
            d = squared(y[live], c[q])
            better = (d < low[live]) | ((d == low[live]) & (q < at[live]))
            low[live[better]], at[live[better]] = d[better], q
        found[rows], distance[rows] = at, low
    return found, distance


def assigned(rows: DataFrame, c: np.ndarray) -> DataFrame:
    """The rows (vec_id, v, cluster) with the clusters that follow from these centroids."""
    order, reach = orders(c)
    dims = c.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
                got, distance = nearest(x, batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64), c, order, reach)
                cols = [batch.column(0), batch.column(1), pa.array(got, pa.int32()), pa.array(distance, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "v", "cluster", "distance"])

    return in_arrow(rows.select("vec_id", "v", "cluster"), run, ROWS)


def moved(rows: DataFrame, c: np.ndarray) -> np.ndarray:
    """Each centroid's vectors' floor(sum / count) by component; one without vectors stays.

    Sums are longs: with the largest components they hold for 2**36 vectors a cluster, beyond which Spark raises an error.
    """
    sums = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(c.shape[1])]
    out = c.copy()
    for r in rows.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # at most a row a centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(c.shape[1])]
    return out


def fit(df: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, v, cluster, distance), centroids) of the vectors in ``embedding``; ``distance`` is the squared one.

    Vectors that ``whole_numbers`` leaves out have no row; rows that repeat have one each, null ids too. With fewer vectors
    than k there are so many centroids; without any the table is empty. Other columns of ``df`` aren't touched.
    """
    spark = df.sparkSession
    scratch, kept = Scratch(spark, "clusters"), whole_numbers(df, dims, scale)
    c = first_centroids(kept, k, seed)
    if not len(c):
        return spark.createDataFrame([], ROWS), c
    rows = kept.withColumn("cluster", F.lit(0))
    for r in range(rounds):
        rows = scratch.cut(assigned(rows, c), f"round{r}")
        if r:
            scratch.drop(f"round{r - 1}")
        now = moved(rows, c)
        if np.array_equal(now, c):
            return rows, c
        c = now
    return scratch.cut(assigned(rows, c), "last"), c


def clustered(df: DataFrame, **how) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): ``fit`` with the sums of squared distances, over
    the cluster and over all (null where a sum is no long), and the digest of the cluster's centroid."""
    rows, c = fit(df, **how)
    total = F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")
    sums = {r["cluster"]: int(r["total"]) for r in rows.groupBy("cluster").agg(total).collect()}  # at most a row a centroid
    of_all = sum(sums.values())
    known = lambda n: n if n < 1 << 63 else None
    tell = [(i, known(n), known(of_all), hashlib.sha256(",".join(map(str, c[i].tolist())).encode()).hexdigest()) for i, n in sums.items()]
    told = df.sparkSession.createDataFrame(tell, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.drop("v").join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

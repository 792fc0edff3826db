"""Kendall's rank correlation of whole series, of any length, by counting inversions over range partitions.

Points that repeat become one with a weight. In the order of (x, y) and in that of (y, x), a pair is discordant if the two
orders disagree. Points are dealt by range in the first order and in the second one, and a pair is counted once:

* both in one part of the first order: in that part's task, bit by bit of the ranks;
* in one part of the second order, but not of the first: in that part's task, all pairs but those counted already;
* in different parts of both: from the table of weights by both parts, by prefix sums.

No task holds more than a part, and no table more than parts times parts of one key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tapeloom.functions.scratch import Scratch


def _whole(weights: np.ndarray) -> np.ndarray:
    """Weights in a type that holds the products of their sums."""
    return weights.astype(object) if float(weights.sum()) >= 2**31 else weights.astype(np.int64)


def inversions(rank: np.ndarray, weight: np.ndarray) -> int:
    """The weight of all pairs of which the first has the higher rank; ranks are 0 to n - 1, each once."""
    n, weight, total = len(rank), _whole(weight), 0
    for bit in range(max(0, (n - 1).bit_length() - 1), -1, -1):
        # ranks that agree in the higher bits stand together, in the order they came in
        high = rank >> (bit + 1)
        one = (rank >> bit) & 1 == 1
        before = np.cumsum(np.where(one, weight, 0))
        first = np.flatnonzero(np.r_[True, high[1:] != high[:-1]])
        start = np.concatenate([np.array([0], before.dtype), before])[first]
        ahead = before - np.repeat(start, np.diff(np.r_[first, n]))
        total += int((weight[~one] * ahead[~one]).sum())
        by = np.argsort(rank >> bit, kind="stable")
        rank, weight = rank[by], weight[by]
    return total


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """The place of each point in the order of these keys, the first being the one that decides."""
    by = np.lexsort(keys[::-1])
    out = np.empty(len(by), np.int64)
    out[by] = np.arange(len(by))
    return out


def _in_order(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> int:
    by = np.lexsort((y, x))
    return inversions(_ranks(y, x)[by], weight[by])


def _columns(part: pa.Table) -> tuple[np.ndarray, ...]:
    return tuple(part.column(c).to_numpy() for c in ("x", "y", "c"))


def _told(part: pa.Table, n: int) -> pa.Table:
    return pa.table({"k": part.column("k").slice(0, 1), "d": pa.array([str(n)])})


def _first_order(part: pa.Table) -> pa.Table:
    return _told(part, _in_order(*_columns(part)))


def _second_order(part: pa.Table) -> pa.Table:
    (x, y, weight), own = _columns(part), part.column("pa").to_numpy()
    by = np.argsort(own, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(own[by]) != 0, True])
    counted = sum(_in_order(x[s], y[s], weight[s]) for s in (by[a:b] for a, b in zip(cuts, cuts[1:])))
    return _told(part, _in_order(x, y, weight) - counted)


def _apart(cells: pa.Table) -> pa.Table:
    """Pairs in different parts of both orders: the second lies in a later part of the first order, an earlier of the second."""
    (_, i), (_, j) = (np.unique(cells.column(c).to_numpy(), return_inverse=True) for c in ("pa", "pb"))
    weight = _whole(cells.column("c").to_numpy())
    table = np.zeros((i.max() + 1, j.max() + 1), weight.dtype)
    table[i, j] = weight
    later = np.cumsum(table[::-1], axis=0)[::-1]  # from this part of the first order on
    later = np.concatenate([later[1:], np.zeros((1, table.shape[1]), table.dtype)])
    earlier = np.cumsum(later, axis=1) - later  # ... and in earlier parts of the second
    return _told(cells, int((table * earlier).sum()))


def kendall(rows: DataFrame, x: str, y: str, by: str = "symbol") -> DataFrame:
    """(by, n, tau): Kendall's tau-b of two columns over all rows of each key in which neither is missing.

    tau is null where a column is constant or there are fewer than two rows. Rows that repeat are points of their own in the
    count. A null key is a key. An empty table gives no rows.
    """
    scratch = Scratch(rows.sparkSession, "kendall")
    both = rows.select(F.col(by).alias("k"), *(F.col(c).cast("double").alias(a) for c, a in ((x, "x"), (y, "y")))).where("x = x AND y = y AND NOT isnan(x) AND NOT isnan(y)")
    points = both.groupBy("k", "x", "y").agg(F.count("*").alias("c")).repartitionByRange("k", "x", "y")
    points = scratch.cut(points.withColumn("pa", F.spark_partition_id()), "first")
    points = scratch.cut(points.repartitionByRange("k", "y", "x").withColumn("pb", F.spark_partition_id()), "second")
    kind = f"k {points.schema['k'].dataType.simpleString()}, d string"
    found = points.groupBy("k", "pa").applyInArrow(_first_order, kind)
    found = found.union(points.groupBy("k", "pb").applyInArrow(_second_order, kind))
    found = found.union(points.groupBy("k", "pa", "pb").agg(F.sum("c").alias("c")).groupBy("k").applyInArrow(_apart, kind))
    crossed = found.groupBy("k").agg(F.sum(F.col("d").cast("decimal(38,0)")).cast("double").alias("d"))

    def tied(*keys: str) -> DataFrame:
        n = F.sum("c").cast("double")
        same = points.groupBy("k", *keys).agg((n * (n - 1) / 2).alias("t"), F.sum("c").alias("c"))
        return same.groupBy("k").agg(F.sum("t").alias(f"t{''.join(keys)}"), *([F.sum("c").alias("n")] if len(keys) == 2 else []))

    got = crossed
    for part in (tied("x"), tied("y"), tied("x", "y")):  # a row a key
        got = got.withColumnRenamed("k", "k0").join(part, F.col("k0").eqNullSafe(F.col("k"))).drop("k0")
    pairs = F.col("n").cast("double") * (F.col("n") - 1) / 2
    wide = F.sqrt((pairs - F.col("tx")) * (pairs - F.col("ty")))
    return got.select(F.col("k").alias(by), "n", F.try_divide(pairs - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.col("d"), wide).alias("tau"))

"""Embedding near-dedup by passes over vectors sorted by the signs of random projections.

Equal vectors become one class with a count first. Each pass orders the classes by the signs of a few random projections and
compares all rows of a run with equal signs; a long run is dealt over pairs of blocks. A pair meets in a pass with a chance
that only its angle and the number of signs decide, whatever stands around it, so the passes follow from the signs alone and
a dense group costs time but no links. The number of signs is the one that a sample of the table finds cheapest; none means
that all pairs are compared.

The passes carry a sketch of each vector, a byte a component, whose distance from the vector is known; a pair whose sketches
allow the cosine asked for is a candidate, so no near pair that meets is missed. Candidates are united inside the task, so a
task emits fewer rows than it has, and the unions of all passes are joined to components. The vectors themselves go once, to
their component, where all pairs are compared in double precision: that gives the exact numbers of links and the components
of the verified links alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from .components import components, local_roots
from .store import Scratch
from .workers import in_arrow, parts


def unit(cells: list | np.ndarray, dim: int) -> np.ndarray:
    x = np.array(cells, np.float64).reshape(len(cells), dim)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def matrix(vec: pa.Array, dim: int) -> np.ndarray:
    """Lists of one length as rows of unit length."""
    return unit(vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), dim), dim)


def sketched(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a signed byte a component, step, distance) of unit vectors: x lies within the distance of step * bytes."""
    step = np.abs(x).max(axis=1) / 127
    q = np.rint(x / step[:, None]).astype(np.int8)
    off = x - q * step[:, None]
    return q, step.astype(np.float32), (np.sqrt(np.einsum("ij,ij->i", off, off)) + 1e-6).astype(np.float32)


def allowed(q: np.ndarray, step: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices a, b: a[i] . b[j] is the most that the cosine of i and j can be, up to the product of their distances."""
    x = q.astype(np.float32) * step[:, None]
    one = np.ones((len(x), 1), np.float32)
    return np.hstack([x, off[:, None], one]), np.hstack([x, one, off[:, None]])


def passes_for(signs: int, cosine: float, missed: float = 1e-4) -> int:
    """Passes after which a pair at the bound itself, which has equal signs in one with a known chance, is missed with
    probability ``missed``; pairs above the bound are missed less often."""
    meet = (1 - np.arccos(cosine) / np.pi) ** signs
    return 1 if meet == 1 else max(1, ceil(log(missed) / np.log1p(-meet)))


#: seconds a row takes in a pass, and a number of a pair; both only weigh the depths against each other
ROW_S, PAIR_S = 4e-5, 1e-10


def signs_for(keys: np.ndarray, dims: np.ndarray, n: int, cosine: float, block: int, deepest: int) -> int:
    """The number of leading signs that costs least for n rows of which a sample has ``keys`` (a row for each pilot pass)."""
    best, least = 0, float("inf")
    for depth in range(deepest + 1):
        pairs = 0.0
        for one in keys:
            sizes = np.unique(np.stack([one >> (deepest - depth), dims]), axis=1, return_counts=True)[1].astype(float)
            pairs += (sizes * (sizes - 1)).sum() / 2 * (n / len(dims)) ** 2 / len(keys)
        rows = n + 2 * pairs / block  # copies of rows for the pairs of blocks
        cost = passes_for(depth, cosine) * (rows * ROW_S + pairs * float(np.mean(dims)) * PAIR_S)
        if cost < least:
            best, least = depth, cost
    return best


def _hashed(first: int, passes: int, signs: int, seed: int, sketch: bool):
    """(pass, dim, run[, cid, q, step, off]) of rows (cid, vec) for the passes from ``first`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.int64(1) << np.arange(signs - 1, -1, -1, dtype=np.int64)
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in parts(batches, 4096):
            cid, vec = batch.column(0), batch.column(1)
            dims = vec.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                rows = pa.array(np.flatnonzero(dims == dim))
                x = matrix(vec.take(rows), dim)
                if sketch:
                    q, step, off = sketched(x)
                    own = [cid.take(rows), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(step), pa.array(off)]
                for p in range(first, first + passes):
                    if (p, dim) not in planes:
                        planes[p, dim] = np.random.default_rng((seed, dim, p)).standard_normal((dim, signs))
                    key = ((x @ planes[p, dim]) > 0) @ weight
                    cols = [pa.array(np.full(len(x), p, np.int32)), pa.array(np.full(len(x), dim, np.int32)), pa.array(key.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols + own if sketch else cols, names=["pass", "dim", "run", "cid", "q", "step", "off"][: 7 if sketch else 3])

    return run


BARE = "pass int, dim int, run long"


def chosen_signs(classes: DataFrame, n: int, cosine: float, block: int, deepest: int = 40, sample: int = 20_000, pilots: int = 3, seed: int = 11) -> int:
    """The signs that cost least, by the runs that about ``sample`` rows make in a few passes."""
    some = classes.select("cid", "vec").where(F.pmod(F.xxhash64("cid"), F.lit(max(1, n // sample))) == 0)
    got = in_arrow(some, _hashed(0, pilots, deepest, seed, False), BARE).toPandas()
    if not len(got):
        return 0
    by = [got[got["pass"] == p].sort_values(["dim", "run"]) for p in range(pilots)]
    return signs_for(np.stack([g["run"].to_numpy() for g in by]), by[0]["dim"].to_numpy(), n, cosine, block, deepest)


def _grouped(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows that come ordered by the integer columns ``names``, as one table for each of their values."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
        starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(keys[:, a].tolist())
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


def _in_blocks(rows: DataFrame, key: list[str], counts: DataFrame, block: int, scratch: Scratch, tag: str, least: int | None = None) -> DataFrame:
    """``rows`` with i, j and own: groups of over ``block`` rows are dealt over the pairs i <= j of their blocks, and each row
    of block own goes to all pairs that hold it; ``counts``: (key, size) of the groups. With ``least``, groups of over so many
    are dealt too, over up to eight blocks, so that a few middling groups don't keep one task busy."""
    least = least or block
    rows_of = F.least(F.lit(block), F.greatest(F.lit(least), F.ceil(F.col("size") / 8)))
    large = scratch.cut(counts.where(F.col("size") > least).select(*key, F.ceil(F.col("size") / rows_of).cast("int").alias("blocks")), tag)
    sized = rows.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    sized = sized.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = sized.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"i": F.least("own", "k"), "j": F.greatest("own", "k")}).drop("k")


def pair_links(classes: DataFrame, scratch: Scratch, cosine: float, signs: int | None = None, block: int = 2048, seed: int = 11, together: int = 6) -> DataFrame:
    """(a, b): rows of ``classes`` (cid long, vec array without nulls or zeros) united with one of their candidates.

    ``together``: passes of one job; the shuffle of a job is gone before the next one's is written.
    """
    n = classes.count()
    if signs is None:
        signs = chosen_signs(classes, n, cosine, block, seed=seed)
    named, key = classes.select("cid", "vec"), ["pass", "dim", "run"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, dim, _, i, j), table in _grouped(batches, (*key, "i", "j")):
            own = table["own"].to_numpy()
            order = np.argsort(own != i, kind="stable")
            cid, step, off = (table[c].to_numpy()[order] for c in ("cid", "step", "off"))
            q = np.frombuffer(b"".join(table["q"].to_pylist()), np.int8).reshape(-1, dim)[order]
            left, right = allowed(q, step, off)
            size, bound = len(cid), cosine - float(off.max()) ** 2 - 1e-5
            cut = size if i == j else int((own == i).sum())
            root, every = np.arange(size), np.arange(size)
            for at in range(0, cut, 512):
                begin = at if i == j else cut
                a, b = np.nonzero(left[at : min(at + 512, cut)] @ right[begin:].T >= bound)
                root = local_roots(size, np.concatenate([every, a + at]), np.concatenate([root, b + begin]))
            to = np.flatnonzero(root != every)
            yield pa.RecordBatch.from_arrays([pa.array(cid[to]), pa.array(cid[root[to]])], names=["a", "b"])

    n_parts, order = int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), [*key, "i", "j"]
    passes, found = passes_for(signs, cosine), None
    for first in range(0, passes, together):
        some = min(together, passes - first)
        counts = in_arrow(named, _hashed(first, some, signs, seed, False), BARE).groupBy(*key).agg(F.count("*").alias("size"))
        rows = in_arrow(named, _hashed(first, some, signs, seed, True), f"{BARE}, cid long, q binary, step float, off float")
        dealt = _in_blocks(rows, key, counts, block, scratch, f"runs{first}").repartition(n_parts, *order).sortWithinPartitions(*order)
        links = scratch.cut(in_arrow(dealt, compare, "a long, b long"), f"links{first}")
        found = links if found is None else found.union(links)
    return found


def verified(members: DataFrame, scratch: Scratch, cosine: float, block: int = 4096, least: int = 256, together: int = 512) -> DataFrame:
    """(cid, near, root) of ``members`` (comp, cid, vec, n: copies), components of candidates.

    near: copies of all rows of its component, itself included, whose cosine is at least ``cosine``; root: the smallest cid
    that links reach. A component of over ``least`` rows is compared by pairs of blocks, small ones many at a time.
    """
    n_parts, order = int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), ["comp", "i", "j"]
    dealt = _in_blocks(members, ["comp"], members.groupBy("comp").agg(F.count("*").alias("size")), block, scratch, "comps", min(block, least))
    dealt = dealt.withColumn("dim", F.size("vec")).repartition(n_parts, *order).sortWithinPartitions(*order)

    def linked(table: pa.Table, i: int, j: int) -> pa.RecordBatch:
        own, comp, dims = (table[c].to_numpy() for c in ("own", "comp", "dim"))
        order = np.argsort(own != i, kind="stable")
        cid, n, comp, dims = (x[order] for x in (table["cid"].to_numpy(), table["n"].to_numpy(), comp, dims))
        vec = table["vec"].combine_chunks().take(pa.array(order))
        size, cut = len(cid), len(cid) if i == j else int((own == i).sum())
        near, root, every = np.zeros(size, np.int64), np.arange(size), np.arange(size)
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            x = matrix(vec.take(pa.array(rows)), dim)
            begin = 0 if i == j else int(np.searchsorted(rows, cut))
            for at in range(0, len(rows) if i == j else begin, 512):
                to = slice(at, at + 512 if i == j else min(at + 512, begin))
                met = (x[to] @ x[begin:].T >= cosine) & (comp[rows[to], None] == comp[rows[begin:]][None, :])
                near[rows[to]] += met @ n[rows[begin:]]
                if i != j:
                    near[rows[begin:]] += n[rows[to]] @ met
                a, b = np.nonzero(met)
                root = local_roots(size, np.concatenate([every, rows[to][a]]), np.concatenate([root, rows[begin:][b]]))
        low = np.full(size, np.iinfo(np.int64).max)
        np.minimum.at(low, root, cid)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (cid, near, low[root], np.full(size, i != j or bool(table["blocks"][0].as_py() > 1)))], names=["cid", "near", "root", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for (_, i, j), table in _grouped(batches, tuple(order)):
            if table["blocks"][0].as_py() > 1:
                yield linked(table, i, j)
                continue
            held.append(table)
            if sum(t.num_rows for t in held) >= together:
                yield linked(pa.concat_tables(held), 0, 0)
                held = []
        if held:
            yield linked(pa.concat_tables(held), 0, 0)

    got = scratch.cut(in_arrow(dealt, run, "cid long, near long, root long, part boolean"), "verified")
    whole, pieces = got.where("not part").select("cid", "near", "root"), got.where("part")
    if pieces.isEmpty():
        return whole
    roots = components(pieces.select(F.col("cid").alias("a"), F.col("root").alias("b")), scratch, "exact").withColumnRenamed("root", "low")
    summed = pieces.groupBy("cid").agg(F.sum("near").alias("near")).join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    return whole.union(summed.select("cid", "near", F.coalesce("low", "cid").alias("root")))


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, signs: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding array; others are ignored).

    A vector that is null, empty or zero, or has null or non-finite components, links with nothing. Vectors of different
    lengths don't link. Repeated rows are copies like any other, and copies are told by two 64-bit hashes. Rows whose vec_id
    is null take part and are never kept. A pair at the bound itself counts. An empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    v = F.col("embedding")
    sound = F.coalesce(F.size(v) > 0, F.lit(False)) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    rows = rows.withColumn("vec", F.when(F.coalesce(sound, F.lit(False)), v))
    hashes = {f"h{k}": F.when(F.col("vec").isNotNull(), F.xxhash64(F.lit(k), "vec")) for k in (1, 2)}
    rows = rows.select("vec_id", "vec").withColumns(hashes)
    classes = rows.where("vec is not null").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), F.first("vec").alias("vec"))
    classes = scratch.cut(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    roots = components(pair_links(classes, scratch, cosine, signs), scratch)
    members = scratch.cut(classes.select("cid", "vec", "n").join(roots.select(F.col("node").alias("cid"), F.col("root").alias("comp")), "cid"), "members")
    told = verified(members, scratch, cosine)
    bare = classes.select("h1", "h2", "cid", "n", "low").join(told, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    bare = scratch.cut(bare.withColumn("n_links", F.coalesce("near", "n") - 1), "bare")
    lows = bare.groupBy("root").agg(F.min("low").alias("component_id"))
    done = scratch.cut(bare.join(lows, "root").select("h1", "h2", "n_links", "component_id"), "done")
    out = rows.select("vec_id", "h1", "h2").join(done, ["h1", "h2"], "left")
    component = F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if some value lies within r bits of both. Every fingerprint therefore
emits all values within r bits (2,081 for 64 bits and r = 2); whoever meets on a value is linked.

The values are dealt in two steps. The leading bits of a value are its shuffle key, so a fingerprint is sent once to each
leading part within r flips and not 2,081 times; the flips that are left are spelled out inside the task. A leading part
that holds too many fingerprints is divided further by a linear checksum of the whole value: a fingerprint is sent to those
classes that some of its flips lead to, and each class spells out only these. There are as many classes as the part needs,
so no part stays large, and no fingerprint is sent more often than it has values. Those that meet on a value are linked to
one of them, not to each other (all of them lie within 2r bits by the triangle inequality, and each link is verified), so a
group of n emits n links.

``one_of_each`` also takes such balls around fingerprints of word pairs to find candidates of a similarity by shingles, which
it verifies on the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import components, local_roots
from .store import Scratch
from .workers import in_arrow, parts, quoted

BITS = 64
CHECK = 24  # bits of the checksum: the most classes of a leading part are 2 to this power


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42, block: int = 1 << 16) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a UTF-8 text; zero if it has no words or is null."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    last = max(1, len(words) - shingle + 1)
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, last, block):
        part = words[at : min(at + block, last) + shingle - 1]
        joined, ends, end = b" ".join(part), [], -1
        for w in part:
            end += len(w) + 1
            ends.append(end)
        starts = [0, *(e + 1 for e in ends[:-1])]
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[min(shingle, len(part)) - 1 :])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > last, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            fp = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text")), run, "doc_id long, fp long")


def flips(bits: int, most: int) -> list[np.ndarray]:
    """For each budget 0..most: the masks with at most so many of the low ``bits`` bits set."""
    out, so_far = [], []
    for k in range(most + 1):
        so_far += [sum(1 << i for i in c) for c in combinations(range(bits), k)]
        out.append(np.array(so_far, np.uint64))
    return out


def _labels() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << CHECK, BITS, dtype=np.uint64)


def checksum(v: np.ndarray) -> np.ndarray:
    """Linear checksum of ``CHECK`` bits: the labels of the set bits, added without carry."""
    out = np.zeros(len(v), np.uint64)
    for i, label in enumerate(_labels()):
        out ^= ((v >> np.uint64(i)) & np.uint64(1)) * label
    return out


def reached(base: np.ndarray, sums: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, class) of the classes, of ``many``, that the flips with these checksums lead each value to."""
    mask = np.uint64(many - 1)
    own = checksum(base) & mask
    if many <= 64:  # nearly all are reached
        return np.repeat(np.arange(len(base)), many), np.tile(np.arange(many, dtype=np.int64), len(base))
    offsets = np.unique(sums & mask)
    return np.repeat(np.arange(len(base)), len(offsets)), (own[:, None] ^ offsets[None, :]).ravel().astype(np.int64)


def links(distinct: DataFrame, scratch: Scratch, distance: int = 4, room: int = 2048, together: int = 1_500_000) -> DataFrame:
    """(a, b): links between fingerprints (column fp, no repeats) whose components are those of all pairs within ``distance``.

    ``room``: a leading part with more fingerprints is divided by the checksum; ``together``: values spelled out at once.
    """
    half, odd = (distance + 1) // 2, distance % 2
    n = distinct.count()
    lead = min(40, max(10, ceil(log2(max(n, 1) / 200 + 1))))
    low = BITS - lead
    top = F.shiftrightunsigned("fp", low)
    least = max(room, n // 100_000)  # at most 100,000 leading parts can be hot, so this list stays small
    hot = {r["top"]: min(1 << CHECK, 1 << ceil(log2(r["n"] / room))) for r in distinct.groupBy(top.alias("top")).agg(F.count("*").alias("n")).where(F.col("n") > least).collect()}
    masks = flips(lead, half)[half]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.bitwise_count(masks).astype(np.int8)
        sums_low = [checksum(m) for m in flips_low]
        for batch in batches:
            all_fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            step = 256 if hot else 4096
            for at in range(0, len(all_fp), step):
                fp = all_fp[at : at + step]
                key = ((fp >> np.uint64(low))[:, None] ^ masks[None, :]).ravel()
                own, r = np.repeat(fp, len(masks)), np.tile(used, len(fp))
                many = np.array([hot.get(k, 1) for k in key.tolist()]) if hot else np.ones(len(key), np.int64)
                rep, cls = [np.flatnonzero(many == 1)], [np.zeros(int((many == 1).sum()), np.int64)]
                for m in np.unique(many[many > 1]).tolist():
                    for spent in range(half + 1):
                        rows = np.flatnonzero((many == m) & (r == spent))
                        base = (own[rows] & np.uint64((1 << low) - 1)) | (key[rows] << np.uint64(low))
                        which, c = reached(base, sums_low[half - spent], m)
                        rep.append(rows[which])
                        cls.append(c)
                rep, cls = np.concatenate(rep), np.concatenate(cls)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[rep].view(np.int64)), pa.array(cls.astype(np.int32)), pa.array(many[rep].astype(np.int32)), pa.array(own[rep].view(np.int64)), pa.array(r[rep])],
                    names=["key", "cls", "many", "fp", "r"],
                )

    def spelled(base: np.ndarray, r: np.ndarray, owner: np.ndarray, many: int, cls: np.ndarray) -> tuple[list, list]:
        """The values that rows with ``r`` flips spent still reach below their leading part, and their owners."""
        values, owners = [], []
        for used in range(half + 1):
            rows = np.flatnonzero(r == used)
            m = flips_low[half - used]
            if many == 1:
                values.append((base[rows][:, None] ^ m[None, :]).ravel())
                owners.append(np.repeat(owner[rows], len(m)))
                continue
            # the flips whose checksum is what a row lacks to the class
            mask = np.uint64(many - 1)
            want, sums = (checksum(base[rows]) ^ cls[rows].astype(np.uint64)) & mask, checksum(m) & mask
            order = np.argsort(sums, kind="stable")
            first, last = (np.searchsorted(sums[order], want, side) for side in ("left", "right"))
            n = last - first
            at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            values.append(np.repeat(base[rows], n) ^ m[order[at]])
            owners.append(np.repeat(owner[rows], n))
        return values, owners

    def met(key: np.ndarray, cls: np.ndarray, many: np.ndarray, x: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
        fp, owner = np.unique(x, return_inverse=True)
        owner = owner.astype(np.int32)
        base = (x & np.uint64((1 << low) - 1)) | (key << np.uint64(low))
        values, owners = [], []
        for m in np.unique(many).tolist():
            rows = many == m
            more = spelled(base[rows], r[rows], owner[rows], m, cls[rows])
            values += more[0]
            owners += more[1]
        v, o = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(v)
        v, o = v[order], o[order]
        same = np.flatnonzero(v[1:] == v[:-1])
        pair = np.unique(np.minimum(o[same], o[same + 1]).astype(np.int64) * len(fp) + np.maximum(o[same], o[same + 1]))
        a, b = pair // len(fp), pair % len(fp)
        good = (a != b) & (np.bitwise_count(fp[a] ^ fp[b]) <= distance)
        root = local_roots(len(fp), a[good], b[good])
        to = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[to].view(np.int64)), pa.array(fp[root[to]].view(np.int64))], names=["a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by key and class; as many keys as fit are spelled out together."""
        held: list[list[np.ndarray]] = []
        weight = np.array([len(flips_low[half - used]) for used in range(half + 1)])

        def work() -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*held)]
            held.clear()
            return met(*cols)

        total = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, cls, many, x, r = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cols = [key.view(np.uint64), cls, many, x.view(np.uint64), r]
            new = np.r_[True, (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])]
            if held and (held[-1][0][-1] == cols[0][0]) and held[-1][1][-1] == cls[0]:
                new[0] = False
            cost = np.cumsum(weight[r] // many + 1)
            done = 0
            for at in np.flatnonzero(new).tolist():
                if total + cost[at] - (cost[done - 1] if done else 0) > together and (held or at > done):
                    if at > done:
                        held.append([c[done:at] for c in cols])
                    yield work()
                    done, total = at, 0
            held.append([c[done:] for c in cols])
            total += int(cost[-1] - (cost[done - 1] if done else 0))
        if held:
            yield work()

    flips_low = flips(low, half)
    if odd:
        raise ValueError("distance must be even: half of it is the radius of the balls")
    dealt = in_arrow(distinct.select("fp"), deal, "key long, cls int, many int, fp long, r byte")
    spread = dealt.repartition(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), "key", "cls")
    return scratch.cut(in_arrow(spread.sortWithinPartitions("key", "cls"), meet, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of ``docs`` (doc_id, text; other columns are ignored).

    Null and wordless texts have fingerprint zero and link like any other. Repeated rows give repeated rows. Rows whose
    doc_id is null take part; component_id is the smallest doc_id that isn't null, or null if there is none. Very long texts
    are read in blocks of words; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.cut(fingerprints(docs, shingle, seed), "fps")
    distinct = scratch.cut(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(links(distinct, scratch, distance), scratch)
    known = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = known.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = scratch.cut(known.join(named, "root").select("fp", "component_id"), "classes")
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: word pairs are hashed once; each of these turns the hashes into another family of fingerprints
FAMILIES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def pair_fingerprints(text: bytes | None, block: int = 1 << 16) -> list[int]:
    """A fingerprint of the word pairs of a text for each family: an edit touches two pairs but four or five longer shingles, so
    these lie nearer to each other than fingerprints of shingles do."""
    words = (text or b"").lower().split()
    last = max(1, len(words) - 1) if words else 0
    ones, digest = np.zeros((len(FAMILIES), BITS), np.int64), xxhash.xxh64_intdigest
    for at in range(0, last, block):
        part = words[at : min(at + block, last) + 1]
        h = np.array([digest(b" ".join(p)) for p in zip(part, part[1:])] or [digest(part[0])], np.uint64)
        for k, by in enumerate(FAMILIES):
            m = (h ^ np.uint64(by)) * np.uint64(0xBF58476D1CE4E5B9)
            m = (m ^ (m >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            ones[k] += np.unpackbits((m ^ (m >> np.uint64(32))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return [int.from_bytes(np.packbits(2 * o > last, bitorder="little").tobytes(), "little") for o in ones]


def shingles(text: bytes | None, n: int = 5) -> set[bytes]:
    words = (text or b"").lower().split()
    return {b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def alike(a: bytes | None, b: bytes | None, similar: float = 0.8, n: int = 5) -> bool:
    """Whether the sets of ``n``-word shingles of two texts have at least this share of their union in common."""
    x, y = shingles(a, n), shingles(b, n)
    return bool(x or y) and len(x & y) >= similar * len(x | y)


KEY = ("own id", "text hash")


def one_of_each(docs: DataFrame, distance: int = 4, similar: float | None = 0.8) -> DataFrame:
    """One row of ``docs`` (doc_id, text and others) for each group: that with the smallest doc_id, then the smallest hash of
    its text; rows without a doc_id come last. Rows that share a doc_id are judged each by its own text; rows alike in both
    are one row. Null and wordless texts are one group; an empty table stays empty.

    A group is what links of fingerprints within ``distance`` bits connect. With ``similar``, so are the rows left over by
    links of texts of which at least this share of the five-word shingles is common: candidates are rows whose word pairs'
    fingerprints lie within ``distance`` bits in some family, and each is verified on the texts.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    told = docs.withColumn(KEY[0], F.col("doc_id").cast("long")).withColumn(KEY[1], F.xxhash64("text"))
    extra = [f"pairs{k}" for k in range(len(FAMILIES))] if similar is not None else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            texts = [t.as_py() for t in b.column(2)]
            fps = [[fingerprint(t) for t in texts], *zip(*(pair_fingerprints(t) for t in texts if extra))]
            cols = [pa.array(np.array(f, np.uint64).view(np.int64)) for f in fps[: 1 + len(extra)]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=[*KEY, "fp", *extra])

    kinds = ", ".join([f"`{KEY[0]}` long, `{KEY[1]}` long, fp long", *(f"{c} long" for c in extra)])
    fps = in_arrow(told.select(*KEY, F.encode("text", "UTF-8").alias("text")), run, kinds)
    place = F.struct(F.col(KEY[0]).isNull().alias("without"), *(F.col(k) for k in KEY), *extra)
    distinct = scratch.cut(fps.groupBy("fp").agg(F.min(place).alias("k")), "distinct")
    roots = components(links(distinct, scratch, distance), scratch)
    known = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(F.coalesce("root", "fp").alias("root"), "k")
    first = known.groupBy("root").agg(F.min("k").alias("k"))
    chosen = scratch.cut(first.select(*(F.col(f"k.`{c}`").alias(c) for c in (*KEY, *extra))).withColumn("node", F.monotonically_increasing_id()), "chosen")
    if similar is not None:
        chosen = _without_alike(chosen, told, scratch, extra, distance, similar)
    kept = chosen.select(F.col(KEY[0]).alias("keep id"), F.col(KEY[1]).alias("keep hash"))
    same = told[KEY[0]].eqNullSafe(kept["keep id"]) & (told[KEY[1]] == kept["keep hash"])
    return told.join(kept, same, "left_semi").dropDuplicates(list(KEY)).select(*quoted(docs.columns))


def _without_alike(rows: DataFrame, told: DataFrame, scratch: Scratch, families: list[str], distance: int, similar: float) -> DataFrame:
    """``rows`` (the key, fingerprints of the families, node) without those that are alike to one that comes before them."""
    held = rows.select("node", F.explode(F.array(*families)).alias("fp"))
    by_fp = scratch.cut(held.groupBy("fp").agg(F.min("node").alias("low")), "pair fps")
    near = links(by_fp.select("fp"), scratch, distance)
    low = lambda c: by_fp.select(F.col("fp").alias(c), F.col("low").alias(f"low {c}"))
    across = near.join(low("a"), "a").join(low("b"), "b").select(F.col("low a").alias("a"), F.col("low b").alias("b"))
    within = held.join(by_fp, "fp").select(F.col("node").alias("a"), F.col("low").alias("b"))
    pairs = across.union(within).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = scratch.cut(pairs, "candidates")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = rows.join(asked, "node").select("node", F.col(KEY[0]).alias("ask id"), F.col(KEY[1]).alias("ask hash"))
    same = told[KEY[0]].eqNullSafe(F.col("ask id")) & (told[KEY[1]] == F.col("ask hash"))
    texts = told.select(*KEY, F.encode("text", "UTF-8").alias("words")).join(wanted, same).select("node", "words").dropDuplicates(["node"])
    texts = scratch.cut(texts, "texts")
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("words").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("words").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            good = pa.array([alike(x.as_py(), y.as_py(), similar) for x, y in zip(b.column(2), b.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(good)

    sure = scratch.cut(in_arrow(both.select("a", "b", "x", "y"), run, "a long, b long"), "alike")
    roots = components(sure, scratch, "alike")
    named = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    place = F.struct(F.col(KEY[0]).isNull().alias("without"), *(F.col(k) for k in KEY))
    return scratch.cut(named.groupBy("root").agg(F.min(place).alias("k")).select(*(F.col(f"k.`{c}`").alias(c) for c in KEY)), "left")

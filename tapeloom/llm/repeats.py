"""Repeated byte strings, found by suffix sorting (see ``grouping``) of the places where it can matter.

A string of ``size`` bytes that also starts elsewhere is found wherever it stands, across all documents, exactly:

1. Every window of ``size`` bytes has an anchor, the place of the least hash of its grams (``Shape.gram`` bytes), and lies
   at some distance from it. Windows of one anchor whose distances fall into the same stretch share a core of bytes;
   together they make one block, whose key is the hash of the core. Equal windows have equal cores, so they meet under one key.
2. Counts by key drop the blocks whose core stands nowhere else. Where all blocks of a key are equal as a whole, each of
   their windows is repeated.
3. What is left are the edges of repeated passages. One block of each kind is fetched, its core put down as a single
   symbol, and the suffixes of all blocks are sorted by Lyndon-prefix groups; equal windows are neighbours in that order.
4. A key with more than ``room`` different blocks is not sorted in one task: each of its windows becomes a key of its own,
   which needs a count only.

Blocks are told apart by two 64-bit hashes; a row goes by its doc_id and the 64-bit hash of its text (``ROW``).

All this takes words (runs of bytes other than ASCII white space) in place of bytes as well: each is a 64-bit hash up to
step 3, which numbers the words themselves and ranks the places of all blocks by prefixes of doubled length; the windows of
words left there all take equally many symbols, so that two ranks tell one from all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .grouping import suffix_array
from .store import Scratch
from .workers import in_arrow, parts, quoted

SLICE = 1 << 18
#: what a row goes by; rows that agree in both have one text and so the same repeats
ROW = ("own", "hash")


@dataclass(frozen=True)
class Shape:
    """How windows of ``size`` bytes make blocks: a smaller gram leaves more places for an anchor to serve, so there are
    fewer blocks; a smaller stretch leaves a longer core, so fewer blocks meet by chance."""

    size: int
    words: bool = False

    @property
    def gram(self) -> int:
        return max(1, min(64, self.size // 4))

    @property
    def width(self) -> int:
        """Grams of a window."""
        return self.size - self.gram + 1

    @property
    def stretch(self) -> int:
        return self.width if self.words else max(1, min(64, self.size // 2))

    def core(self, shape: int) -> tuple[int, int]:
        """(bytes before the core, bytes of the core) of a block."""
        lead, j = divmod(shape, 8)
        return lead, self.size - (min((j + 1) * self.stretch, self.width) - 1 - j * self.stretch)


_MULT = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        for name, x in (("up", _MULT), ("down", pow(_MULT, -1, 1 << 64))):
            steps = np.full(n, x, np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
        _tables["byte"] = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)
    return _tables["up"], _tables["down"], _tables["byte"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    p = 1
    while 2 * p <= width:
        v, p = np.minimum(v[:-p], v[p:]), 2 * p
    return np.minimum(v[: p - width], v[width - p :]) if p < width else v


def blocks(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, cut: Shape) -> dict[str, np.ndarray]:
    """Blocks of the texts data[begins[i]:ends[i]], which follow one another, as bytes or as hashes of words: text, start,
    windows, shape, key, ctx, copies."""
    n, size, width, gram_size, step = len(data), cut.size, cut.width, cut.gram, cut.stretch
    if n < size:
        return {k: np.zeros(0, np.int64) for k in ("text", "start", "windows", "shape", "key", "ctx", "copies")}
    up, down, byte = _powers(max(SLICE + 4 * size, n) + 2)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data if cut.words else byte[data]) * up[:n], out=total[1:])

    def hashed(a: np.ndarray | slice, b: np.ndarray | slice) -> np.ndarray:
        return _mixed((total[b] - total[a]) * down[:n][a])

    gram = hashed(slice(0, n - gram_size + 1), slice(gram_size, n + 1))
    gram = gram >> np.uint64(21) << np.uint64(21) | np.arange(len(gram), dtype=np.uint64)
    anchor = (_least(gram, width) & np.uint64((1 << 21) - 1)).astype(np.int64)
    start = np.arange(len(anchor))
    stretch = (anchor - start) // step
    text = np.repeat(np.arange(len(ends)), ends - begins)[: len(anchor)]
    fits = np.flatnonzero(start + size <= ends[text])
    if not len(fits):
        return blocks(data[:0], begins[:0], ends[:0], cut)
    kind = anchor[fits] * 16 + stretch[fits]
    new = np.flatnonzero((kind[1:] != kind[:-1]) | (np.diff(fits) != 1)) + 1
    first = np.r_[0, new]
    many = np.diff(np.r_[first, len(fits)])
    at = fits[first]
    j = stretch[at]
    lo = anchor[at] - j * step
    hi = anchor[at] - np.minimum((j + 1) * step, width) + 1 + size
    seed = (j.astype(np.uint64) + np.uint64(1)) * np.uint64(_MULT)
    key = hashed(lo, hi) ^ seed
    ctx = _mixed(hashed(at, at + many + size - 1) + ((lo - at) * 4096 + many).astype(np.uint64))
    # a text that repeats one letter has a block at each place: equal neighbours become one row
    own = text[at]
    change = np.r_[True, (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1]) | (own[1:] != own[:-1]) | (at[1:] != at[:-1] + many[:-1])]
    head = np.flatnonzero(change)
    copies = np.diff(np.r_[head, len(at)])
    windows = np.add.reduceat(many, head)
    return {"text": own[head], "start": at[head] - begins[own[head]], "windows": windows, "shape": (lo - at)[head] * 8 + j[head], "key": key[head].view(np.int64), "ctx": ctx[head].view(np.int64), "copies": copies}


def _slices(texts: pa.Array, size: int | None, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, begins, ends, text numbers, shift) of a binary column, without copying it: neighbouring texts together, long
    ones in overlapping parts, or each alone if ``size`` is None."""
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    _, at, raw = texts.buffers()
    if not len(texts) or raw is None:
        return
    at = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8)
    i, n = 0, len(texts)
    while i < n:
        if size is not None and at[i + 1] - at[i] > most:
            for begin in range(int(at[i]), int(at[i + 1]) - size + 1, most):
                part = data[begin : min(begin + most + size - 1, at[i + 1])]
                yield part, np.array([0]), np.array([len(part)]), np.array([i]), begin - int(at[i])
            i += 1
            continue
        e = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield data[at[i] : at[e]], at[i:e] - at[i], at[i + 1 : e + 1] - at[i], np.arange(i, e), 0
        i = e


_SPACE = np.isin(np.arange(256), list(b"\t\n\v\f\r "))


def _words(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of the texts data[begins[i]:ends[i]], which follow one another, and where they begin and end there."""
    n = len(data)
    up, down, byte = _powers(max(SLICE, n) + 2)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(byte[data] * up[:n], out=total[1:])
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[begins] = edge[ends] = True
    first = np.flatnonzero(inside & (edge[:-1] | ~np.r_[False, inside[:-1]]))
    last = np.flatnonzero(inside & (edge[1:] | ~np.r_[inside[1:], False])) + 1
    return _mixed((total[last] - total[first]) * down[first]), np.searchsorted(first, begins), np.searchsorted(first, ends)


def _long_words(data: np.ndarray, most: int) -> np.ndarray:
    """Hashes of the words of one text, read in parts of at most ``most`` bytes; a word beyond that is digested by itself."""
    out, begin, n = [], 0, len(data)
    whole = lambda part: _words(part, np.array([0]), np.array([len(part)]))[0]
    while begin < n:
        if n - begin <= most:
            end = n
        elif (gaps := np.flatnonzero(_SPACE[data[begin : begin + most]])).size:
            end = begin + int(gaps[-1]) + 1
        else:
            end = begin + most
            while end < n and not _SPACE[data[end : end + most]].any():
                end += most
            end = min(n, end + int(np.argmax(_SPACE[data[end : end + most]]))) if end < n else n
        if end - begin <= most:
            out.append(whole(data[begin:end]))
        else:
            out.append(np.frombuffer(hashlib.blake2b(data[begin:end].tobytes(), digest_size=8).digest(), np.uint64))
        begin = end
    return np.concatenate(out)


def _units(texts: pa.Array, cut: Shape, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """The slices of a binary column in bytes, or in words with begins, ends and shift counted in these."""
    if not cut.words:
        yield from _slices(texts, cut.size, most)
        return
    for data, begins, ends, names, _ in _slices(texts, None, most):
        if len(data) <= most:
            yield *_words(data, begins, ends), names, 0
            continue
        words = _long_words(data, most)
        for begin in range(0, len(words) - cut.size + 1, most):
            part = words[begin : begin + most + cut.size - 1]
            yield part, np.array([0]), np.array([len(part)]), names, begin


def _rows(cut: Shape, whole: bool):
    """Blocks of a batch (own, hash, text): only key and ctx, or everything."""
    most = SLICE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)]
            for data, begins, ends, names, shift in _units(batch.column(2), cut, most):
                b = blocks(data, begins, ends, cut)
                if whole:
                    cols = {c: x[names[b["text"]]] for c, x in zip(ROW, row)} | {"start": (b["start"] + shift).astype(np.int32), "windows": b["windows"].astype(np.int32), "shape": b["shape"].astype(np.int32), "key": b["key"], "ctx": b["ctx"], "copies": b["copies"].astype(np.int32)}
                else:
                    cols = {"key": b["key"], "ctx": b["ctx"], "copies": b["copies"].astype(np.int32)}
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols.values()], names=list(cols))

    return run


def _fetch(cut: Shape):
    """Texts with the list of blocks wanted of them -> a row for each block, or for each window of one with a hot key."""
    size = cut.size
    plain = b" ".join if cut.words else bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "core", *ROW, "start", "windows", "single", "front", "back"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
        for batch in batches:
            cols: list[list] = [[] for _ in names]

            def flush() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)
                for c in cols:
                    c.clear()
                return out

            for own, uid, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                raw = text.as_py().split() if cut.words else text.as_py()
                for w in wanted.as_py():
                    s, n = w["start"], w["windows"]
                    if w["hot"]:
                        rows = [(None, hashlib.blake2b(plain(raw[p : p + size]), digest_size=16).digest(), own, uid, p, 1, w["single"], b"", b"") for p in range(s, s + n)]
                    else:
                        lead, core = cut.core(w["shape"])
                        block = raw[s : s + n + size - 1]
                        rows = [(w["key"], hashlib.blake2b(plain(block[lead : lead + core]), digest_size=16).digest(), own, uid, s, n, w["single"], plain(block[:lead]), plain(block[lead + core :]))]
                    for r in rows:
                        for c, x in zip(cols, r):
                            c.append(x)
                if len(cols[0]) > 10_000:
                    yield flush()
            yield flush()

    return run


def repeated_windows(rows: list[tuple], size: int) -> list[tuple[int, int, int]]:
    """(row, first window, windows) of the runs of windows of single rows that some other row has too.

    rows: (key, core digest, own, hash, start, windows, single, front, back), rows of one key and digest being comparable.
    """
    text: list[int] = []
    spots: list[tuple[int, int, int]] = []
    number: dict[tuple, int] = {}
    for r, (key, digest, _, _, _, windows, _, front, back) in enumerate(rows):
        at = len(text)
        text.extend(c + 1 for c in front)
        text.append(257 + number.setdefault((key, digest), len(number)))
        text.extend(c + 1 for c in back)
        text.append(0)
        # a window that starts d symbols before the core ends size - d - core bytes after it
        inner = size + windows - 1 - len(front) - len(back)
        spots.extend((at + k, r, size - inner + 1) for k in range(windows))
    place = {p: (r, n) for p, r, n in spots}
    hit: dict[int, list[int]] = {}
    last = None
    for p in suffix_array(text):
        got = place.get(p)
        if got is None:
            continue
        if last is not None:
            q, s, m = last
            if got[1] == m and text[p : p + m] == text[q : q + m]:
                for x, row in ((p, got[0]), (q, s)):
                    if rows[row][6]:
                        hit.setdefault(row, []).append(x)
        last = (p, *got)
    out, begin = [], {}
    for p, r, _ in spots:
        begin.setdefault(r, p)
    for r, at in hit.items():
        at = sorted(set(at))
        k = 0
        while k < len(at):
            e = k
            while e + 1 < len(at) and at[e + 1] == at[e] + 1:
                e += 1
            out.append((r, at[k] - begin[r], e - k + 1))
            k = e + 1
    return out


def repeated_word_windows(rows: list[tuple], cut: Shape) -> list[tuple[int, int, int]]:
    """The same for windows of words; front and back are words with single spaces between them."""
    number: dict[tuple | bytes, int] = {}
    text: list[int] = []
    begins = []
    for key, digest, _, _, _, _, _, front, back in rows:
        begins.append(len(text))
        text.extend(number.setdefault(x, len(number)) for x in (*front.split(), (key, digest), *back.split()))
    many = np.array([r[5] for r in rows])
    row = np.repeat(np.arange(len(rows)), many)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    spots = np.array(begins)[row] + inner
    # the core is one symbol, so a window is cut.width symbols
    rank, long = np.array(text), 1
    while 2 * long <= cut.width:
        rank = np.unique(rank[:-long] * len(text) + rank[long:], return_inverse=True)[1]
        long *= 2
    _, same, times = np.unique(rank[spots] * len(text) + rank[spots + cut.width - long], return_inverse=True, return_counts=True)
    hit = np.flatnonzero((times[same] > 1) & np.array([r[6] for r in rows])[row])
    first = np.flatnonzero(np.r_[True, (np.diff(hit) != 1) | (np.diff(row[hit]) != 0)][: len(hit)])
    return list(zip(row[hit[first]].tolist(), inner[hit[first]].tolist(), np.diff(np.r_[first, len(hit)]).tolist()))


def _sorted_blocks(cut: Shape, together: int = 1500):
    """Blocks ordered by key -> (own, hash, start, windows) of the repeated windows of single ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def work() -> pa.RecordBatch:
            found = [(held[r][2], held[r][3], held[r][4] + k, n) for r, k, n in (repeated_word_windows(held, cut) if cut.words else repeated_windows(held, cut.size))]
            held.clear()
            cols = list(zip(*found)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=[*ROW, "start", "windows"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= together and held[-1][0] != row[0]:
                    yield work()
                held.append(row)
        if held:
            yield work()

    return run


def covered(raw: bytes, ranges: list, size: int) -> list[tuple[int, int]]:
    """Maximal runs [from, to) of the bytes that windows cover; ranges: (start, windows)."""
    runs: list[tuple[int, int]] = []
    for start, windows in sorted(ranges):
        end = start + windows - 1 + size
        if runs and start <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], end))
        else:
            runs.append((start, end))
    return runs


def repeated_ranges(texts: DataFrame, scratch: Scratch, size: int = 400, room: int = 256, *, words: bool = False) -> DataFrame:
    """texts (own long, hash long, text binary) -> (own, hash, ranges array<struct<start, windows>>) for those that have any.
    With ``words``, size and ranges count words."""
    cut = Shape(size, words)
    texts = texts.where(F.octet_length("text") >= (2 * size - 1 if words else size))
    row = "own long, hash long"
    kind = f"{row}, start int, windows int, shape int, key long, ctx long, copies int"
    counted = in_arrow(texts, _rows(cut, False), "key long, ctx long, copies int").groupBy("key").agg(F.sum("copies").alias("n"), F.min("ctx").alias("low"), F.max("ctx").alias("high"))
    keys = scratch.cut(counted.where("n > 1").select("key", (F.col("low") != F.col("high")).alias("mixed")), "keys")
    kept = scratch.cut(in_arrow(texts, _rows(cut, True), kind).join(keys, "key"), "kept")
    scratch.drop("keys")
    mixed = kept.where("mixed")
    kinds = scratch.cut(mixed.groupBy("key", "ctx").agg(F.sum("copies").alias("n"), F.min(F.struct(*ROW, "start", "windows", "shape", "copies")).alias("one")), "kinds")
    # tables of their own, so that the joins below stand on exchanges that adaptive execution can split
    per_key = scratch.cut(kinds.groupBy("key").agg(F.count("*").alias("different")), "per_key")
    copied = scratch.cut(mixed.join(kinds.where("n > 1").select("key", "ctx"), ["key", "ctx"]).select(*ROW, "start", "windows"), "copied")
    one_window = (F.col("one.windows") / F.col("one.copies")).cast("int")  # equal neighbours have equally many
    wanted = kinds.join(per_key, "key").select(
        *(F.col(f"one.{c}").alias(c) for c in ROW),
        F.struct("key", F.col("one.start").alias("start"), one_window.alias("windows"), F.col("one.shape").alias("shape"), (F.col("n") == 1).alias("single"), (F.col("different") > room).alias("hot")).alias("w"),
    )
    wanted = scratch.cut(wanted.groupBy(*ROW).agg(F.collect_list("w").alias("wanted")), "wanted")
    cols = f"key long, core binary, {row}, start int, windows int, single boolean, front binary, back binary"
    edges = scratch.cut(in_arrow(texts.join(wanted, list(ROW)).select(*ROW, "text", "wanted"), _fetch(cut), cols), "edges")
    n_parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    found = in_arrow(edges.where("key is not null").repartition(n_parts, "key").sortWithinPartitions("key", "core"), _sorted_blocks(cut), f"{row}, start int, windows int")
    alone = edges.where("key is null")
    often = alone.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    hot = scratch.cut(alone.where("single").join(often, "core").select(*ROW, "start", "windows"), "hot")
    all_ranges = kept.where("not mixed").select(*ROW, "start", "windows").union(copied).union(found).union(hot)
    ranges = scratch.cut(all_ranges.groupBy(*ROW).agg(F.collect_list(F.struct("start", "windows")).alias("ranges")), "ranges")
    scratch.drop("kept", "kinds", "per_key", "copied", "wanted", "edges", "hot")
    return ranges


def with_spans(docs: DataFrame, scratch: Scratch, size: int = 400, keep: tuple[str, ...] = ("doc_id",), passage: int | None = None) -> DataFrame:
    """``keep`` columns of ``docs``, text as binary (null: empty), and ranges: the repeated windows, null if none; with
    ``passage`` those of so many words too."""
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    own = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), F.xxhash64("text bytes")]
    texts = docs.select(*(F.col(f"`{c}`") for c in keep), text.alias("text bytes")).withColumns({f"row {c}": x for c, x in zip(ROW, own)})
    named = texts.select(*(F.col(f"row {c}").alias(c) for c in ROW), F.col("text bytes").alias("text"))
    found = {"repeated ranges": repeated_ranges(named, scratch, size)}
    if passage is not None:
        found["repeated passages"] = repeated_ranges(named, scratch, passage, words=True)
    for name, ranges in found.items():
        ranges = ranges.select(*(F.col(c).alias(f"row {c}") for c in ROW), F.col("ranges").alias(name))
        texts = texts.join(ranges, [f"row {c}" for c in ROW], "left")
    return texts.select(*(F.col(f"`{c}`") for c in keep), F.col("text bytes"), *found)


def removed(docs: DataFrame, size: int = 400, passage: int | None = None) -> DataFrame:
    """(doc_id, spans array<struct<from, to>>, kept binary, n_bytes): what is removed of each row of ``docs`` and what stays.
    With ``passage``, passages array<struct<from, to>> follows, in words: what is covered by strings of so many words that
    also start elsewhere, the same row included; nothing is removed for that. Words are runs of bytes other than ASCII white
    space, whatever stands between them; no letter case or character is made equal to another.

    A null text is empty; a text shorter than ``size`` keeps all; a row that occurs twice is repeated as a whole; a null
    doc_id is a value like any other; other columns are ignored; an empty table gives no rows. A very long text is read in
    overlapping parts and leaves as one value.
    """
    span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            spans, kept, sizes, passages = [], [], [], []
            if passage is not None:
                for ranges in b.column(3).to_pylist():
                    runs = covered(b"", [(r["start"], r["windows"]) for r in ranges or ()], passage)
                    passages.append([{"from": a, "to": e} for a, e in runs])
            for text, ranges in zip(b.column(1), b.column(2)):
                raw = text.as_py()
                runs = covered(raw, [(r["start"], r["windows"]) for r in ranges.as_py() or ()], size)
                edges = [0, *(x for run in runs for x in run), len(raw)]
                kept.append(b"".join(raw[a:e] for a, e in zip(edges[::2], edges[1::2])) if runs else raw)
                spans.append([{"from": a, "to": e} for a, e in runs])
                sizes.append(len(raw))
            cols = {"doc_id": b.column(0), "spans": pa.array(spans, span), "kept": pa.array(kept, pa.binary()), "n_bytes": pa.array(sizes, pa.int64())}
            if passage is not None:
                cols["passages"] = pa.array(passages, span)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    scratch = Scratch(docs.sparkSession, "repeats")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    runs = "array<struct<from:bigint,to:bigint>>"
    return in_arrow(with_spans(named, scratch, size, passage=passage), run, f"doc_id long, spans {runs}, kept binary, n_bytes long" + f", passages {runs}" * (passage is not None))


def whole_words(raw: bytes, a: int, e: int) -> int:
    """Words between the bytes a and e of a text, without those that go on beyond."""
    n = len(raw[a:e].decode(errors="ignore").split())
    return n - (a > 0 and len(raw[a - 1 : a + 1].strip()) == 2) - (e < len(raw) and len(raw[e - 1 : e + 1].strip()) == 2)


def without_repeats(docs: DataFrame, size: int = 400, words: int | None = None) -> DataFrame:
    """``docs`` with the repeated bytes gone from text (a character cut in two goes whole); n_chars follows if it is there.
    Rows whose text was not empty and is now are left out. With ``words``, runs that were found by a smaller ``size`` go
    only if they hold so many whole words or 400 bytes."""
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            out: list[str | None] = []
            for text, ranges in zip(b.column("text bytes"), b.column("repeated ranges")):
                raw, got = text.as_py(), ranges.as_py()
                if got:
                    runs = covered(raw, [(r["start"], r["windows"]) for r in got], size)
                    if words is not None:
                        runs = [(a, e) for a, e in runs if e - a >= 400 or whole_words(raw, a, e) >= words]
                    edges = [0, *(x for run in runs for x in run), len(raw)]
                    raw = b"".join(raw[a:e].decode(errors="ignore").encode() for a, e in zip(edges[::2], edges[1::2]))
                out.append(raw.decode() if raw or not got else None)
            keep = pa.array([x is not None for x in out])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(out, pa.string())], names=[*rest, "text"]).filter(keep)

    scratch = Scratch(docs.sparkSession, "repeats")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    out = in_arrow(with_spans(docs, scratch, size, tuple(rest)), run, f"{kinds}, text string")
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*quoted(docs.columns))

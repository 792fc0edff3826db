"""Source divergence audit: how far the sources of a language are from each other, and which terms set a source apart.

A table over byte values, looked up for the whole UTF-8 buffer of a batch, lower-cases and tells where terms begin and end.
Slices are grouped by their xxhash; the bytes of every slice are compared with those of its group, and groups that differ
fall apart. A (document, term) matrix in compressed rows gives a batch's counts, which tasks add up before they shuffle.

The terms kept of a language are dealt into blocks by their hash. A block holds a (source, term) matrix in compressed rows
and all sources' totals; one vector operation and one ``reduceat`` give a source's divergences from all others, zeros
included by count. Blocks' sums add up, so no task sees a whole language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .store import Scratch
from .workers import in_arrow, parts

#: bytes of lower-cased text looked up at once, and terms or counts that a task holds before it passes them on
BLOCK, TERMS, COUNTS = 4 << 20, 400_000, 2_000_000
#: entries (source, term) of a block
ENTRIES = 1 << 14
BILLION = 1_000_000_000

#: 0 where a byte ends a term, else the byte, lower-cased
BYTES = np.zeros(256, np.uint8)
BYTES[0x80:] = np.arange(0x80, 0x100)
BYTES[0x61:0x7B] = np.arange(0x61, 0x7B)
BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)


def slices(text: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, first byte, byte after the last) of the terms in texts that begin at ``begins`` in one buffer."""
    low = BYTES[text]
    inside = low > 0
    edge = np.zeros(len(low) + 1, bool)  # a text ends here or the next begins
    edge[begins] = True
    edge[-1] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    return low, np.flatnonzero(opens), np.flatnonzero(closes) + 1


def grouped(low: np.ndarray, first: np.ndarray, after: np.ndarray, digest: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> tuple[list[bytes], np.ndarray]:
    """(different terms, the number of each slice's term)."""
    if not len(first):
        return [], np.zeros(0, np.int64)
    raw = low.tobytes()
    hashes = np.fromiter((digest(raw[a:b]) for a, b in zip(first.tolist(), after.tolist())), np.uint64, len(first))
    _, at, group = np.unique(hashes, return_index=True, return_inverse=True)
    size = after - first
    same = size == size[at][group]
    if same.all():
        begin = np.cumsum(size) - size
        within = np.arange(int(size.sum())) - np.repeat(begin, size)
        equal = low[np.repeat(first, size) + within] == low[np.repeat(first[at][group], size) + within]
        if equal.all():
            return [raw[a:b] for a, b in zip(first[at].tolist(), after[at].tolist())], group
    numbers: dict[bytes, int] = {}  # two terms of one hash: the bytes decide
    group = np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(first.tolist(), after.tolist())], np.int64)
    return list(numbers), group


def summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys in order, and the sums of the columns over each."""
    if not len(keys):
        return keys, *columns
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], *(np.add.reduceat(c[by], at) for c in columns)


class Counts:
    """What a task has counted: occurrences and documents of each (group, term), and the documents of each group."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.documents: list[int] = []
        self.clear()

    def clear(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def group(self, lang: str, source: str) -> int:
        got = self.groups.setdefault((lang, source), len(self.groups))
        if got == len(self.documents):
            self.documents.append(0)
        self.documents[got] += 1
        return got

    def number(self, terms: list[bytes]) -> np.ndarray:
        known = self.terms
        return np.fromiter((known.setdefault(t, len(known)) for t in terms), np.int64, len(terms))

    def add(self, group: np.ndarray, term: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        self.held.append(summed(group << 32 | term, n, docs))
        self.size += len(self.held[-1][0])
        if self.size > COUNTS:
            self.held = [summed(*(np.concatenate(c) for c in zip(*self.held)))]
            self.size = len(self.held[0][0])

    @property
    def full(self) -> bool:
        return len(self.terms) > TERMS or self.size > COUNTS

    def rows(self) -> pa.RecordBatch:
        """All counts since the last call; a group's documents stand beside a missing term."""
        keys, n, docs = summed(*(np.concatenate(c) for c in zip(*self.held))) if self.held else (np.zeros(0, np.int64),) * 3
        names = list(self.groups)
        here = np.r_[keys >> 32, np.arange(len(names))].astype(np.int64)
        texts = pa.array([*self.terms], pa.binary()).cast(pa.string())
        term = pa.chunked_array([texts.take(pa.array(keys & 0xFFFFFFFF)), pa.nulls(len(names), pa.string())]).combine_chunks()
        cols = [pa.array([g[k] for g in names], pa.string()).take(pa.array(here)) for k in (0, 1)]
        cols += [term, pa.array(np.r_[n, np.zeros(len(names))].astype(np.int64)), pa.array(np.r_[docs, self.documents].astype(np.int64))]
        self.documents = [0] * len(names)
        self.clear()
        return pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a column of texts without nulls."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw


def _long(counts: Counts, group: int, raw: np.ndarray) -> None:
    """A text longer than a block: stretches that end where no term does."""
    found: dict[bytes, int] = {}
    at = 0
    while at < len(raw):
        end = min(at + BLOCK, len(raw))
        while end < len(raw):  # on to the end of the term
            gap = np.flatnonzero(BYTES[raw[end : end + BLOCK]] == 0)
            end = end + int(gap[0]) if len(gap) else min(end + BLOCK, len(raw))
            if len(gap):
                break
        low, first, after = slices(raw[at:end], np.zeros(1, np.int64))
        terms, which = grouped(low, first, after)
        for t, n in zip(terms, np.bincount(which, minlength=len(terms)).tolist()):
            found[t] = found.get(t, 0) + n
        at = end
    term = counts.number(list(found))
    counts.add(np.full(len(term), group), term, np.fromiter(found.values(), np.int64, len(term)), np.ones(len(term), np.int64))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents with it; term null: the group's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in parts(batches, 1024):
            group = np.array([counts.group(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], np.int64)
            at, raw = _buffer(batch.column(2))
            i = 0
            while i < len(group):
                k = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1)
                if at[k] - at[i] > BLOCK:
                    _long(counts, int(group[i]), raw[at[i] : at[k]])
                elif at[k] > at[i]:
                    low, first, after = slices(raw[at[i] : at[k]], at[i:k] - at[i])
                    terms, which = grouped(low, first, after)
                    doc = np.searchsorted(at[i : k + 1] - at[i], first, "right") - 1
                    # the compressed rows of documents: a document's different terms and how often it has them
                    key, n = summed(doc * len(terms) + which, np.ones(len(doc), np.int64))
                    number = counts.number(terms)
                    if len(key):
                        counts.add(group[i:k][key // len(terms)], number[key % len(terms)], n, np.ones(len(key), np.int64))
                i = k
                if counts.full:
                    yield counts.rows()
        if counts.groups:
            yield counts.rows()

    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    partial = in_arrow(texts, run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 * n / total), exact for totals up to 2.8 * 10**14: the billion is divided in two steps."""
    a, b = 31_250, 32_000
    high, rest = np.divmod(n * a, total)
    return 1 + high * b + rest * b // total


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def block_pairs(source: np.ndarray, term: np.ndarray, n: np.ndarray, totals: np.ndarray, vocabulary: int, terms: int) -> Iterator[np.ndarray]:
    """For each source t in turn: the divergence of every source s from t, summed over the ``terms`` terms of a block.

    source, term, n: the block's counts above zero, in order of source. totals: all sources' occurrences of all kept terms.
    """
    whole = totals + 2 * vocabulary
    p, none = share(n + 2, whole[source]), share(np.full(len(totals), 2), whole)
    rows = np.searchsorted(source, np.arange(len(totals) + 1))
    filled = np.flatnonzero(rows[1:] > rows[:-1])

    def by_source(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(totals), np.int64)
        if len(filled):
            out[filled] = np.add.reduceat(x, rows[:-1][filled])
        return out

    sizes = rows[1:] - rows[:-1]
    for t in range(len(totals)):
        own, there = slice(rows[t], rows[t + 1]), np.zeros(terms, bool)
        q = np.full(terms, none[t])
        q[term[own]], there[term[own]] = p[own], True
        both = there[term]
        mine = by_source(apart(p, q[term]))
        values, times = np.unique(p[own], return_counts=True)
        theirs = (apart(none[:, None], values) * times).sum(axis=1)
        theirs -= by_source(np.where(both, apart(none[source], q[term]), 0))
        neither = terms - sizes - sizes[t] + by_source(both.astype(np.int64))
        yield mine + theirs + neither * apart(none, none[t])


def _block(entries: pa.Table, groups: pa.Table, most: int) -> pa.Table:
    """One block of a language: its sums for all pairs of sources, and each source's terms of the highest values."""
    names = sorted(groups.column("source").to_pylist())
    place = {s: i for i, s in enumerate(names)}
    totals, lang = np.zeros(len(names), np.int64), groups.column("lang")[0].as_py()
    for s, n in zip(groups.column("source").to_pylist(), groups.column("total").to_pylist()):
        totals[place[s]] = n
    vocabulary = groups.column("vocabulary")[0].as_py()
    source = np.array([place[s] for s in entries.column("source").to_pylist()], np.int64)
    texts = entries.column("term").to_pylist()
    words = sorted(set(texts))  # code points have the order of their UTF-8
    rank = {w: i for i, w in enumerate(words)}
    term, n = np.array([rank[w] for w in texts], np.int64), entries.column("n").to_numpy().astype(np.int64)
    by = np.lexsort((term, source))
    source, term, n = source[by], term[by], n[by]
    out: list[tuple[str, str, str, int]] = []
    if vocabulary:
        for t, values in enumerate(block_pairs(source, term, n, totals, vocabulary, len(words))):
            out += [(names[s], "pair", names[t], v) for s, v in enumerate(values.tolist()) if s != t]
        of_all = np.zeros(len(words), np.int64)
        np.add.at(of_all, term, n)
        p, q = share(n + 2, totals[source] + 2 * vocabulary), share(of_all[term] + 2, int(totals.sum()) + 2 * vocabulary)
        above = np.flatnonzero(p > q)
        value = apart(p[above], q[above])
        by = np.lexsort((term[above], -value, source[above]))
        above, value = above[by], value[by]
        begin = np.searchsorted(source[above], source[above])
        top = np.arange(len(above)) - begin < most
        out += [(names[source[e]], "term", words[term[e]], v) for e, v in zip(above[top].tolist(), value[top].tolist())]
    else:
        out += [(s, "pair", t, 0) for s in names for t in names if s != t]
    cols = list(zip(*out)) if out else [[]] * 4
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
    arrays = [pa.array([lang] * len(out), pa.string()), *(pa.array(list(c), k) for c, k in zip(cols, kinds))]
    return pa.table(arrays, names=["lang", "source", "part", "item", "value"])


def audited(docs: DataFrame, least: int = 10, most: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) over the terms in at least ``least`` documents of a language.

    Part ``pair``: the sources of a language against each other, all ranks. Part ``term``: what a source has more of than its
    language, up to rank ``most``. Null text, language and source are empty strings; empty texts count as documents of their
    group; a language without kept terms has zeros for its pairs; a lone source has none. Repeated rows count as often as they
    stand there; texts of any length are counted whole; equal values go by item; other columns aren't read. An empty table gives
    an empty table.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    counts = scratch.cut(term_counts(docs), "counts")
    spread = Window.partitionBy("lang", "term")
    found = counts.where(F.col("term").isNotNull()).withColumn("spread", F.sum("docs").over(spread)).where(F.col("spread") >= least)
    found = found.withColumn("lead", (F.col("source") == F.min("source").over(spread)).cast("long"))
    kept = scratch.cut(found.select("lang", "source", "term", "n", "lead"), "kept")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("lead").alias("lead"), F.count("*").alias("entries"))
    groups = scratch.cut(counts.where(F.col("term").isNull()).select("lang", "source").join(totals, ["lang", "source"], "left").na.fill(0, ["total", "lead", "entries"]), "groups")
    langs = groups.groupBy("lang").agg(F.sum("lead").alias("vocabulary"), F.sum("entries").alias("entries"), F.count("*").alias("sources"))
    room = F.greatest(F.lit(ENTRIES).cast("long"), F.col("sources") * F.col("sources"))
    langs = scratch.cut(langs.select("lang", "vocabulary", F.greatest(F.lit(1), F.ceil(F.col("entries") / room)).cast("int").alias("blocks")), "langs")
    left = kept.join(langs.select("lang", "blocks"), "lang").select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"))
    right = groups.select("lang", "source", "total").join(langs, "lang")
    right = right.select("lang", "source", "total", "vocabulary", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    sums = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInArrow(
        lambda entries, of: _block(entries, of, most), "lang string, source string, part string, item string, value long"
    )
    sums = sums.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= most))

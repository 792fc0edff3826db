"""Best-fit packing by hierarchical residual packing.

Texts become pieces of at most ``size`` tokens. Each task packs its pieces best-fit (longest first, into the fullest bin
that has room) and emits the bins that are nearly full. Underfull bins go up as items: they are dealt to fewer tasks, each
with a bounded number of them, and packed again, until one task holds all that is left or a round no longer saves bins.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import Scratch
from .tokens import default_path, word_ids
from .workers import in_arrow, parts

PIECE = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>"
BIN = f"bin bigint, fill bigint, pieces array<{PIECE}>"
#: a bin's number: the round, the task and the place within the task
ROUND, TASK = 57, 32


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers: longest items first, each into the fullest bin that has room for it."""
    rooms: list[int] = []  # the free lengths that occur, ascending
    at: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        k = bisect_left(rooms, n)
        if k < len(rooms):
            room = rooms[k]
            b = at[room].pop()
            if not at[room]:
                del at[room], rooms[k]
        else:
            room, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        if left := room - n:
            if left not in at:
                at[left] = []
                insort(rooms, left)
            at[left].append(b)
    return bins


def pieces_of(ids: bytes, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of the pieces of one document's ids."""
    n = len(ids) // 4
    for k, start in enumerate(range(0, n, size)):
        part = ids[4 * start : 4 * min(start + size, n)]
        yield k, start, len(part) // 4, zlib.crc32(part)


def tokenised(docs: DataFrame, size: int, path: str, end: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids binary]): every document's tokens and then ``end``, cut at ``size``."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, stop = word_ids(path), np.array([end], "<u4").tobytes()
        for batch in parts(batches):
            cols: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = table.ids(text.as_py()) + stop
                for k, start, length, crc in pieces_of(ids, size):
                    row = (doc_id, k, start, length, crc, ids[4 * start : 4 * (start + length)])
                    for c, x in zip(cols, row):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, kind)


def _pack(size: int, level: int, chunk: int):
    """Packs a task's bins, at most ``chunk`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k, held, rows = level << ROUND | TaskContext.get().partitionId() << TASK, [], 0

        def pack() -> Iterator[pa.RecordBatch]:
            nonlocal k
            table = pa.Table.from_batches(held)
            fill, lists = table["fill"].to_numpy(), table["pieces"].combine_chunks()
            begin, flat = lists.offsets.to_numpy(), lists.values
            fields = [flat.field(i) for i in range(flat.type.num_fields)]
            offset = fields[-1].to_numpy(zero_copy_only=False)
            bins = best_fit(fill.tolist(), size)
            for some in range(0, len(bins), 4096):
                take, shift, ends, names, fills = [], [], [0], [], []
                for b in bins[some : some + 4096]:
                    at = 0
                    for i in b:
                        take.append(np.arange(begin[i], begin[i + 1]))
                        shift.append(np.full(begin[i + 1] - begin[i], at))
                        at += int(fill[i])
                    ends.append(ends[-1] + sum(int(begin[i + 1] - begin[i]) for i in b))
                    names.append(k)
                    fills.append(at)
                    k += 1
                idx = np.concatenate(take)
                new = [f.take(pa.array(idx)) for f in fields[:-1]] + [pa.array(offset[idx] + np.concatenate(shift))]
                value = pa.StructArray.from_arrays(new, fields=list(flat.type))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(fills, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), value)], names=["bin", "fill", "pieces"])
            held.clear()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= chunk:
                yield from pack()
                rows = 0
        if held:
            yield from pack()

    return run


def pack(pieces: DataFrame, scratch: Scratch, size: int = 4096, full: float = 0.998, chunk: int = 200_000) -> DataFrame:
    """The pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset, as bins of at most ``size``.

    ``full``: share of ``size`` from which a bin is final before the last round; ``chunk``: most items packed at once.
    """
    least = int(size * full)
    item = F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset"))
    # spread by a hash, so that a task has all lengths where the input is sorted by them
    pieces = pieces.repartition(F.xxhash64("doc_id", "piece", "ids_crc32"))
    now = pieces.select(F.lit(0).cast("long").alias("bin"), F.col("length").alias("fill"), F.array(item).alias("pieces"))
    done, level, before, tasks = [], 0, None, None
    while True:
        bins = scratch.cut(in_arrow(now, _pack(size, level, chunk), BIN), f"bins{level}")
        open_bins = bins.where(F.col("fill") < least)
        n = open_bins.count()
        if n <= 1 or tasks == 1 or (before is not None and bins.count() >= before):
            done.append(bins)
            break
        done.append(bins.where(F.col("fill") >= least))
        parts = bins.rdd.getNumPartitions() if tasks is None else tasks
        tasks = max(ceil(n / chunk), min(parts // 8, ceil(n / 2000)), 1)
        now = open_bins.repartition(tasks, F.xxhash64("bin"))
        before, level = n, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    out = out.select(F.col("bin").alias("sequence_id"), F.explode("pieces").alias("p"))
    return out.select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset")


def pack_documents(docs: DataFrame, size: int = 4096, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all rows of ``docs`` (doc_id, text).

    A null or empty text is the end token alone. Repeated rows are packed as often as they occur; a null doc_id stays
    null; other columns are ignored; an empty table gives no rows; pieces of one length may change places. A very long text
    is encoded in stretches of about a million characters.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(tokenised(docs, size, path or default_path()), scratch, size)


def sequences(docs: DataFrame, placed: DataFrame, size: int = 4096, path: str | None = None) -> DataFrame:
    """(sequence_id, ids array<int>): the packed sequences themselves, for ``placed`` made from the same ``docs``."""
    pieces = tokenised(docs, size, path or default_path(), with_ids=True)
    keyed = pieces.join(placed.select("doc_id", "piece", "ids_crc32", "sequence_id", "offset"), ["doc_id", "piece", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in sorted(parts, key=lambda p: p["offset"])), "<u4").astype(np.int32) for parts in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["sequence_id", "ids"])

    return in_arrow(keyed.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "ids")).alias("p")), run, "sequence_id long, ids array<int>")

"""What a Python worker holds between batches and between tasks.

Workers outlive tasks, so memory that one stage has freed but not given back counts against all later ones. Arrow takes its
buffers from the system's allocator here, which returns large ones at once, and what is left over goes back after a task.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: blocks from this size on are mapped for themselves and unmapped when freed; so much freed memory stays for the next batch
MAPPED, HELD = 4 << 20, 64 << 20
_M_TRIM_THRESHOLD, _M_MMAP_THRESHOLD = -1, -3  # fixed values: the C library's numbers of these settings
_ready = False


def _libc() -> ctypes.CDLL:
    return ctypes.CDLL(None)


def settle() -> None:
    global _ready
    if not _ready:
        _ready = True
        pa.set_memory_pool(pa.system_memory_pool())
        if hasattr(_libc(), "mallopt"):  # another C library keeps its own ways
            _libc().mallopt(_M_MMAP_THRESHOLD, MAPPED)
            _libc().mallopt(_M_TRIM_THRESHOLD, HELD)


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` whose workers give memory back at the end of each task, for columns of any name."""
    names = df.columns
    odd = any(set(n) & set(".`") for n in names)  # mapInArrow looks its columns up unquoted

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        try:
            yield from run((pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches) if odd else batches)
        finally:
            give_back()

    return (df.toDF(*(f"c{i}" for i in range(len(names)))) if odd else df).mapInArrow(task, schema)


def quoted(columns: list[str]) -> list[str]:
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, so that only so many are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)

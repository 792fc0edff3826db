"""Tables in SQLite files of a shared folder, as a data source: filters reach the database, row ranges are read in parallel.

A table is a folder of database files, each written by one task. Reading splits every file by row numbers; conditions on
columns become the database's WHERE, where an index on the key columns serves them. ``sqlite_bars`` is the format's name.
"""

from __future__ import annotations

import datetime as dt
import os
import sqlite3
import uuid
from collections.abc import Iterable, Iterator
from contextlib import closing
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

FORMAT = "sqlite_bars"
#: how the engine's types are kept: times as microseconds, days as days since 1970
KEPT = {
    "string": "TEXT", "double": "REAL", "float": "REAL", "bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER",
    "boolean": "INTEGER", "timestamp": "INTEGER", "timestamp_ntz": "INTEGER", "date": "INTEGER",
}
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
ROWS = 8192


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def local(folder: str) -> str:
    """A shared folder as the database library opens it: a mounted path."""
    path = folder.removeprefix("file://")
    if "://" in path:
        raise ValueError(f"{folder} isn't mounted; SQLite files need a path of the file system")
    return path


def opened(file: str) -> sqlite3.Connection:
    return sqlite3.connect(f"{Path(file).absolute().as_uri()}?mode=ro", uri=True)


def plain(value: object, kind: str) -> object | None:
    """A condition's value as it is kept; None where it can't be told."""
    if isinstance(value, dt.datetime):
        if kind != "timestamp_ntz" or value.tzinfo:
            return None
        return (value - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    if isinstance(value, dt.date):
        return (value - dt.date(1970, 1, 1)).days if kind == "date" else None
    if isinstance(value, float):
        return value if value == value and kind == "double" else None
    if isinstance(value, bool):
        return int(value) if kind == "boolean" else None
    if isinstance(value, int):
        return value if KEPT[kind] == "INTEGER" and kind not in ("timestamp", "timestamp_ntz", "date") else None
    return value if isinstance(value, str) and kind == "string" else None


def condition(f: Filter, kinds: dict[str, str]) -> tuple[str, list] | None:
    """SQL and values of a filter, or None where the engine has to apply it."""
    at = getattr(f, "attribute", ())
    if len(at) != 1 or at[0] not in kinds:
        return None
    column, kind = quoted(at[0]), kinds[at[0]]
    if isinstance(f, IsNull | IsNotNull):
        return f"{column} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL", []
    if isinstance(f, In):
        values = [plain(v, kind) for v in f.value]
        if not values or len(values) > 500 or None in values:
            return None
        return f"{column} IN ({', '.join('?' * len(values))})", values
    if type(f) in COMPARED:
        value = plain(f.value, kind)
        return None if value is None else (f"{column} {COMPARED[type(f)]} ?", [value])
    return None


@dataclass
class Range(InputPartition):
    """Row numbers from ``low`` up to ``high`` of one file."""

    file: str
    low: int
    high: int


class TableReader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType, rows: int):
        self.folder, self.schema, self.rows = folder, schema, rows
        self.kinds = {f.name: f.dataType.simpleString() for f in schema}
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 (the interface's name)
        for f in filters:
            found = condition(f, self.kinds)
            if found is None:
                yield f
            else:
                self.where.append(found[0])
                self.values += found[1]

    def partitions(self) -> list[Range]:
        found = []
        for file in sorted(Path(self.folder).glob("*.db")):
            with closing(opened(str(file))) as db:
                last = db.execute("SELECT max(rowid) FROM rows").fetchone()[0] or 0
            found += [Range(str(file), i, i + self.rows) for i in range(1, last + 1, self.rows)]
        return found or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        target = pa.schema([(n, ARROW[k]) for n, k in self.kinds.items()])
        where = " AND ".join(["rowid >= ?", "rowid < ?", *self.where])
        columns = ", ".join(map(quoted, self.kinds))
        with closing(opened(partition.file)) as db:
            found = db.execute(f"SELECT {columns} FROM rows WHERE {where}", [partition.low, partition.high, *self.values])
            while got := found.fetchmany(ROWS):
                sides = [pa.array(side).cast(raw(f.type)).cast(f.type) for side, f in zip(zip(*got), target)]
                yield pa.RecordBatch.from_arrays(sides, schema=target)


ARROW = {
    "string": pa.string(), "double": pa.float64(), "float": pa.float32(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(),
    "tinyint": pa.int8(), "boolean": pa.bool_(), "timestamp": pa.timestamp("us", "UTC"), "timestamp_ntz": pa.timestamp("us"), "date": pa.date32(),
}


def raw(t: pa.DataType) -> pa.DataType:
    """The number that stands for a value of this type in the database."""
    return pa.int64() if pa.types.is_timestamp(t) else pa.int32() if pa.types.is_date(t) else pa.int64() if pa.types.is_boolean(t) else t


class TableSource(DataSource):
    """Options: ``path``, the folder; ``rows``, row numbers a task (1,000,000). The schema is the reader's."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        raise ValueError(f"{FORMAT} needs a schema: spark.read.format({FORMAT!r}).schema(...)")

    def reader(self, schema: StructType) -> TableReader:
        return TableReader(local(self.options["path"]), schema, int(self.options.get("rows", 1_000_000)))


def write_table(df: DataFrame, folder: str, keys: list[str]) -> int:
    """Write ``df`` as a table with an index over ``keys``; its rows are counted. Each partition becomes one file.

    A file is built under a name of its own and moved into place when it is whole, so a task that runs twice leaves one file.
    NaN becomes NULL, as the database has none; types without a place there are an error. An empty table is an empty folder.
    """
    kinds = dict(df.dtypes)
    if bad := sorted(c for c, k in kinds.items() if k not in KEPT):
        raise ValueError(f"columns {bad} have types that the database can't keep")
    path = local(folder)
    os.makedirs(path, exist_ok=True)
    fields = ", ".join(f"{quoted(c)} {KEPT[k]}" for c, k in kinds.items())
    index = ", ".join(map(quoted, keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, n = f"{path}/.{uuid.uuid4().hex}", 0
        with closing(sqlite3.connect(own)) as db:
            db.execute("PRAGMA journal_mode = OFF")
            db.execute(f"CREATE TABLE rows ({fields})")
            for batch in batches:
                sides = [pc.cast(pc.cast(c, ARROW[k]), raw(ARROW[k])).to_pylist() for c, k in zip(batch.columns, kinds.values())]
                db.executemany(f"INSERT INTO rows VALUES ({', '.join('?' * len(sides))})", zip(*sides))
                n += batch.num_rows
            db.execute(f"CREATE INDEX by_key ON rows ({index})")
            db.commit()
        if n:
            os.replace(own, f"{path}/{TaskContext.get().partitionId():06d}.db")
        else:
            os.remove(own)
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return df.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def read_table(spark: SparkSession, folder: str, schema: StructType, rows: int = 1_000_000) -> DataFrame:
    """The table in ``folder``. Conditions on it reach the database; those it can't tell the engine applies."""
    spark.dataSource.register(TableSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).schema(schema).option("rows", rows).load(folder)

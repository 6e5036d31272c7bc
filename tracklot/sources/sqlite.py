"""SQLite tables as a Spark data source: parallel reads by ranges of row ids, filters left to SQLite, and writes of one file a task.

Rows go between Spark and SQLite in Arrow batches, so times are made into text and back a column at a time.

A table is a file, or a folder of files that hold a part each, which is how Spark writes it; the folder must be one that all
executors see. Times are kept as ISO text and booleans as 0 and 1, under declared types that tell them on reading.
"""

from __future__ import annotations

import glob
import os
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage

#: Declared types of columns, and what they are in Spark.
KINDS = {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "TEXT": T.StringType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType()}
#: Those types in Arrow.
ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "timestamp": pa.timestamp("us", "UTC")}
#: Rows of a batch that is read.
BATCH = 10_000
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _local(path: str) -> str:
    return path.removeprefix("file://")


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(file: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{file}?mode=ro", uri=True)


def _as_column(values: tuple, kind: pa.DataType) -> pa.Array:
    """A column of SQLite's values as Spark's; times are UTC, and texts may be of any SQLite type."""
    if pa.types.is_boolean(kind):
        return pa.array([None if v is None else bool(v) for v in values], kind)
    if pa.types.is_string(kind):
        return pa.array([v if v is None or isinstance(v, str) else str(v) for v in values], kind)
    if not pa.types.is_timestamp(kind):
        return pa.array(values, kind)
    try:
        return pa.array(values, pa.string()).cast(pa.timestamp("us")).cast(kind)
    except pa.ArrowInvalid:  # not all of them are plain
        return pa.array([None if v is None else datetime.fromisoformat(v).replace(tzinfo=UTC) for v in values], kind)


def _as_values(column: pa.Array) -> list:
    """A column of Spark's values as SQLite's: ISO text for times, without a fraction of zero."""
    if pa.types.is_timestamp(column.type):
        column = pc.replace_substring_regex(pc.cast(pc.cast(column, pa.timestamp("us")), pa.string()), r"\.0+$", "")
    return column.to_pylist()


class Stretch(InputPartition):
    """Rows of one file by their ids, both ends included."""

    def __init__(self, file: str, low: int, high: int):
        self.file, self.low, self.high = file, low, high


class Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.table, self.path = schema, options["table"], _local(options["path"])
        self.rows = int(options.get("rowspersplit", 100_000))
        self.tests: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Comparisons, lists and null tests of numbers and texts become SQL; Spark keeps the others."""
        for f in filters:
            plain = len(f.attribute) == 1 and isinstance(self.schema[f.attribute[0]].dataType, (T.LongType, T.DoubleType, T.StringType)) if hasattr(f, "attribute") else False
            name = _quoted(f.attribute[0]) if plain else ""
            if plain and type(f) in COMPARED and isinstance(f.value, (int, float, str)):
                self.tests.append((f"{name} {COMPARED[type(f)]} ?", [f.value]))
            elif plain and isinstance(f, In) and all(isinstance(v, (int, float, str)) for v in f.value):
                self.tests.append((f"{name} IN ({', '.join('?' * len(f.value))})", list(f.value)))
            elif plain and isinstance(f, (IsNull, IsNotNull)):
                self.tests.append((f"{name} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL", []))
            else:
                yield f

    def partitions(self) -> list[Stretch]:
        found = []
        for file in files(self.path):
            with closing(_open(file)) as db:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            if low is not None:
                found += [Stretch(file, a, min(a + self.rows - 1, high)) for a in range(low, high + 1, self.rows)]
        return found or [Stretch("", 0, -1)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        tests = " AND ".join(["rowid BETWEEN ? AND ?", *[t for t, _ in self.tests]])
        values = [partition.low, partition.high, *[v for _, vs in self.tests for v in vs]]
        schema = pa.schema([(f.name, ARROW[f.dataType.simpleString()]) for f in self.schema])
        with closing(_open(partition.file)) as db:
            found = db.execute(f"SELECT {', '.join(_quoted(f.name) for f in self.schema)} FROM {_quoted(self.table)} WHERE {tests}", values)
            while rows := found.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([_as_column(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Written(WriterCommitMessage):
    def __init__(self, temporary: str, file: str):
        self.temporary, self.file = temporary, file


class Writer(DataSourceArrowWriter):
    """Every task writes a file of its own under a name that readers pass over; the files get their names when all are whole."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.schema, self.table, self.path, self.overwrite = schema, options["table"], _local(options["path"]), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.path, exist_ok=True)
        name = f"part-{uuid.uuid4().hex}.db"
        temporary = f"{self.path}/.{name}"
        kinds = {v.simpleString(): k for k, v in KINDS.items()}
        columns = ", ".join(f"{_quoted(f.name)} {kinds.get(f.dataType.simpleString(), 'INTEGER' if isinstance(f.dataType, T.IntegralType) else 'TEXT')}" for f in self.schema)
        with closing(sqlite3.connect(temporary)) as db:
            db.execute("PRAGMA journal_mode = OFF")  # a file that was cut off is thrown away
            db.execute("PRAGMA synchronous = OFF")
            db.execute(f"CREATE TABLE {_quoted(self.table)} ({columns})")
            for batch in iterator:
                db.executemany(f"INSERT INTO {_quoted(self.table)} VALUES ({', '.join('?' * len(self.schema))})", zip(*map(_as_values, batch.columns), strict=True))
            db.commit()
        return Written(temporary, f"{self.path}/{name}")

    def commit(self, messages: list[Written | None]) -> None:
        old = files(self.path) if self.overwrite else []
        for m in messages:
            if m:
                os.rename(m.temporary, m.file)
        for file in old:
            os.remove(file)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and os.path.exists(m.temporary):
                os.remove(m.temporary)


def files(path: str) -> list[str]:
    return sorted(f for f in glob.glob(f"{path}/*.db")) if os.path.isdir(path) else [path]


class SqliteSource(DataSource):
    """``spark.read.format("sqlite").option("path", ...).option("table", ...)``; ``rowsPerSplit`` sets the rows of a task."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        table = self.options["table"]
        for file in files(_local(self.options["path"])):
            with closing(_open(file)) as db:
                found = db.execute(f"SELECT name, type FROM pragma_table_info({_quoted(table)})").fetchall()
            if found:
                return T.StructType([T.StructField(n, KINDS.get(kind.upper(), T.StringType())) for n, kind in found])
        raise ValueError(f"no table {table} in {self.options['path']}")

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to the session, with filters passed on to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)

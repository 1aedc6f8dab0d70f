"""SQLite files as a Python data source, and as sinks: one file, or a folder of files that tasks write and read.

    spark.dataSource.register(SqliteSource)
    spark.read.format("sqlite").option("path", file).option("table", "articles").option("parts", 8).load()

The file is handed to the executors by Spark (``addFile``), so it may lie in any store that Spark reads, and each
task reads a range of row ids from its own copy, read-only.  Column types come from the declared ones.  Option
``not_null`` names a column whose nulls are left out by the file's own query.
"""

from __future__ import annotations

import contextlib
import sqlite3
import tempfile

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as TT
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .readers import conform, schema, warehouse_type

BATCH = 1000
PART_ROWS = 200_000  # rows of a file that a task writes
_KINDS = {"INTEGER": TT.LongType(), "REAL": TT.DoubleType(), "BYTEA": TT.BinaryType(), "BOOLEAN": TT.LongType()}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(name: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{SparkFiles.get(name)}?mode=ro&immutable=1", uri=True)


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> TT.StructType:
        with _open(self.options["file"]) as c:
            columns = c.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']} in {self.options['file']}")
        return TT.StructType([TT.StructField(x[1], _KINDS.get(warehouse_type(x[2]), TT.StringType())) for x in columns])

    def reader(self, schema: TT.StructType) -> DataSourceReader:
        return SqliteReader(schema, self.options)


class SqliteReader(DataSourceReader):
    def __init__(self, schema: TT.StructType, options: dict):
        self.schema, self.options = schema, dict(options)

    def partitions(self) -> list[_Range]:
        """Ranges of row ids, as many as asked for; every row is in one of them."""
        with _open(self.options["file"]) as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.options['table'])}").fetchone()
        if low is None:
            return [_Range(0, 0)]
        n = max(1, min(int(self.options.get("parts", 1)), high - low + 1))
        return [_Range(low + (high - low + 1) * k // n, low + (high - low + 1) * (k + 1) // n) for k in range(n)]

    def read(self, partition: _Range):
        wanted = ", ".join(_quoted(f.name) for f in self.schema.fields)
        some = f" AND {_quoted(self.options['not_null'])} IS NOT NULL" if self.options.get("not_null") else ""
        text = [isinstance(f.dataType, TT.StringType) for f in self.schema.fields]
        with _open(self.options["file"]) as c:
            for row in c.execute(f"SELECT {wanted} FROM {_quoted(self.options['table'])} WHERE rowid >= ? AND rowid < ?{some}", (partition.low, partition.high)):
                # a column of texts may hold numbers in this format
                yield tuple(str(v) if t and v is not None and not isinstance(v, str) else v for v, t in zip(row, text))


def read_sqlite(spark: SparkSession, path: str, table: str, name: str | None = None, parts: int = 8, not_null: str | None = None) -> DataFrame:
    """A table of a SQLite file; ``name``: with that table's schema; ``not_null``: only rows that have this column."""
    spark.sparkContext.addFile(path)
    spark.dataSource.register(SqliteSource)
    rows = spark.read.format("sqlite").option("file", path.rstrip("/").rsplit("/", 1)[-1]).option("table", table).option("parts", parts)
    if not_null:
        rows = rows.option("not_null", not_null)
    return conform(rows.load(), schema(name)) if name else rows.load()


_SQL_KINDS = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}


def _statements(df: DataFrame, table: str) -> tuple[DataFrame, str, str]:
    """The frame with columns as SQLite holds them, and the statements that create the table and fill it."""
    columns = ", ".join(f"{_quoted(n)} {_SQL_KINDS.get(t, 'TEXT')}" for n, t in df.dtypes)
    plain = df.select(*(df[n] if t in _SQL_KINDS else df[n].cast("string").alias(n) for n, t in df.dtypes))
    return plain, f"CREATE TABLE {_quoted(table)} ({columns})", f"INSERT INTO {_quoted(table)} VALUES ({', '.join('?' * len(df.columns))})"


def write_parts(df: DataFrame, path: str, table: str, rows: int = PART_ROWS) -> None:
    """A frame as SQLite files of at most ``rows`` rows each, made by its tasks; no row passes through the driver.

    A file is a row of a Parquet table at ``path``, so that Spark commits it; a task without rows makes none.
    """
    plain, create, put = _statements(df, table)

    def files(batches):
        with contextlib.ExitStack() as stack:
            folder = stack.enter_context(tempfile.TemporaryDirectory())
            n, held, c = 0, 0, None

            def done():
                c.commit()
                c.close()
                with open(f"{folder}/{n}.db", "rb") as f:
                    raw = f.read()
                return pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([raw], pa.binary())], names=["rows", "bytes"])

            for batch in batches:
                at = 0
                while at < batch.num_rows:
                    if c is None:
                        c, held = sqlite3.connect(f"{folder}/{n}.db"), 0
                        c.execute(create)
                    some = batch.slice(at, rows - held)
                    c.executemany(put, zip(*(x.to_pylist() for x in some.columns)))
                    at, held = at + some.num_rows, held + some.num_rows
                    if held >= rows:
                        yield done()
                        c, n = None, n + 1
            if c is not None:
                yield done()

    plain.mapInArrow(files, "rows long, bytes binary").write.mode("overwrite").parquet(path)


def read_parts(spark: SparkSession, path: str, table: str, like: TT.StructType, not_null: str | None = None) -> DataFrame:
    """The table of all SQLite files that :func:`write_parts` made, each read by a query of its own; ``like``: its columns and types."""
    wanted = f"SELECT {', '.join(_quoted(f.name) for f in like.fields)} FROM {_quoted(table)}"
    if not_null:
        wanted += f" WHERE {_quoted(not_null)} IS NOT NULL"
    kinds = to_arrow_schema(like)

    def scan(batches):
        for batch in batches:
            for raw in batch.column(0):
                with contextlib.closing(sqlite3.connect(":memory:")) as c:
                    c.deserialize(raw.as_py())
                    cursor = c.execute(wanted)
                    while found := cursor.fetchmany(BATCH):
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), kinds)], schema=kinds)

    return spark.read.schema("bytes binary").parquet(path).mapInArrow(scan, like)


def write_sqlite(df: DataFrame, path: str, table: str) -> None:
    """A frame as a table of a SQLite file at ``path``, in any store that Spark writes.

    The format is one file of one writer: rows stream in batches through the driver into a working file, which is
    then copied to ``path`` and deleted.  :func:`write_parts` makes many files instead, by tasks.
    """
    plain, create, put = _statements(df, table)
    with tempfile.TemporaryDirectory() as folder:
        c = sqlite3.connect(f"{folder}/work.db")
        c.execute(create)
        batch: list[tuple] = []
        for row in plain.toLocalIterator():
            batch.append(tuple(row))
            if len(batch) >= BATCH:
                c.executemany(put, batch)
                batch.clear()
        c.executemany(put, batch)
        c.commit()
        c.close()
        spark = df.sparkSession
        made, target = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (f"file://{folder}/work.db", path))
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).copyFromLocalFile(False, True, made, target)

"""SQLite files as a Spark data source: schema from the file, one partition per range of row ids.

Usage: ``register(spark)`` and ``spark.read.format("sqlite_file").option("path", p).option("table", t).load()``.
The path has to be readable where tasks run.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

ROWS_A_PARTITION = 100_000


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType):
        self.path, self.table, self.names = path, table, [f.name for f in schema.fields]
        self.kinds = [int if isinstance(f.dataType, LongType) else float if isinstance(f.dataType, DoubleType) else str for f in schema.fields]

    def partitions(self) -> list[_Range]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f"select min(rowid), max(rowid) from {_quoted(self.table)}").fetchone()
        if low is None:
            return [_Range(0, -1)]
        return [_Range(a, min(a + ROWS_A_PARTITION - 1, high)) for a in range(low, high + 1, ROWS_A_PARTITION)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        cast = lambda k, v: None if v is None else k(v)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            for row in db.execute(f"select {', '.join(map(_quoted, self.names))} from {_quoted(self.table)} where rowid between ? and ?", (partition.low, partition.high)):
                yield tuple(cast(k, v) for k, v in zip(self.kinds, row, strict=True))


class SqliteFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def schema(self) -> StructType:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            found = db.execute(f"pragma table_info({_quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']}")
        kind = lambda t: LongType() if "INT" in t.upper() else DoubleType() if any(x in t.upper() for x in ("REAL", "FLOA", "DOUB")) else StringType()
        return StructType([StructField(c[1], kind(c[2] or "")) for c in found])

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], self.options["table"], schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteFile)


def tables(path: str) -> list[str]:
    """User tables of a file in order of name."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return [r[0] for r in db.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite\\_%' escape '\\' order by name")]

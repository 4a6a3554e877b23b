"""Single files as Spark data sources: tasks write parts, the commit joins them, and the file appears when it is whole.

``one_csv`` is a CSV file for spreadsheets, ``one_sqlite`` a table of an SQLite file. No row goes through the driver: a task leaves its
rows as a part in a folder beside the file, which driver and executors share, and the commit joins the parts' bytes in the order of
the partitions, or lets SQLite insert from them in one transaction. A job that fails aborts: its parts go and the old file stays.
"""

from __future__ import annotations

import csv
import os
import shutil
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

ENCODING, BOM = "utf-8", "utf-8-sig"
#: SQLite's types of columns; all else is text.
SQLITE_KINDS = {"int": "INTEGER", "bigint": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL"}


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str


class OneFileWriter(DataSourceWriter):
    """Tasks write parts; ``join`` makes the file out of them."""

    def __init__(self, options: dict, schema: T.StructType):
        self.path = Path(options["path"])
        self.schema = schema
        self.staging = self.path.parent / f".{self.path.name}.{uuid.uuid4().hex}"
        self.staging.mkdir(parents=True)

    def write(self, iterator: Iterator) -> Part:
        n = TaskContext.get().partitionId()
        # Attempts of a partition don't meet; only the one that Spark accepts is named to the commit.
        part = self.staging / f"{n:06d}-{uuid.uuid4().hex}"
        self.write_part(part, iterator)
        return Part(n, str(part))

    def commit(self, messages: list) -> None:
        parts = [m.path for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition)]
        whole = self.staging / "whole"
        self.join(whole, parts)
        with whole.open("rb+") as f:
            os.fsync(f.fileno())
        os.replace(whole, self.path)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)

    def write_part(self, part: Path, rows: Iterator) -> None:
        raise NotImplementedError

    def join(self, whole: Path, parts: list[str]) -> None:
        raise NotImplementedError


class CsvWriter(OneFileWriter):
    def __init__(self, options: dict, schema: T.StructType):
        super().__init__(options, schema)
        self.encoding = BOM if options.get("bom", "true").lower() == "true" else ENCODING

    def write_part(self, part: Path, rows: Iterator) -> None:
        with part.open("w", encoding=ENCODING, newline="") as f:
            csv.writer(f, lineterminator="\n").writerows(rows)

    def join(self, whole: Path, parts: list[str]) -> None:
        with whole.open("w", encoding=self.encoding, newline="") as f:
            csv.writer(f, lineterminator="\n").writerow(self.schema.names)
        with whole.open("ab") as out:
            for p in parts:
                with open(p, "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 20)


class SqliteWriter(OneFileWriter):
    def __init__(self, options: dict, schema: T.StructType):
        super().__init__(options, schema)
        self.table = options.get("table", "papers")

    def _name(self, name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    def _create(self, db: sqlite3.Connection) -> None:
        columns = ", ".join(f"{self._name(f.name)} {SQLITE_KINDS.get(f.dataType.simpleString(), 'TEXT')}" for f in self.schema)
        db.execute(f"CREATE TABLE IF NOT EXISTS {self._name(self.table)} ({columns})")

    def write_part(self, part: Path, rows: Iterator) -> None:
        db = sqlite3.connect(part)
        with db:
            self._create(db)
            db.executemany(f"INSERT INTO {self._name(self.table)} VALUES ({', '.join('?' * len(self.schema))})", (tuple(r) for r in rows))
        db.close()

    def join(self, whole: Path, parts: list[str]) -> None:
        if self.path.exists():
            # Other tables of the file stay.
            shutil.copyfile(self.path, whole)
        db = sqlite3.connect(whole, isolation_level=None)
        table = self._name(self.table)
        db.execute("BEGIN")
        self._create(db)
        db.execute(f"DELETE FROM {table}")
        db.execute("COMMIT")
        for p in parts:
            db.execute("ATTACH ? AS part", (p,))
            db.execute(f"INSERT INTO main.{table} SELECT * FROM part.{table}")
            db.execute("DETACH part")
        db.close()


class OneCsv(DataSource):
    """Options: path, bom (true unless told otherwise)."""

    @classmethod
    def name(cls) -> str:
        return "one_csv"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return CsvWriter(self.options, schema)


class OneSqlite(DataSource):
    """Options: path, table (papers)."""

    @classmethod
    def name(cls) -> str:
        return "one_sqlite"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return SqliteWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    for source in (OneCsv, OneSqlite):
        spark.dataSource.register(source)


def save(df: DataFrame, kind: str, path: str, **options: str) -> int:
    """Write df as one file and return its number of rows, which the write itself has counted."""
    register(df.sparkSession)
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.format(kind).mode("overwrite").options(path=str(Path(path).resolve()), **options).save()
    return seen.get["rows"]

"""Session databases (SQLite files) as a Spark data source: one partition per file and range of row numbers, filters on both pushed down.

    spark.dataSource.register(SessionDatabase)
    spark.read.format("session_database").option("path", folder).load().where("row >= 100 AND row < 200")

Columns: path, row (SQLite's row number), data (text). Files are found below `path` by their ending; executors open them read-only, so the folder must be one
that all of them see. Files that are no database, and tables without `data`, have no rows. Pushed filters prune files by path and ranges by row before any
file is opened for reading; what the source cannot use stays with Spark.
"""

from __future__ import annotations

import contextlib
import os
import sqlite3
from collections.abc import Iterator
from urllib.parse import quote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Rows of one partition, and of one Arrow batch.
RANGE, BATCH = 50_000, 2_000
_LAST = (1 << 63) - 1


class Part(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro&immutable=1", uri=True)


class SessionReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = urlparse(options["path"]).path if options["path"].startswith("file:") else options["path"]
        self.table, self.ending, self.step = options.get("table", "part"), options.get("ending", ".db"), int(options.get("rows", RANGE))
        self.first, self.last, self.paths = -_LAST, _LAST, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Row ranges and paths are taken; the others go back to Spark."""
        for f in filters:
            column = getattr(f, "attribute", None)
            value = getattr(f, "value", None)
            if column == ("row",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, value + isinstance(f, GreaterThan))
            elif column == ("row",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.last = min(self.last, value - isinstance(f, LessThan))
            elif column == ("row",) and isinstance(f, EqualTo):
                self.first, self.last = max(self.first, value), min(self.last, value)
            elif column == ("path",) and isinstance(f, (EqualTo, In)):
                wanted = set(value) if isinstance(f, In) else {value}
                self.paths = wanted if self.paths is None else self.paths & wanted
            else:
                yield f

    def _files(self) -> Iterator[str]:
        for folder, _, names in os.walk(self.root):
            for name in names:
                path = os.path.join(folder, name)
                if name.endswith(self.ending) and (self.paths is None or path in self.paths):
                    yield path

    def partitions(self) -> list[Part]:
        out = []
        for path in sorted(self._files()):
            with contextlib.suppress(sqlite3.Error), contextlib.closing(_open(path)) as db:
                low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
                if low is not None:
                    low, high = max(low, self.first), min(high, self.last)
                    out += [Part(path, k, min(k + self.step - 1, high)) for k in range(low, high + 1, self.step)]
        return out

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was found
            return
        with contextlib.suppress(sqlite3.Error), contextlib.closing(_open(partition.path)) as db:
            rows = db.execute(f'SELECT rowid, CAST(data AS TEXT) FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (partition.first, partition.last))
            while some := rows.fetchmany(BATCH):
                yield pa.record_batch({"path": pa.array([partition.path] * len(some)), "row": pa.array([r[0] for r in some], pa.int64()), "data": pa.array([r[1] for r in some], pa.string())})


class SessionDatabase(DataSource):
    @classmethod
    def name(cls) -> str:
        return "session_database"

    def schema(self) -> str:
        return "path string, row long, data string"

    def reader(self, schema) -> SessionReader:
        return SessionReader(dict(self.options))


def records(spark: SparkSession, path: str) -> DataFrame:
    """path, row, data of all session databases below `path`. Turns on that filters are pushed into sources written in Python, without which Spark refuses this one."""
    spark.dataSource.register(SessionDatabase)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("session_database").option("path", path).load()


def shell_commands(found: DataFrame) -> DataFrame:
    """path, row, command of the records that a shell tool ran; records that are no JSON, or of another tool, have none."""
    v = found.withColumn("v", F.try_parse_json("data"))
    is_shell = (F.try_variant_get("v", "$.type", "string") == "tool") & (F.try_variant_get("v", "$.tool", "string") == "bash")
    said = F.try_variant_get("v", "$.state.input.command", "variant")
    return v.where(is_shell & (F.schema_of_variant(said) == "STRING")).select("path", "row", F.try_variant_get("v", "$.state.input.command", "string").alias("command"))


def write(rows: DataFrame, folder: str) -> int:
    """A database per partition of `rows` (data) in a folder that all executors see; how many were written. Each is made beside the others under another name and then
    renamed, so a task that runs twice leaves one."""
    root = urlparse(folder).path if folder.startswith("file:") else folder

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        os.makedirs(root, exist_ok=True)
        path = os.path.join(root, f".{number}-{attempt}")
        with contextlib.closing(sqlite3.connect(path)) as db:
            db.execute("CREATE TABLE part (id INTEGER PRIMARY KEY, data TEXT)")
            for b in batches:
                db.executemany("INSERT INTO part (data) VALUES (?)", [(x,) for x in b.column(0).to_pylist()])
            db.commit()
        os.replace(path, os.path.join(root, f"sessions-{number}.db"))
        yield pa.record_batch({"n": pa.array([1], pa.int64())})

    return rows.select("data").mapInArrow(made, "n long").agg(F.sum("n")).first()[0] or 0

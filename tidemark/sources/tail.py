"""Sources that follow files as they grow: transcripts by size, the message store by its newest row."""

from __future__ import annotations

import fnmatch
import os
import sqlite3
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidemark.sources import transcripts
from tidemark.sources.store import SqliteSource


class TailSource(DataSource):
    """readStream.format("transcript-tail").option("path", folder): file, size of each file that grew since the last batch.
    The offset is the size of every file; the folder is one that the driver can list."""

    @classmethod
    def name(cls) -> str:
        return "transcript-tail"

    def schema(self) -> str:
        return "file string, size bigint"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _TailReader(self.options)


class _TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "*.jsonl")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = (os.path.join(folder, f) for folder, _, files in os.walk(self.path) for f in files if fnmatch.fnmatch(f, self.pattern))
        return {f: os.path.getsize(f) for f in found}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        grown = sorted((f, n) for f, n in end.items() if n > start.get(f, -1))
        return [InputPartition(grown[i : i + 1000]) for i in range(0, len(grown), 1000)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from partition.value


class StoreTail(SqliteSource):
    """readStream.format("sqlite-tail") of a table with an ascending integer `id`: rows beyond the last id seen."""

    @classmethod
    def name(cls) -> str:
        return "sqlite-tail"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StoreTailReader(schema, self.options)


class _StoreTailReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.path, self.table = schema.fieldNames(), options["path"], options["table"]
        self.rows = int(options.get("rowsPerPartition", 100_000))
        if not self.table.isidentifier():
            raise ValueError("table is a plain name")

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True, timeout=30)

    def initialOffset(self) -> dict:
        return {"id": 0}

    def latestOffset(self) -> dict:
        with self._open() as db:
            return {"id": db.execute(f"select coalesce(max(id), 0) from {self.table}").fetchone()[0]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition((a + 1, min(a + self.rows, end["id"]))) for a in range(start["id"], end["id"], self.rows)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        with self._open() as db:
            yield from db.execute(f"select {names} from {self.table} where id between ? and ? order by id", partition.value)


def grown_files(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """A stream of the transcript files that grew."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("transcript-tail").option("path", path).option("pattern", pattern).load()


def grown_store(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """A stream of the rows a store gained."""
    spark.dataSource.register(StoreTail)
    return spark.readStream.format("sqlite-tail").schema(schema).option("path", path).option("table", table).load()


def tail_transcripts(stream: DataFrame, path: str, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]], sink: Callable[[DataFrame, DataFrame], None], checkpoint: str, pattern: str = "*.jsonl"):
    """Parses each file that grew anew, as what a line means depends on those before it, and hands its (sessions, events) to
    the sink, which takes what is new (see past_checkpoint, append_new). Returns the query.

    Only the lines of grown files go on to the parser; other files of the folder are not parsed.
    """

    def batch(df: DataFrame, _: int) -> None:
        plain = lambda c: F.regexp_replace(c, "^[a-z]+:/+|^/+", "/")
        grown = df.select(plain(F.col("file")).alias("grown")).distinct()
        lines = transcripts.read_lines(df.sparkSession, path, pattern)
        sink(*parse(lines.join(grown, plain(F.url_decode(lines["file"])) == grown["grown"], "left_semi")))

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()

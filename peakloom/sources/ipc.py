"""Arrow IPC files as a data source: read by runs of record batches, written with a commit.

A file's footer, which tells its record batches, is read in a task; a run of batches
is then a partition, read from its own place in the file. A writing task puts its file
aside and tells its name; files that no committed task has told of are never seen
by a reader, so that a task that fails or runs twice leaves no rows behind.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from peakloom.sources import ranges


class Batches(InputPartition):
    def __init__(self, uri: str, first: int, count: int) -> None:
        self.uri, self.first, self.count = uri, first, count


class IpcReader(DataSourceReader):
    def __init__(self, options, schema) -> None:
        self.runs, self.schema = options["runs"], to_arrow_schema(schema)

    def partitions(self) -> Sequence[InputPartition]:
        return [Batches(*r) for r in json.loads(self.runs)] or [Batches("", 0, 0)]

    def read(self, part: Batches) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        with ranges.opened(part.uri) as file:
            reader = pa.ipc.open_file(file)
            for i in range(part.first, part.first + part.count):
                batch = reader.get_batch(i)
                missing = [n for n in self.schema.names if n not in batch.schema.names]
                if missing:
                    raise ValueError(f"{part.uri} lacks the columns {missing}")
                yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in self.schema], schema=self.schema)


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class IpcWriter(DataSourceArrowWriter):
    def __init__(self, options, schema, overwrite: bool) -> None:
        self.target, self.overwrite, self.schema = options["path"], overwrite, to_arrow_schema(schema)
        self.aside = f"_aside-{uuid.uuid4().hex}"

    def _where(self) -> tuple[fs.FileSystem, str]:
        system, root = ranges.located(self.target)
        return system, root.rstrip("/")

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = self._where()
        system.create_dir(f"{root}/{self.aside}", recursive=True)
        name, writer, sink = f"part-{uuid.uuid4().hex}.arrow", None, None
        for batch in batches:
            if writer is None:
                sink = system.open_output_stream(f"{root}/{self.aside}/{name}")
                writer = pa.ipc.new_file(sink, batch.schema)
            writer.write_batch(batch)
        if writer is None:
            return Written(None)
        writer.close()
        sink.close()
        return Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """The files of the tasks that ended well get their place, and all else that was put aside goes; without a row there is one file with the schema."""
        system, root = self._where()
        system.create_dir(f"{root}/{self.aside}", recursive=True)
        names = [m.path for m in messages if m is not None and m.path is not None]
        if not names:
            names = ["part-empty.arrow"]
            with system.open_output_stream(f"{root}/{self.aside}/{names[0]}") as sink:
                pa.ipc.new_file(sink, self.schema).close()
        old = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.base_name[0] not in "._"] if self.overwrite else []
        for name in names:
            system.move(f"{root}/{self.aside}/{name}", f"{root}/{name}")
        for path in old:
            system.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = self._where()
        if system.get_file_info(f"{root}/{self.aside}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.aside}")


class IpcSource(DataSource):
    """Options: runs (of record batches, as load() finds them) to read, path to write."""

    @classmethod
    def name(cls) -> str:
        return "peakloom_ipc"

    def reader(self, schema) -> DataSourceReader:
        return IpcReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return IpcWriter(self.options, schema, overwrite)


def _footers(split: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """place, uri, first, count and schema of each run of record batches of some split bytes; a file without batches has a run of none. Footers alone are read."""
        for files in batches:
            out = []
            for place, uri, size in zip(*(c.to_pylist() for c in files.columns), strict=True):
                with ranges.opened(uri) as file:
                    reader = pa.ipc.open_file(file)
                    kinds, count = reader.schema.serialize().to_pybytes(), reader.num_record_batches
                step = max(1, count * split // max(1, size))
                out += [(place, uri, first, min(step, count - first), kinds) for first in range(0, max(1, count), step)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["place", "uri", "first", "count", "kinds"])

    return rows


def load(spark: SparkSession, path: str | list[str], split: int = ranges.SPLIT) -> DataFrame:
    """The rows of Arrow IPC files in the schema of the first; a file that lacks one of its columns is an error when it is read.

    A task reads record batches of some split bytes, or one that is larger.
    """
    files = [(i, uri, size) for i, (uri, size) in enumerate(ranges.listed(spark, path))]
    rows = spark.createDataFrame(files, "place long, uri string, size long").repartition(min(len(files), 200), "place")
    # A row for each run of record batches comes to the driver, with one schema, that of the first file.
    found = rows.mapInArrow(_footers(split), "place long, uri string, first long, count long, kinds binary")
    found = found.withColumn("kinds", F.when((F.col("place") == 0) & (F.col("first") == 0), F.col("kinds"))).orderBy("place", "first").collect()
    kinds = pa.ipc.read_schema(pa.BufferReader(bytes(found[0]["kinds"])))
    spark.dataSource.register(IpcSource)
    runs = json.dumps([(r["uri"], r["first"], r["count"]) for r in found if r["count"]])
    return spark.read.format(IpcSource.name()).schema(from_arrow_schema(kinds)).option("runs", runs).load()


def save(df: DataFrame, target: str, mode: str = "append") -> None:
    """A folder of Arrow IPC files, one for each partition with rows, as a whole or not at all; mode append adds to those there, overwrite replaces them."""
    df.sparkSession.dataSource.register(IpcSource)
    df.write.format(IpcSource.name()).mode(mode).option("path", ranges.qualified(df.sparkSession, target)).save()

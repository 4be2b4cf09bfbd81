"""A log that takes whole batches or nothing, as a sink of tables and of streams, and the objects that it describes.

Tasks write part files that nobody reads yet; the commit of a batch is one small
file that names them, put in place by a rename.  A batch that comes again (a
stream that restarts before its own commit) finds its number taken and changes
nothing; the parts of failed tasks and of aborted batches are never named.
Readers see the batches up to the version they ask for, whatever is written
meanwhile.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from larder.sources.files import filesystem
from larder.sources.sinks import merge_objects

FORMAT = "committed_log"


@dataclass
class Written(WriterCommitMessage):
    part: str | None  # a file's name; none if the task had no rows
    rows: int


def _write_part(path: str, batches: Iterator[pa.RecordBatch]) -> Written:
    system, root = filesystem(path)
    system.create_dir(f"{root}/parts", recursive=True)
    name, writer, rows = f"{uuid.uuid4().hex}.parquet", None, 0
    try:
        for b in batches:
            if b.num_rows:
                writer = writer or pq.ParquetWriter(system.open_output_stream(f"{root}/parts/{name}", compression=None), b.schema)
                writer.write_batch(b)
                rows += b.num_rows
    except BaseException:
        if writer:
            with contextlib.suppress(Exception):
                writer.close()
                system.delete_file(f"{root}/parts/{name}")
        raise
    if writer:
        writer.close()
        writer.file_handle and writer.file_handle.close()
    return Written(name if writer else None, rows)


def _discard(path: str, messages: list[Written | None]) -> None:
    system, root = filesystem(path)
    for m in messages:
        if m is not None and m.part:
            with contextlib.suppress(OSError):
                system.delete_file(f"{root}/parts/{m.part}")


def _commit(path: str, messages: list[Written | None], batch: int) -> None:
    system, root = filesystem(path)
    system.create_dir(f"{root}/commits", recursive=True)
    final = f"{root}/commits/{batch:019d}.json"
    if system.get_file_info(final).type != fs.FileType.NotFound:
        _discard(path, messages)  # the batch came again
        return
    done = [m for m in messages if m is not None]
    draft = f"{root}/commits/.{uuid.uuid4().hex}"
    with system.open_output_stream(draft, compression=None) as f:
        f.write(json.dumps({"batch": batch, "parts": [m.part for m in done if m.part], "rows": sum(m.rows for m in done)}).encode())
    system.move(draft, final)


class _Table(DataSourceArrowWriter):
    def __init__(self, path: str, batch: int):
        self.path, self.batch = path, batch

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return _write_part(self.path, iterator)

    def commit(self, messages: list[Written | None]) -> None:
        _commit(self.path, messages, self.batch)

    def abort(self, messages: list[Written | None]) -> None:
        _discard(self.path, messages)


class _Stream(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return _write_part(self.path, iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        _commit(self.path, messages, batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        _discard(self.path, messages)


class CommittedLog(DataSource):
    """Options: path, and for tables `batch`, the batch's number."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> _Table:
        if overwrite:
            raise ValueError("a log is only appended to")
        return _Table(self.options["path"], int(self.options["batch"]))

    def streamWriter(self, schema: StructType, overwrite: bool) -> _Stream:
        return _Stream(self.options["path"])


def append(df: DataFrame, path: str, batch: int) -> None:
    """Appends a batch by its number; a number that is there already changes nothing."""
    df.sparkSession.dataSource.register(CommittedLog)
    df.write.format(FORMAT).option("path", path).option("batch", batch).mode("append").save()


def append_stream(stream: DataFrame, path: str, checkpoint: str):
    """A writer of a stream's micro-batches, to be started."""
    stream.sparkSession.dataSource.register(CommittedLog)
    return stream.writeStream.format(FORMAT).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def versions(path: str) -> list[int]:
    """Numbers of the batches that are there."""
    system, root = filesystem(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
    return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json") and not f.base_name.startswith("."))


def read_log(spark: SparkSession, path: str, schema: str | StructType, version: int | None = None) -> DataFrame:
    """The rows of all batches up to `version`."""
    system, root = filesystem(path)
    parts = []
    for v in versions(path):
        if version is None or v <= version:
            with system.open_input_stream(f"{root}/commits/{v:019d}.json", compression=None) as f:
                parts += [f"{path}/parts/{p}" for p in json.loads(f.read())["parts"]]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


CHANGES = "name string, label string, px double, py double, op string, seq long"


def objects(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The objects (name, px, py, label) after the changes (op: put, forget or clear; by seq) logged up to `version`."""
    changes = read_log(spark, path, CHANGES, version)
    return merge_objects(changes.limit(0), changes)

"""Binary relations: two little-endian 64-bit integers (rows, columns), then each column's values, 8 bytes each.

Exposed as the Python data source ``relbin``. Reads are split by ranges of rows, so a large file is read by
many tasks; each task reads one byte range of each wanted column.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StructField, StructType

HEADER = 16
BATCH_ROWS = 1 << 16
#: Rows of a partition: 8 MB of each column.
PARTITION_ROWS = 1 << 20


class RelationFileError(ValueError):
    """A file that is no whole relation."""


def open_file(path: str):
    """A random-access file by any URI that pyarrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(where)


def read_header(path: str) -> tuple[int, int]:
    """(rows, columns), after a check that the file has them all."""
    try:
        file = open_file(path)
    except OSError as why:
        raise RelationFileError(f"{path} can't be opened: {why}") from why
    with file:
        size, raw = file.size(), file.read_at(HEADER, 0)
    if len(raw) < HEADER:
        raise RelationFileError(f"{path} has {size} bytes, too few for a header")
    rows, columns = struct.unpack("<QQ", raw)
    if size != HEADER + 8 * rows * columns:
        raise RelationFileError(f"{path}: {rows} rows of {columns} columns need {HEADER + 8 * rows * columns} bytes; it has {size}")
    return rows, columns


def write_relation(path: str, columns: list[np.ndarray]) -> None:
    """Write columns of equal length as a binary relation (a local file)."""
    rows = len(columns[0]) if columns else 0
    with open(path, "wb") as file:
        file.write(struct.pack("<QQ", rows, len(columns)))
        for column in columns:
            if len(column) != rows:
                raise ValueError("columns differ in length")
            file.write(np.asarray(column).astype("<u8").tobytes())


@dataclass
class RowRange(InputPartition):
    first: int
    end: int


class RelationReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, part: int):
        self.path, self.part = path, part
        self.wanted = [int(name[1:]) for name in schema.names]
        self.rows, _ = read_header(path)

    def partitions(self) -> list[RowRange]:
        return [RowRange(k, min(k + self.part, self.rows)) for k in range(0, self.rows, self.part)] or [RowRange(0, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        with open_file(self.path) as file:
            for first in range(partition.first, partition.end, BATCH_ROWS):
                n = min(BATCH_ROWS, partition.end - first)
                values = [np.frombuffer(file.read_at(8 * n, HEADER + 8 * (c * self.rows + first)), "<i8") for c in self.wanted]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], [f"c{c}" for c in self.wanted])


class RelationSource(DataSource):
    """Options: ``path``; ``columns`` (such as "0,2"; default all); ``rows`` of a partition."""

    @classmethod
    def name(cls) -> str:
        return "relbin"

    def schema(self) -> StructType:
        _, columns = read_header(self.options["path"])
        wanted = [int(c) for c in self.options["columns"].split(",")] if self.options.get("columns") else range(columns)
        if any(c >= columns for c in wanted):
            raise RelationFileError(f"{self.options['path']} has {columns} columns")
        return StructType([StructField(f"c{c}", LongType(), False) for c in wanted])

    def reader(self, schema: StructType) -> RelationReader:
        return RelationReader(self.options["path"], schema, int(self.options.get("rows", PARTITION_ROWS)))


def read_relation(spark: SparkSession, path: str, columns: list[int] | None = None) -> DataFrame:
    """A binary relation with columns c0, c1, ...: the bit patterns of its unsigned values."""
    from tallyweave.functions.workers import reachable

    reachable(spark).dataSource.register(RelationSource)
    reader = spark.read.format("relbin")
    if columns is not None:
        reader = reader.option("columns", ",".join(map(str, columns)))
    return reader.load(path)


def _fingerprint(path: str) -> str:
    """Size, time of change, rows and columns of a relation file."""
    from pyarrow import fs

    if path.startswith("file:"):
        info = fs.LocalFileSystem().get_file_info("/" + path[5:].lstrip("/"))
    else:
        system, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        info = system.get_file_info(where)
    return f"{info.size} {info.mtime_ns} {' '.join(map(str, read_header(path)))}"


def convert(spark: SparkSession, path: str, parquet: str) -> str:
    """Write a binary relation as Parquet, unless a whole conversion of the file as it is now is there; returns the Parquet path.

    It is written under another name and renamed when it is whole, with the source's size and time of change beside it.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(parquet)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    mark = jvm.org.apache.hadoop.fs.Path(target, "_source")
    wanted = _fingerprint(path)
    if system.exists(jvm.org.apache.hadoop.fs.Path(target, "_SUCCESS")) and system.exists(mark):
        stream = system.open(mark)
        found = bytes(stream.readAllBytes()).decode()
        stream.close()
        if found == wanted:
            return parquet
    fresh = f"{parquet.rstrip('/')}.{uuid.uuid4().hex}"
    read_relation(spark, path).write.parquet(fresh)
    stream = system.create(jvm.org.apache.hadoop.fs.Path(fresh, "_source"))
    stream.write(bytearray(wanted.encode()))
    stream.close()
    system.delete(target, True)
    if not system.rename(jvm.org.apache.hadoop.fs.Path(fresh), target):
        raise RelationFileError(f"{fresh} can't be renamed to {parquet}")
    return parquet

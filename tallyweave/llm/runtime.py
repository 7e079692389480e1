"""Shared storage, Arrow slicing and small helpers for the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.workers import shared_dir

#: UTF-8 bytes handled at once by the numpy kernels; one longer text is handled alone.
SLICE_BYTES = 1 << 20


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and the planner knows its size."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyweave_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(df._tallyweave_path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def by_hash(rows: DataFrame, key: str, most: int, n: int) -> DataFrame:
    """All of ``rows`` if ``n``, their number, is at most ``most``; else those whose key's hash falls in the share most/n. No sort, no shuffle."""
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64(key), F.lit(n)) < most)


#: Counters of the sketch of a join's keys, and the rows that a key's share of a task may have before it is salted.
KEY_COUNTERS, SALTED_ROWS = 4096, 1000


def skewed_join(many: DataFrame, one: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, in which a key stands once, whatever share of ``many`` a key has.

    Rows are counted by KEY_COUNTERS hashes of their keys. Where a counter is over SALTED_ROWS and twice the mean of a task, its rows
    are dealt to that many parts more, and the rows of ``one`` under it repeated as often. ``many`` must be a written table.
    """
    spark = many.sparkSession
    counter = F.pmod(F.xxhash64(*on), F.lit(KEY_COUNTERS)).cast("int")
    counts = np.zeros(KEY_COUNTERS, np.int64)
    for at, n in many.groupBy(counter.alias("at")).count().collect():  # at most KEY_COUNTERS rows
        counts[at] = n
    parts = counts // max(SALTED_ROWS, 2 * int(counts.sum()) // fine(spark)) + 1
    if parts.max() == 1:
        return many.join(one, on, how)
    share = F.element_at(F.lit(parts.tolist()).cast("array<int>"), counter + 1)
    dealt = many.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), share).cast("int"))
    repeated = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), share - 1)))
    return dealt.join(repeated, [*on, "__salt"], how).drop("__salt")


def fine(spark: SparkSession) -> int:
    """Shuffle partitions of the session, for explicit repartitioning by a key."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column in runs of rows of at most ``most`` bytes (or one row): first row, end row, bytes, offsets into them. Null counts as empty."""
    if not len(column):
        return
    data, at = _buffers(column)
    first, rows = 0, len(at) - 1
    while first < rows:
        end = int(np.searchsorted(at, at[first] + most, "right")) - 1
        end = min(max(end, first + 1), rows)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def code_points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a run of texts, and the first of each text among them (one more entry than texts). Bytes that are no UTF-8 become U+FFFD."""
    try:
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        return codes, np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
    except UnicodeDecodeError:
        raw = data.tobytes()
        texts = [raw[a:b].decode(errors="replace").encode("utf-32-le") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return np.frombuffer(b"".join(texts), np.uint32), np.cumsum([0, *(len(x) // 4 for x in texts)])

"""Scans and projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scan(relation: DataFrame, binding: int, columns: Sequence[int] | None = None) -> DataFrame:
    """Columns of a relation (all, or those of the given numbers) under the names of a binding."""
    narrow = columns is not None and relation.columns == [f"c{c}" for c in columns]
    chosen = range(len(relation.columns)) if columns is None else columns
    return relation.select(*(F.col(f"c{c}" if narrow else relation.columns[c]).alias(f"b{binding}_c{c}") for c in chosen))


def project(df: DataFrame, places: Sequence[int]) -> DataFrame:
    """Columns by place, in the given order."""
    return df.select(*(F.col(df.columns[p]) for p in places))


def row_at(df: DataFrame, key: str, value: int) -> DataFrame:
    """The row with a given id."""
    return df.filter(F.col(key) == value)


def with_row_ids(df: DataFrame, key: str, column: str = "row_id", slots: int | None = None) -> DataFrame:
    """Dense 0-based row ids in the order of a numeric key (unique, or the order of equal keys is open).

    Approximate quantiles of the key (at most ``slots`` values) deal the rows to slots; rows are numbered inside each slot and
    lifted by the counts of the slots before, so no task sees all rows. Ids are exact whatever the quantiles are.
    """
    slots = slots or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    bounds = sorted(set(df.agg(F.percentile_approx(key, [k / slots for k in range(1, slots)] or [0.5], 10_000)).first()[0] or []))
    slot = F.size(F.filter(F.lit(bounds), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    dealt = df.withColumn("__slot", slot)
    counts = dealt.groupBy("__slot").agg(F.count("*").alias("__n"))
    before = counts.select("__slot", (F.sum("__n").over(Window.orderBy("__slot")) - F.col("__n")).alias("__before"))
    inside = dealt.withColumn("__place", F.row_number().over(Window.partitionBy("__slot").orderBy(key)))
    joined = inside.join(F.broadcast(before), "__slot")  # one row a slot
    return joined.select(*df.columns, (F.col("__before") + F.col("__place") - 1).cast("bigint").alias(column))


def materialize_late(ids: DataFrame, base: DataFrame, row_id: str, wanted: Sequence[str]) -> DataFrame:
    """Fetch further columns of ``base`` by row id. Seldom needed: the scan of a columnar file is pruned anyway."""
    return ids.join(base.select(row_id, *(w for w in wanted if w not in ids.columns)), row_id)

"""Joins and partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], hint: str | None = None) -> DataFrame:
    """Inner join by equal keys, all pairs of rows; both sides' keys stay. Without a hint Catalyst chooses the strategy by size."""
    condition = [F.col(a) == F.col(b) for a, b in on]
    return left.join(right.hint(hint) if hint else right, condition, "inner")


def radix(column: str, first_bit: int, bits: int):
    """The bits of a key from ``first_bit`` on, as a partition number."""
    return F.shiftrightunsigned(F.col(column), first_bit).bitwiseAND(F.lit((1 << bits) - 1))


def radix_histogram(df: DataFrame, key: str, first_bit: int, bits: int) -> DataFrame:
    """(partition, n_rows) for the radix partitions of a key."""
    return df.groupBy(radix(key, first_bit, bits).alias("partition")).agg(F.count("*").alias("n_rows"))


def radix_partition(df: DataFrame, key: str, first_bit: int, bits: int) -> DataFrame:
    """Deal rows by the radix of their key. Join inputs need no such step: exchanges by hash are planned where they are needed."""
    return df.repartition(1 << bits, radix(key, first_bit, bits))


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """Each key once."""
    return df.select(key).distinct()

"""Global sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.unsigned import wrapping_sum


def checksum(df: DataFrame, unsigned: bool = False) -> DataFrame:
    """One row: the sum of every column as s0, s1, ..., null for 0 or no rows; mod 2^64 as decimal if ``unsigned`` (or where a sum may pass 2^63)."""
    total = wrapping_sum if unsigned else F.sum
    one = df.agg(*(total(F.col(c)).alias(f"p{k}") for k, c in enumerate(df.columns)))
    return one.select(*(F.nullif(F.col(f"p{k}"), F.lit(0)).alias(f"s{k}") for k in range(len(df.columns))))

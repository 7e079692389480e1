"""Filters by a constant and by the equality of two columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.unsigned import compare
from tallyweave.plans.ir import Filter


def filter_constants(df: DataFrame, filters: Iterable[Filter], unsigned: bool = False) -> DataFrame:
    """Rows that pass all filters; plain comparisons, which reach the scan, unless the values are unsigned."""
    conditions = [compare(F.col(f.column.name), f.op, f.constant, unsigned) for f in filters]
    return df.filter(reduce(and_, conditions)) if conditions else df


def filter_equal_columns(df: DataFrame, left: str, right: str) -> DataFrame:
    """Rows in which two columns are equal."""
    return df.filter(F.col(left) == F.col(right))

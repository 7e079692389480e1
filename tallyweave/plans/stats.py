"""Statistics of relations: rows, and for each column distinct values, least and greatest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.unsigned import from_signed, ordered, unordered


@dataclass(frozen=True)
class ColumnStats:
    distinct: int
    low: int | None
    high: int | None


@dataclass(frozen=True)
class TableStats:
    rows: int
    columns: tuple[ColumnStats, ...]


def statistics_frame(df: DataFrame, exact: bool = False, unsigned: bool = False) -> DataFrame:
    """(column, n_rows, n_distinct, low, high), one row a column, by one aggregation over all rows.

    Approximate distinct counts are sketches of fixed size merged from the partitions; exact ones shuffle
    the distinct values.
    """
    count = F.count_distinct if exact else F.approx_count_distinct
    put, back = (ordered, unordered) if unsigned else (lambda c: c, lambda c: c)
    parts = [f(F.col(c)).alias(f"{kind}{k}") for k, c in enumerate(df.columns) for kind, f in (("d", count), ("l", lambda x: back(F.min(put(x)))), ("h", lambda x: back(F.max(put(x)))))]
    one = df.agg(F.count("*").alias("n"), *parts)
    rows = F.array(*(F.struct(F.lit(k).alias("column"), F.col("n").alias("n_rows"), F.col(f"d{k}").alias("n_distinct"), F.col(f"l{k}").alias("low"), F.col(f"h{k}").alias("high")) for k in range(len(df.columns))))
    return one.select(F.inline(rows))


def collect_stats(df: DataFrame, exact: bool = False, unsigned: bool = False) -> TableStats:
    if not df.columns:
        return TableStats(df.count(), ())
    rows = sorted(statistics_frame(df, exact, unsigned).collect(), key=lambda r: r["column"])
    value = from_signed if unsigned else (lambda x: x)
    return TableStats(rows[0]["n_rows"], tuple(ColumnStats(r["n_distinct"], *(None if r[x] is None else value(r[x]) for x in ("low", "high"))) for r in rows))

"""The ordered list of relations that queries refer to by number."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.plans.stats import TableStats, collect_stats

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class Relation:
    """Columns c0, c1, ... of bigint. ``unsigned``: they hold the bits of unsigned values of 2^63 and over. ``narrow`` reads some columns
    only, for sources that Catalyst can't prune."""

    name: str
    df: DataFrame
    unsigned: bool = False
    narrow: Callable[[list[int]], DataFrame] | None = None

    def read(self, columns: Sequence[int]) -> DataFrame:
        """The relation, with the given columns at least, under their names."""
        return self.df if self.narrow is None or not columns else self.narrow(list(columns))

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def count(self) -> int:
        return self.df.count()


def integer_columns(df: DataFrame) -> DataFrame:
    """The integer columns of ``df`` in order, as bigint c0, c1, ..."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, _INTEGERS)]
    return df.select(*(F.col(f"`{n}`").cast("bigint").alias(f"c{k}") for k, n in enumerate(names)))


class Catalog:
    """Relations by number, in the order in which they were added, with statistics gathered when first asked for."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.relations: list[Relation] = []
        self._stats: dict[int, TableStats] = {}

    def __getitem__(self, number: int) -> Relation:
        return self.relations[number]

    def __len__(self) -> int:
        return len(self.relations)

    def widths(self) -> list[int]:
        return [len(r.columns) for r in self.relations]

    def add(self, df: DataFrame, name: str | None = None, unsigned: bool = False, narrow: Callable[[list[int]], DataFrame] | None = None) -> int:
        """Register the integer columns of a DataFrame; returns its number."""
        self.relations.append(Relation(name or f"r{len(self.relations)}", integer_columns(df), unsigned, narrow))
        return len(self.relations) - 1

    def add_parquet(self, path: str, unsigned: bool = False) -> int:
        return self.add(self.spark.read.parquet(path), path, unsigned)

    def add_columns(self, columns: Sequence[Sequence[int]], name: str | None = None, unsigned: bool = False) -> int:
        """Register a relation given as lists of values, one for each column."""
        from tallyweave.functions.unsigned import to_signed

        table = pa.table({f"c{k}": pa.array([to_signed(v) for v in values], pa.int64()) for k, values in enumerate(columns)})
        return self.add(self.spark.createDataFrame(table), name, unsigned)

    def add_binary(self, path: str, unsigned: bool = False, parquet: str | None = None) -> int:
        """Register a binary relation file; queries read the columns they use. With ``parquet`` it is converted there (again when the file
        has changed), and queries read that: filters are then pushed down too."""
        from .relbin import convert, read_relation

        if parquet:
            return self.add_parquet(convert(self.spark, path, parquet), unsigned)
        return self.add(read_relation(self.spark, path), path, unsigned, lambda columns: read_relation(self.spark, path, columns))

    def stats(self, number: int) -> TableStats:
        if number not in self._stats:
            self.gather([number])
        return self._stats[number]

    def gather(self, numbers: Iterable[int] | None = None, exact: bool = False) -> None:
        """Statistics of the given (or all) relations, as concurrent jobs of one aggregation each."""
        missing = [k for k in (range(len(self)) if numbers is None else numbers) if k not in self._stats]
        if missing:
            with ThreadPoolExecutor(min(8, len(missing))) as pool:
                found = pool.map(lambda k: collect_stats(self[k].df, exact, self[k].unsigned), missing)
                self._stats.update(zip(missing, found, strict=True))

    def views(self) -> None:
        """Temporary views r0, r1, ... for the SQL form of queries."""
        for k, relation in enumerate(self.relations):
            relation.df.createOrReplaceTempView(f"r{k}")

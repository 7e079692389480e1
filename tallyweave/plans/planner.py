"""From a query to one DataFrame: scans, filters, joins in a chosen order, one global sum."""

from __future__ import annotations

from functools import reduce
from math import prod
from operator import and_, mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.unsigned import wrapping_product, wrapping_sum, wrapping_sum_of_decimals
from tallyweave.operators.filters import filter_constants
from tallyweave.operators.scans import scan
from tallyweave.sources.catalog import Catalog

from .ir import ColumnRef, Join, Query
from .order import Orderer, explain_order, given_order, join_order
from .parser import check, parse_query
from .rewrite import share_sums, tidy
from .stats import TableStats


def join_columns(query: Query, b: int) -> list[ColumnRef]:
    """Columns of a binding that join it with others."""
    return sorted({c for j in query.joins if j.left.binding != j.right.binding for c in (j.left, j.right) if c.binding == b})


def weight(b: int) -> str:
    """Name of the column that counts the rows of a group of a binding."""
    return f"b{b}_rows"


def _total(query: Query, column: ColumnRef, eager: frozenset[int], wraps: bool) -> Column:
    """Sum of a column over joined rows: its value (or the sum of its group) for each row that the other groups stand for."""
    factors = [F.col(weight(b)) for b in sorted(eager) if b != column.binding or column in join_columns(query, b)]
    if not wraps:
        return F.sum(reduce(mul, factors, F.col(column.name)))
    if not eager:
        return wrapping_sum(F.col(column.name))
    return wrapping_sum_of_decimals(wrapping_product([F.col(column.name), *factors]))


class PlanError(ValueError):
    """A query whose relations its joins don't connect."""


def _equal(joins: list[Join]) -> Column:
    return reduce(and_, (F.col(j.left.name) == F.col(j.right.name) for j in joins))


#: A relation is summed up by its join columns before the joins if it has so many rows for each group, and so many rows at all.
EAGER_SHARE, EAGER_ROWS = 8, 100_000


class Planner:
    """Plans queries over a catalog.

    ``order``: "cost" (statistics of the catalog, gathered once) or "text" (as written, no statistics).
    ``cross``: whether relations that no join connects are multiplied, instead of refused.
    ``hint``: a join strategy hint for every join, such as "shuffle_hash"; None leaves the choice to Catalyst.
    ``eager_rows``: least rows of a relation that may be summed up before the joins (by cost only); None never does.
    """

    def __init__(self, catalog: Catalog, order: str = "cost", cross: bool = False, hint: str | None = None, eager_rows: int | None = EAGER_ROWS):
        if order not in ("cost", "text"):
            raise ValueError(f"unknown order {order!r}")
        self.catalog, self.order, self.cross, self.hint, self.eager_rows = catalog, order, cross, hint, eager_rows

    def statistics(self, query: Query) -> dict[int, TableStats]:
        return {r: self.catalog.stats(r) for r in set(query.relations)}

    def eager(self, query: Query) -> frozenset[int]:
        """Bindings to sum up before the joins: those whose join columns have few combinations for their rows.

        Their rows then meet as one row for each combination, with a count and partial sums. So a fact table is shuffled
        as partial sums, and many-to-many joins don't multiply rows. Where the sum may pass 2^63 or values are unsigned, partial sums
        and products are mod 2^64 too.
        """
        if self.eager_rows is None or self.order != "cost" or len(query.relations) == 1:
            return frozenset()
        orderer, out = Orderer(query, self.statistics(query)), set()
        for b in query.bindings():
            keys, rows = join_columns(query, b), orderer.base[b]
            groups = prod(orderer.distinct(c) for c in keys)
            if keys and rows >= self.eager_rows and rows >= EAGER_SHARE * groups:
                out.add(b)
        return frozenset(out)

    def wraps(self, query: Query, sums: tuple[ColumnRef, ...]) -> bool:
        """Whether a sum may pass 2^63: by the greatest value and the rows of all relations multiplied. Yes where there are no statistics."""
        if self.order != "cost":
            return True
        known = self.statistics(query)
        most = max((max(abs(c.low or 0), abs(c.high or 0)) for s in sums for c in [known[query.relations[s.binding]].columns[s.column]]), default=0)
        return most * prod(known[r].rows for r in query.relations) >= 2**63

    def summed(self, query: Query, b: int, sums: tuple[ColumnRef, ...], rows: DataFrame, wraps: bool = False) -> DataFrame:
        """A binding's rows by its join columns: their number, and the sums of its other columns."""
        keys = join_columns(query, b)
        values = [(wrapping_sum if wraps else F.sum)(F.col(c.name)).alias(c.name) for c in sums if c.binding == b and c not in keys]
        return rows.groupBy(*(c.name for c in keys)).agg(F.count("*").alias(weight(b)), *values)

    def binding(self, query: Query, b: int, sums: tuple[ColumnRef, ...]) -> DataFrame:
        """Scan of a binding with its filters and the equalities inside it."""
        relation = self.catalog[query.relations[b]]
        needed = query.needed_columns(b, sums)
        out = scan(relation.read(needed), b, needed)
        out = filter_constants(out, query.filters_on(b), relation.unsigned)
        inner = [j for j in query.joins if j.left.binding == j.right.binding == b]
        return out.filter(_equal(inner)) if inner else out

    def bindings_in_order(self, query: Query) -> tuple[int, ...]:
        if len(query.relations) == 1:
            return (0,)
        order = given_order(query)
        if order is None:
            if not self.cross:
                raise PlanError(f"the joins of {query.to_text()} don't connect its relations")
            return tuple(query.bindings())
        if self.order == "cost":
            return join_order(query, self.statistics(query)) or order
        return order

    def joined(self, query: Query, sums: tuple[ColumnRef, ...], eager: frozenset[int] = frozenset(), wraps: bool = False) -> DataFrame:
        """All bindings joined; each new one by all predicates that link it to those before, so they become one multi-key join."""
        order = self.bindings_in_order(query)
        side = lambda b: self.summed(query, b, sums, self.binding(query, b, sums), wraps) if b in eager else self.binding(query, b, sums)
        out, done = side(order[0]), {order[0]}
        for b in order[1:]:
            links = [j for j in query.joins if {j.left.binding, j.right.binding} - done == {b} and j.left.binding != j.right.binding]
            new = side(b)
            new = new.hint(self.hint) if self.hint else new
            out = out.join(new, _equal(links), "inner") if links else out.crossJoin(new)
            done.add(b)
        return out

    def plan(self, query: Query | str) -> DataFrame:
        """One row with columns s0, s1, ...: each sum mod 2^64, null for a sum of 0 or no rows.

        Sums are bigint where the statistics show that none can pass 2^63, and decimal(20, 0) elsewhere, without statistics, and
        if a relation of the query is unsigned.
        """
        query = parse_query(query, self.catalog.widths()) if isinstance(query, str) else query
        check(query, self.catalog.widths())
        shared, neat = share_sums(query), tidy(query)
        unsigned = any(self.catalog[r].unsigned for r in query.relations)
        self.bindings_in_order(neat)  # refuses relations that aren't connected
        eager = self.eager(neat)
        wraps = unsigned or self.wraps(neat, shared.sums)
        rows = self.joined(neat, shared.sums, eager, wraps)
        one = rows.agg(*(_total(neat, c, eager, wraps).alias(f"p{k}") for k, c in enumerate(shared.sums)))
        return one.select(*(F.nullif(F.col(f"p{p}"), F.lit(0)).alias(f"s{k}") for k, p in enumerate(shared.place)))

    def answer(self, query: Query | str) -> DataFrame:
        """One row, one column ``answer``: the sums as text, separated by blanks, NULL for a sum of 0."""
        sums = self.plan(query)
        return sums.select(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in sums.columns)).alias("answer"))

    def explain(self, query: Query | str) -> str:
        """The query's parts, the join order with its estimates, the relations summed up early, and Spark's plan."""
        query = parse_query(query, self.catalog.widths()) if isinstance(query, str) else query
        neat = tidy(query)
        order = explain_order(neat, self.statistics(neat)) if self.order == "cost" else f"bindings in order: {self.bindings_in_order(neat)}"
        early = ", ".join(map(str, sorted(self.eager(neat)))) or "none"
        return "\n".join([neat.tree(), order, f"summed before the joins: {early}", self.plan(query)._jdf.queryExecution().explainString(_formatted(self.catalog.spark))])


def _formatted(spark):
    return spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")

"""Immutable form of a query: relations, equi-join predicates, constant filters and columns to sum.

A column is named by its binding (the place of its relation in the query's list), so a relation
may occur twice.
"""

from __future__ import annotations

from dataclasses import dataclass

MOST = 2**64 - 1


@dataclass(frozen=True, order=True)
class ColumnRef:
    binding: int
    column: int

    @property
    def name(self) -> str:
        """Name of the column in a planned DataFrame."""
        return f"b{self.binding}_c{self.column}"

    def to_text(self) -> str:
        return f"{self.binding}.{self.column}"

    def to_sql(self) -> str:
        return f'"{self.binding}".c{self.column}'


@dataclass(frozen=True, order=True)
class Filter:
    column: ColumnRef
    op: str  # < > =
    constant: int

    def __post_init__(self) -> None:
        if self.op not in ("<", ">", "="):
            raise ValueError(f"unknown comparison {self.op!r}")
        if not 0 <= self.constant <= MOST:
            raise ValueError(f"{self.constant} is not an unsigned 64-bit value")

    def to_text(self) -> str:
        return f"{self.column.to_text()}{self.op}{self.constant}"

    def to_sql(self) -> str:
        return f"{self.column.to_sql()} {self.op} {self.constant}"


@dataclass(frozen=True, order=True)
class Join:
    left: ColumnRef
    right: ColumnRef

    def normal(self) -> Join:
        """The same predicate with the lesser column first."""
        return self if self.left <= self.right else Join(self.right, self.left)

    def to_text(self) -> str:
        return f"{self.left.to_text()}={self.right.to_text()}"

    def to_sql(self) -> str:
        return f"{self.left.to_sql()} = {self.right.to_sql()}"


@dataclass(frozen=True)
class Query:
    relations: tuple[int, ...]
    joins: tuple[Join, ...]
    filters: tuple[Filter, ...]
    sums: tuple[ColumnRef, ...]

    def bindings(self) -> range:
        return range(len(self.relations))

    def filters_on(self, binding: int) -> tuple[Filter, ...]:
        return tuple(f for f in self.filters if f.column.binding == binding)

    def needed_columns(self, binding: int, sums: tuple[ColumnRef, ...] | None = None) -> tuple[int, ...]:
        """Columns of a binding that its joins, filters or sums use."""
        used = [c for j in self.joins for c in (j.left, j.right)] + [f.column for f in self.filters] + list(self.sums if sums is None else sums)
        return tuple(sorted({c.column for c in used if c.binding == binding}))

    def to_text(self) -> str:
        """The query's text, joins before filters."""
        where = "&".join(x.to_text() for x in (*self.joins, *self.filters))
        return f"{' '.join(map(str, self.relations))}|{where}|{' '.join(c.to_text() for c in self.sums)}"

    def to_sql(self) -> str:
        """SQL over tables r<id> with columns c<j>; a sum of 0 is NULL, as in the answers."""
        out = ", ".join(f"CAST(NULLIF(SUM({c.to_sql()}), 0) AS BIGINT) AS s{k}" for k, c in enumerate(self.sums))
        tables = ", ".join(f'r{relation} "{binding}"' for binding, relation in enumerate(self.relations))
        where = " AND ".join(x.to_sql() for x in (*self.joins, *self.filters))
        return f"SELECT {out} FROM {tables}" + (f" WHERE {where}" if where else "")

    def tree(self) -> str:
        """A printout of the query, one part a line."""
        lines = ["Sum " + ", ".join(c.to_text() for c in self.sums)]
        lines += [f"  Join {j.to_text()}" for j in self.joins]
        for b in self.bindings():
            lines.append(f"  Scan binding {b}: relation {self.relations[b]}" + "".join(f", {f.to_text()}" for f in self.filters_on(b)))
        return "\n".join(lines)

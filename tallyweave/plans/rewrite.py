"""Rewrites that Catalyst can't do: one sum for columns that joins make equal, and tidy predicates."""

from __future__ import annotations

from dataclasses import dataclass

from .ir import ColumnRef, Join, Query


class Classes:
    """Union-find over columns, joined by equality; a class is named by its least column."""

    def __init__(self, joins: tuple[Join, ...]):
        self.parent: dict[ColumnRef, ColumnRef] = {}
        for join in joins:
            a, b = self.find(join.left), self.find(join.right)
            self.parent[max(a, b)] = min(a, b)

    def find(self, column: ColumnRef) -> ColumnRef:
        root = column
        while self.parent.get(root, root) != root:
            root = self.parent[root]
        while column != root:
            self.parent[column], column = root, self.parent.get(column, root)
        return root


@dataclass(frozen=True)
class Shared:
    """A query whose requested sum i is physical sum ``place[i]`` of ``sums``."""

    query: Query
    sums: tuple[ColumnRef, ...]
    place: tuple[int, ...]


def share_sums(query: Query) -> Shared:
    """Columns of one class have equal values in every joined row, so equal sums: keep one of each class."""
    classes = Classes(query.joins)
    roots = [classes.find(c) for c in query.sums]
    chosen: dict[ColumnRef, ColumnRef] = {}
    for root, column in zip(roots, query.sums, strict=True):
        chosen.setdefault(root, column)
    order = list(chosen)
    return Shared(query, tuple(chosen[r] for r in order), tuple(order.index(r) for r in roots))


def tidy(query: Query) -> Query:
    """Predicates in normal form, each once; a column equal to itself goes."""
    joins = dict.fromkeys(j.normal() for j in query.joins if j.left != j.right)
    return Query(query.relations, tuple(joins), tuple(dict.fromkeys(query.filters)), query.sums)

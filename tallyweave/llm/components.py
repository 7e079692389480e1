"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, materialize, skewed_join

#: A table of so many edges may have a node that many of them share, whose rows are dealt to several tasks.
SALTED_EDGES = 50_000


def _minimum(pairs: DataFrame) -> DataFrame:
    """For each node u of directed pairs (u, v): the least of u and its v."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large(edges: DataFrame, many: bool) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    join = skewed_join(both, _minimum(both), ["u"]) if many else both.join(_minimum(both), "u")
    return join.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _minimum(down)
    hung = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(low.select("u", F.col("m").alias("v"))).filter("u <> v")


def connected_components(edges: DataFrame, left: str, right: str, rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge to another; the component is its least node.

    Every round is a few shuffles of the edge table and is written to the shared folder, so a
    lost executor costs one round at most. Nothing but counts reaches the driver. Null ends,
    loops and repeated edges are ignored; an empty table has an empty result.
    """
    now = materialize(edges.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        after = materialize(_small(_large(now, seen is None or seen[0] > SALTED_EDGES).distinct()).distinct(), "edges")
        discard(now)
        now = after
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())

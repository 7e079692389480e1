"""Packing: length buckets that minimise padding, and token-budget batches inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize
from .tokens import token_counts

MOST_TOKENS, BUCKETS, BATCH_TOKENS = 2048, 16, 65_536
#: Rows that a slot of the numbering holds on average.
SLOT_ROWS = 4096


def choose_bounds(counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets that minimise padding, by dynamic programming.

    ``counts[n]`` sequences have length n; every sequence is padded to the bound of its bucket.
    Best[k][j] is the least padding of lengths up to j in k buckets; each row is one numpy minimum.
    """
    lengths = np.flatnonzero(counts)
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return []
    n = counts[lengths].astype(np.float64)
    rows, tokens = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * lengths)])
    m = len(lengths)
    # padding[i, j]: lengths i..j-1 in one bucket bounded by the last of them
    padding = np.full((m + 1, m + 1), np.inf)
    for j in range(1, m + 1):
        padding[:j, j] = lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
    best, back = np.full(m + 1, np.inf), []
    best[0] = 0
    for _ in range(min(buckets, m)):
        ways = best[:, None] + padding
        ways[0, 0] = 0
        back.append(ways.argmin(axis=0))
        best = ways.min(axis=0)
    bounds, j = [], m
    for step in reversed(back):
        if j == 0:
            break
        if step[j] < j:
            bounds.append(int(lengths[j - 1]))
            j = int(step[j])
    return sorted(bounds)


def pack(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", most: int = MOST_TOKENS, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """(key, piece, start, n_tokens, bucket, bucket_tokens, batch, padding) for each piece of each row.

    Texts of over ``most`` tokens become pieces of ``most`` tokens and a rest, so nothing is cut off.
    The histogram of piece lengths over the whole table (at most ``most`` rows) decides the bucket
    bounds. Inside a bucket, ``batch_tokens // bound`` pieces (one at least) make a batch; batches
    are numbered from 0 in each bucket. Numbering is exact and split: rows are numbered inside slots of about
    SLOT_ROWS rows, and a table of slot counts gives each slot its first number, so a bucket that
    holds most rows is never in one task.

    Null and empty texts have no tokens: one piece of length 0, bucket and batch -1, no padding.
    Null keys and repeated rows are kept row by row; other columns are ignored whatever their names;
    an empty table gives an empty result.
    """
    sizes = materialize(token_counts(docs, tokenizer, key=key, text=text).select(F.col(key).alias("k"), F.col("n_tokens").alias("n")), "lengths")
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / F.lit(most)).cast("int") - 1)
    pieces = sizes.select("k", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = pieces.select("k", "piece", (F.col("piece").cast("long") * most).alias("start"), F.least(F.lit(most).cast("long"), F.col("n") - F.col("piece").cast("long") * most).alias("size"))
    counts = np.zeros(most + 1, np.int64)
    for size, n in pieces.groupBy("size").count().collect():  # at most `most` + 1 rows
        counts[size] = n
    bounds = choose_bounds(counts, buckets)
    slots = max(1, int(counts.sum()) // SLOT_ROWS)
    number = F.lit(-1)
    for b, bound in reversed(list(enumerate(bounds))):
        number = F.when((F.col("size") > 0) & (F.col("size") <= bound), b).otherwise(number)
    rows = pieces.withColumn("bucket", number).withColumn("slot", F.pmod(F.xxhash64("k", "piece", "size"), F.lit(slots)).cast("int"))
    # Per slot the first number: counts of rows before it in its bucket.
    per = rows.groupBy("bucket", "slot").agg(F.count("*").alias("c"))
    first = per.select("bucket", "slot", (F.sum("c").over(Window.partitionBy("bucket").orderBy("slot")) - F.col("c")).alias("before"))
    inside = rows.withColumn("r", F.row_number().over(Window.partitionBy("bucket", "slot").orderBy("k", "piece", "size")))
    numbered = inside.join(first, ["bucket", "slot"])
    bound = F.element_at(F.array(F.lit(0), *(F.lit(x) for x in bounds)), F.col("bucket") + 2)
    each = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.greatest(bound, F.lit(1))))
    batch = F.when(F.col("bucket") < 0, -1).otherwise(F.floor((F.col("before") + F.col("r") - 1) / each))
    return numbered.select(
        F.col("k").alias(key), "piece", "start", F.col("size").alias("n_tokens"), "bucket", bound.cast("long").alias("bucket_tokens"), batch.cast("long").alias("batch"),
        F.when(F.col("bucket") < 0, 0).otherwise(bound - F.col("size")).cast("long").alias("padding"),
    )

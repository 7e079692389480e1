"""URL filtering: ordered host/path rules, then a list of canonical URLs behind a blocked Bloom filter."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import BlockedBloom
from .runtime import materialize, skewed_join

#: Rules become one expression, so their number is bounded.
MOST_RULES = 200

_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOW), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: Column, path: Column, rule: tuple[str, str]) -> Column:
    name, start = rule
    return ((host == name) | host.endswith("." + name)) & path.startswith(start)


#: Characters that need no escape in a path, by the escapes that may stand for them.
PLAIN = tuple((f"%(?i:{ord(c):02X})", c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
#: Then lower-case hexadecimal letters of the escapes that are left.
CAPITALS = tuple((f"%{x}([0-9A-Fa-f])", f"%{x.upper()}$1") for x in "abcdef") + tuple((f"%([0-9A-F]){x}", f"%$1{x.upper()}") for x in "abcdef")


def canonical_host(host: Column) -> Column:
    """Without user information, port and dots at its end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), r"\.++$", "")


def canonical_path(path: Column) -> Column:
    """An empty path is one slash; escapes of characters that need none are undone, in the order of PLAIN, the others in capitals."""
    found, made = (F.split(F.lit(" ".join(x)), " ") for x in zip(*PLAIN, *CAPITALS, strict=True))  # two constants, where 156 literals take seconds to plan
    replaced = F.aggregate(F.sequence(F.lit(1), F.lit(len(PLAIN + CAPITALS))), path, lambda out, k: F.regexp_replace(out, F.element_at(found, k), F.element_at(made, k)))
    plain = F.when(path.contains("%"), replaced).otherwise(path)
    return F.when(path == "", "/").otherwise(plain)


def canonical_entry(entry: Column) -> Column:
    """The host and path of a list entry in canonical form; null without a host."""
    whole = F.when(entry.contains("://"), entry).otherwise(F.concat(F.lit("x://"), entry))
    host = canonical_host(host_of(whole))
    return F.when(host != "", F.concat(host, canonical_path(path_of(whole))))


def _expressions(host: Column, path: Column, depth: int) -> Column:
    """What a list may hold of a URL: for the last labels of the host, up to the ``depth`` that the list has, the whole path and its first slash."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.lit(max(1, depth)), labels)), lambda k: F.call_function("substring_index", host, F.lit("."), -k))
    ways = F.array_distinct(F.array(path, F.substring(path, 1, 1)))
    found = F.flatten(F.transform(suffixes, lambda s: F.transform(ways, lambda w: F.concat(s, w))))
    return F.when(host != "", found).otherwise(F.array().cast("array<string>"))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Iterable[tuple[str, str, str]] = (), *, key: str = "page_id", url: str = "url", list_column: str = "listed", canonical: bool = False) -> DataFrame:
    """(key, host, path, rule, listed, verdict) for each row of ``pages``.

    ``rules`` are (verdict, host, path prefix); a rule fits its host and all subdomains, and the
    longest fitting rule decides. Elsewhere the list decides: ``listed`` holds canonical URLs (host
    and path, no scheme or query; ``host/`` lists a whole domain with its subdomains). A URL's host
    suffixes (as many labels as the list has) with its path go through a blocked Bloom filter of the list; only possible hits reach
    the exact join with the list, which removes false positives. Verdict ``block`` if listed, else
    ``allow``. The filter has a fixed largest size; the list itself is joined by a shuffle (or
    broadcast by the planner if it is small) and may be of any size. ``pages`` are scanned once.

    With ``canonical`` list entries and URLs are compared in canonical form: no scheme, user information, port or dots behind the host, an empty path as
    ``/``, percent escapes normalised (dot segments stay). Else as they are written, but for the host's A-Z. The columns host and path are as written.

    Null URLs and URLs without ``://`` have an empty host and path, no rule and verdict ``allow``.
    Null and repeated keys are kept row by row; null list entries are ignored; other columns of the
    inputs are ignored; an empty list blocks nothing and an empty table gives an empty result.
    """
    rules = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1]))
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules; put them in the list")
    spark = pages.sparkSession
    entry = F.col(list_column).cast("string")
    names = listed.select((canonical_entry(entry) if canonical else entry).alias("entry")).filter("entry is not null").distinct()
    host = F.substring_index("entry", "/", 1)
    depth = names.agg(F.max(F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1)).first()[0] or 0
    hashed = names.select(F.xxhash64("entry").alias("h"))
    bloom = spark.sparkContext.broadcast(BlockedBloom.build(hashed, "h", hashed.count()).words)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(batch.num_columns - 1)
            hit = BlockedBloom(bloom.value).might_hold(hashes.flatten().to_numpy(zero_copy_only=False))
            ends = np.cumsum(hashes.value_lengths().to_numpy(zero_copy_only=False))
            before = np.concatenate([[0], np.cumsum(hit)])
            maybe = before[ends] > before[np.concatenate([[0], ends])[: len(ends)]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(maybe)], [*batch.schema.names[:-1], "maybe"])

    rows = pages.select(F.col(key).alias("k"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for what, name, start in reversed(rules):
        fits = _fits(F.col("host"), F.col("path"), (name, start))
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    form = (canonical_host(F.col("host")), canonical_path(F.col("path"))) if canonical else (F.col("host"), F.col("path"))
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), _expressions(*form, depth).alias("said"))
    rows = rows.withColumn("hashes", F.transform("said", lambda e: F.xxhash64(e)))
    rows = rows.mapInArrow(probe, f"k {pages.schema[key].dataType.simpleString()}, host string, path string, rule string, ruled string, said array<string>, maybe boolean")

    rows = materialize(rows.withColumn("said", F.when(F.col("maybe"), F.col("said"))), "probed")
    hits = rows.filter("maybe").select("said").distinct().select("said", F.explode("said").alias("entry")).join(names, "entry").select("said").distinct()
    hits = materialize(hits.withColumn("listed", F.lit(True)), "listed")
    checked = skewed_join(rows.filter("maybe"), hits, ["said"], "left").unionByName(rows.filter("not maybe").withColumn("listed", F.lit(False)))
    return checked.select(F.col("k").alias(key), "host", "path", "rule", F.coalesce("listed", F.lit(False)).alias("listed"), F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))

"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import text_slices
from .words import NO_PUNCTUATION, WIDTH, shingle_hashes, spans, word_hashes

#: 64 bits in BLOCKS blocks, each searched up to NEAR bits: all fingerprints within RADIUS are found (pigeonhole).
BLOCKS, NEAR = 8, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
LEAST_SIMILARITY = 0.8
#: Items that are collected and broadcast at once (and bytes of their text); more items take more passes.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32 << 20

_BITS = np.arange(64, dtype=np.uint64)


def _signs(hashes: np.ndarray) -> np.ndarray:
    return (((hashes[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) << 1) - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


def simhash(shingles: np.ndarray) -> np.uint64:
    """SimHash of a multiset of shingle hashes, each weighted by how often it occurs."""
    return _pack(_signs(shingles).sum(axis=0)[None])[0]


class HammingIndex:
    """Multi-index of 64-bit fingerprints: for each 8-bit block and value, the items whose block is within NEAR bits of it."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        values = np.arange(256, dtype=np.uint8)
        self.lists = []
        for k in range(BLOCKS):
            own = (prints >> np.uint64(8 * k)).astype(np.uint8)
            close = np.bitwise_count(values[:, None] ^ own[None, :]) <= NEAR
            self.lists.append([np.flatnonzero(row) for row in close])

    def search(self, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's place, items within RADIUS, their distances) for each query that has some."""
        for q, value in enumerate(queries):
            blocks = [(int(value) >> (8 * k)) & 255 for k in range(BLOCKS)]
            found = np.unique(np.concatenate([self.lists[k][b] for k, b in enumerate(blocks)]))
            far = np.bitwise_count(self.prints[found] ^ value)
            near = far <= RADIUS
            if near.any():
                yield q, found[near], far[near]


class Benchmark:
    """The items of one block: shingles, fingerprints by item size, and a table of all shingles."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids, self.items, self.by_size = [], [], {}
        column = pa.array(texts, pa.string())
        for first, _, data, at in text_slices(column):
            starts, ends, rows = spans(data, at, NO_PUNCTUATION)
            words = word_hashes(data, starts, ends)
            for r, (a, b) in enumerate(zip(rows[:-1], rows[1:], strict=True)):
                if b > a:
                    shingles = shingle_hashes(words[a:b], min(WIDTH, b - a))
                    self.by_size.setdefault(int(b - a), []).append(len(self.items))
                    self.items.append((int(b - a), shingles, *np.unique(shingles, return_counts=True)))
                    self.ids.append(ids[first + r])
        self.index = {w: (np.array(own), HammingIndex(np.array([simhash(self.items[i][1]) for i in own], np.uint64))) for w, own in self.by_size.items()}
        #: For each shingle width the items' shingles, sorted, with the item sizes that have them.
        self.known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in sorted({min(WIDTH, w) for w in self.by_size}):
            pairs = [(item[2], item[0]) for item in self.items if min(WIDTH, item[0]) == width]
            keys, sizes = np.concatenate([k for k, _ in pairs]), np.concatenate([np.full(len(k), w) for k, w in pairs])
            order = np.lexsort((sizes, keys))
            keys, sizes = keys[order], sizes[order]
            fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (sizes[1:] != sizes[:-1])])
            keys, sizes = keys[fresh], sizes[fresh]
            bits = max(16, int(len(keys) * 16 - 1).bit_length())
            table = np.zeros(1 << bits, bool)
            table[keys >> np.uint64(64 - bits)] = True
            self.known[width] = (keys, sizes, table)

    def _row(self, words: np.ndarray, width: int, shingles: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """Matches of one text: (item, first word, words, distance, similarity), the best window for each item.

        ``places`` are where a shingle of some item stands. A window with none has similarity 0, so
        only windows that hold one are fingerprinted.
        """
        keys, sizes, _ = self.known[width]
        lo, hi = np.searchsorted(keys, shingles[places], "left"), np.searchsorted(keys, shingles[places], "right")
        starts: dict[int, list[np.ndarray]] = {}
        for place, a, b in zip(places.tolist(), lo.tolist(), hi.tolist(), strict=True):
            for size in sizes[a:b].tolist():
                last = max(0, len(words) - size)
                first = min(max(0, place + width - size), last)
                starts.setdefault(size, []).append(np.arange(first, min(place, last) + 1))
        best: dict[int, tuple[int, int, int, float]] = {}
        for size, runs in starts.items():
            own, index = self.index[size]
            at = np.unique(np.concatenate(runs))
            length = min(size, len(words)) - width + 1
            cuts = np.union1d(np.arange(2048, len(at), 2048), np.flatnonzero(np.diff(at) > 256) + 1)
            for lot in np.split(at, cuts):
                base, top = int(lot[0]), int(lot[-1]) + length
                run = np.zeros((top - base + 1, 64), np.int32)
                np.cumsum(_signs(shingles[base:top]), axis=0, out=run[1:])
                prints = _pack(run[lot - base + length] - run[lot - base])
                for q, found, far in index.search(prints):
                    start = int(lot[q])
                    window = shingles[start : start + length]
                    for item, distance in zip(own[found].tolist(), far.tolist(), strict=True):
                        _, _, kinds, counts = self.items[item]
                        k = np.searchsorted(kinds, window)
                        k[k == len(kinds)] = 0
                        same = np.bincount(k[kinds[k] == window], minlength=len(kinds))
                        both = int(np.minimum(same, counts).sum())
                        likeness = both / (length + int(counts.sum()) - both)
                        if likeness >= LEAST_SIMILARITY and (item not in best or likeness > best[item][3]):
                            best[item] = (start, size, distance, likeness)
        for item, match in sorted(best.items()):
            yield item, *match

    def search(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, int, float]]:
        """(row, item, first word, words, distance, similarity) for a string column."""
        for first, _, data, at in text_slices(column):
            starts, ends, rows = spans(data, at, NO_PUNCTUATION)
            if not len(starts):
                continue
            words = word_hashes(data, starts, ends)
            for width, (keys, _, table) in self.known.items():
                shingles = shingle_hashes(words, width)
                shift = np.uint64(65 - len(table).bit_length())
                maybe = np.flatnonzero(table[shingles >> shift])
                k = np.searchsorted(keys, shingles[maybe])
                k[k == len(keys)] = 0
                maybe = maybe[keys[k] == shingles[maybe]]
                row = np.searchsorted(rows, maybe, "right") - 1
                inside = maybe + width <= rows[row + 1]
                maybe, row = maybe[inside], row[inside]
                cuts = np.flatnonzero(np.diff(row)) + 1
                for places in np.split(maybe, cuts) if len(maybe) else []:
                    r = int(np.searchsorted(rows, places[0], "right")) - 1
                    a, b = int(rows[r]), int(rows[r + 1])
                    for match in self._row(words[a:b], width, shingles[a : b - width + 1], places - a):
                        yield first + r, *match


def benchmark_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> Iterator[tuple[list, list[str]]]:
    """Item ids and texts in blocks of bounded size, by a hash of the item."""
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).filter("i is not null and t is not null")
    size = rows.agg(F.count("*"), F.sum(F.octet_length("t"))).first()
    n = max(1, -(-size[0] // BLOCK_ITEMS), -(-(size[1] or 0) // BLOCK_BYTES))
    for b in range(n):
        found = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).orderBy("i", "t").collect()
        yield [x["i"] for x in found], [x["t"] for x in found]


def contaminated(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, start, n_words, distance, similarity): the best window for each document and item found in it.

    Words are split at white space and ASCII punctuation, A-Z lower-cased. A window has as many words
    as the item. Its SimHash over word shingles is looked up in the multi-index, which finds
    all items of that size within RADIUS bits; weighted Jaccard similarity of the shingles decides
    (0.8 or more). An item of under five words is one shingle. The benchmark is the query set: it is
    broadcast in blocks of at most about BLOCK_ITEMS items, each block one pass over ``docs``. No shuffle.

    Null and empty texts match nothing and null items are ignored; a null key is returned as null;
    repeated rows are answered row by row; other columns are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    out = None
    for ids, texts in benchmark_blocks(benchmark, item, item_text):
        shared = spark.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(*shared.value)
            for batch in batches:
                found = list(bench.search(batch.column(1)))
                at, items, *rest = list(zip(*found, strict=True)) if found else [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array([str(bench.ids[i]) for i in items], pa.string()), *(pa.array(x, pa.int64()) for x in rest[:3]), pa.array(rest[3], pa.float64())],
                    ["k", "i", "start", "n_words", "distance", "similarity"],
                )

        part = rows.mapInArrow(run, f"k {kind}, i string, start long, n_words long, distance long, similarity double")
        out = part if out is None else out.union(part)
    return out.select(F.col("k").alias(key), F.col("i").cast(item_kind).alias(item), "start", "n_words", "distance", "similarity")


def is_contaminated(docs: DataFrame, benchmark: DataFrame, text: Column, *, item: str = "item_id", item_text: str = "text") -> Column:
    """Whether a text holds a benchmark item, as a column for filters; false for null."""
    out = F.lit(False)
    for ids, texts in benchmark_blocks(benchmark, item, item_text):
        out = out | F.arrow_udf(_judge(docs.sparkSession.sparkContext.broadcast((ids, texts))), "boolean")(text)
    return out


def _judge(shared):
    kept: list[Benchmark] = []

    def judge(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(Benchmark(*shared.value))
        flags = np.zeros(len(texts), bool)
        for row, *_ in kept[0].search(texts):
            flags[row] = True
        return pa.array(flags)

    return judge

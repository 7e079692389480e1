"""N-gram Jaccard join over word shingles, with R-trees of count vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import BlockedBloom
from .components import connected_components
from .runtime import discard, fine, materialize, skewed_join, text_slices
from .words import mix, shingle_sets

#: Groups that shingles are hashed to: the dimensions of the points in an R-tree. A larger set is
#: also counted in more groups (4 times as many for 4 times its size, from WIDE on), since the noise of a count falls below the
#: allowed difference when a group holds many shingles.
GROUPS, WIDE = 128, 1024
#: Points in a leaf of the R-tree.
LEAF = 32
#: Members that one list or component has in a task, and shingles of a component; larger ones are split into pairs of chunks.
CHUNK, CHUNK_SHINGLES = 4096, 4 << 20
#: Set sizes fall in steps of 5 %; linked sets differ by 25 % at most, so by no more than SIZE_STEPS steps. The step takes the last byte
#: of a key's hash, so that rows of a key are in order of size and no wider.
SIZE_STEP, SIZE_STEPS, STEP_BITS = 1.05, 5, 8
#: Counters of the frequency sketch, and the least count of a counter in a task that makes it frequent.
SKETCH, FREQUENT = 1 << 20, 8


def groups_of(size: int) -> int:
    """Groups of the fine count vector of a set of this size: GROUPS times a power of 4."""
    groups = GROUPS
    while size > WIDE * (groups // GROUPS):
        groups *= 4
    return groups


def count_vector(shingles: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return np.bincount((shingles >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups)


def fold(vector: np.ndarray, groups: int) -> np.ndarray:
    """The count vector with fewer groups: neighbours are added up, since groups are leading bits."""
    return vector if len(vector) == groups else vector.reshape(groups, -1).sum(axis=1)


def may_link(overlap: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """100 |A and B| >= 80 |A or B|, with |A or B| = sizes - overlap."""
    return 180 * overlap >= 80 * sizes


class CountTree:
    """An R-tree over count vectors, bulk-loaded: points in order of set size and first groups, LEAF to a node, LEAF nodes to one above, up to one level of at most LEAF nodes.

    A node has the upper corner of its box and the least and greatest set size in it. For sets A and B the overlap is at most the sum over
    groups of min(a, b), for any B in a box at most the sum of min(a, upper corner), and never over the lesser set: nodes and points under the bound are pruned.
    ``tested`` counts the points that were compared.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points[:, 1], points[:, 0], sizes)) if len(sizes) > LEAF else np.arange(len(sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.alive = np.ones(len(sizes), bool)
        self.place = np.empty(len(sizes), np.int64)
        self.place[self.order] = np.arange(len(sizes))
        self.tested = 0
        #: From the leaves up: upper corners, least and greatest sizes, living points.
        self.levels = []
        upper, least, most, living = self.points, self.sizes, self.sizes, self.alive.astype(np.int64)
        while len(upper) > LEAF:
            cuts = np.arange(0, len(upper), LEAF)
            upper, living = np.maximum.reduceat(upper, cuts, axis=0), np.add.reduceat(living, cuts)
            least, most = np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)
            self.levels.append((upper, least, most, living))

    def remove(self, which: np.ndarray) -> None:
        at = self.place[which]
        self.alive[at] = False
        for *_, living in self.levels:
            at = at // LEAF
            np.subtract.at(living, at, 1)

    def query(self, point: np.ndarray, size: int) -> np.ndarray:
        """Living points whose overlap bound allows a link to ``point``."""
        at = None
        for upper, least, most, living in reversed(self.levels):
            at = np.arange(len(living)) if at is None else self._below(at, len(living))
            at = at[(living[at] > 0) & may_link(np.minimum(size, most[at]), least[at] + size)]
            at = at[may_link(np.minimum(upper[at], point).sum(axis=1), least[at] + size)]
        at = np.arange(len(self.sizes)) if at is None else self._below(at, len(self.sizes))
        at = at[self.alive[at]]
        self.tested += len(at)
        if len(at):
            at = at[may_link(np.minimum(self.points[at], point).sum(axis=1), self.sizes[at] + size)]
        return self.order[at]

    @staticmethod
    def _below(nodes: np.ndarray, n: int) -> np.ndarray:
        at = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
        return at[at < n]


def spanning_links(points: np.ndarray, sizes: np.ndarray, check: Callable[[int, np.ndarray], np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph whose edges are the pairs under the bound that pass ``check``.

    Breadth first: each point asks the tree for points not reached yet, so a pair inside a component is
    never tried twice and no list of all pairs exists.
    """
    tree, links = CountTree(points, sizes), []
    for seed in range(len(sizes)):
        if not tree.alive[tree.place[seed]]:
            continue
        tree.remove(np.array([seed]))
        queue = [seed]
        while queue:
            one = queue.pop()
            found = tree.query(points[one], int(sizes[one]))
            if check is not None and len(found):
                found = found[check(one, found)]
            if len(found):
                tree.remove(found)
                links += [(one, int(x)) for x in found]
                queue += found.tolist()
    return links


def exact_check(sets: list[np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
    """Whether the set of one member and those of others link, by their true overlaps."""

    def check(one: int, others: np.ndarray) -> np.ndarray:
        mine = sets[one]
        out = np.zeros(len(others), bool)
        for lot in range(0, len(others), 256):
            group = [sets[x] for x in others[lot : lot + 256]]
            size = np.array([len(x) for x in group])
            every = np.concatenate(group)
            k = np.searchsorted(mine, every)
            k[k == len(mine)] = 0
            same = np.add.reduceat(mine[k] == every, np.concatenate([[0], np.cumsum(size)[:-1]]), dtype=np.int64)
            out[lot : lot + 256] = may_link(same, size + len(mine))
        return out

    return check


def fine_check(fine: list[np.ndarray], sizes: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    """Whether the overlap bound in fine groups still allows a link; pairs are compared in the fewer groups of the two."""

    def check(one: int, others: np.ndarray) -> np.ndarray:
        out = np.ones(len(others), bool)
        for k, x in enumerate(others.tolist()):
            groups = min(len(fine[one]), len(fine[x]))
            if groups > GROUPS:
                out[k] = may_link(np.minimum(fold(fine[one], groups), fold(fine[x], groups)).sum(), sizes[one] + sizes[x])
        return out

    return check


def _distinct_texts(batches: Iterator[pa.RecordBatch], column: int, key: int | None = None) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a text column with, for each row, whether it is the first of its text in this task (among rows with a key)."""
    seen: set[int] = set()
    for batch in batches:
        valid = np.ones(batch.num_rows, bool) if key is None else batch.column(key).is_valid().to_numpy(zero_copy_only=False)
        for first, end, data, at in text_slices(batch.column(column)):
            raw = data.tobytes()
            fresh = np.zeros(end - first, bool)
            for r in range(end - first):
                mark = hash(raw[at[r] : at[r + 1]])
                if mark not in seen and valid[first + r]:
                    seen.add(mark)
                    fresh[r] = True
            yield batch, first, data, at, fresh


def _frequencies(texts: DataFrame) -> np.ndarray:
    """For each counter of shingle hashes its level: 0, or 1 + log2 of its count where it is frequent.

    All texts are counted (exact copies once in a task). A task reports the counters that stand out
    from its mean; at most SKETCH sums come back, whatever the corpus. The levels only order
    shingles, so that those of common passages are not used as keys; they never decide a link.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for _, _, data, at, fresh in _distinct_texts(batches, 0):
            sets = [s for s, f in zip(shingle_sets(data, at), fresh, strict=True) if f]
            if sets:
                total += np.bincount((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        mean = total.mean()
        high = np.flatnonzero(total >= max(FREQUENT, mean + 6 * mean**0.5))
        yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(total[high])], ["b", "n"])

    sums = texts.mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    level = np.zeros(SKETCH, np.uint8)
    level[sums.column("b").to_numpy()] = 1 + np.log2(np.maximum(1, sums.column("n").to_numpy())).astype(np.uint8)
    return level


def _prefix(shingles: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 shingles in order of (level, hash). A link has an overlap of at least 0.8 n
    on either side, so two linked sets share one of these."""
    n = len(shingles)
    need = n - (4 * n + 4) // 5 + 1
    rank = level[(shingles & np.uint64(SKETCH - 1)).astype(np.int64)]
    low = shingles[rank == 0][:need]
    if len(low) < need:
        high = np.flatnonzero(rank)
        high = high[np.argsort(rank[high], kind="stable")]
        low = np.concatenate([low, shingles[high[: need - len(low)]]])
    return low


def _class_of(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent hashes of 64 bits for a set. The first tells classes; where two of its values with different second ones meet, the second does."""
    each = [np.add.reduce(mix(shingles ^ np.uint64(salt)), keepdims=True) + np.uint64(len(shingles)) for salt in (0xA5A5A5A55A5A5A5A, 0x3C6EF372FE94F82B)]
    return tuple(int(mix(total)[0].astype(np.int64)) for total in each)


def _vector_bytes(vector: np.ndarray) -> bytes:
    """Counts in the fewest bytes each that hold them all; the reader knows the number of groups."""
    most = vector.max(initial=0)
    return vector.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _vectors(column: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Points of GROUPS counts, and the fine vectors."""
    fine = [np.frombuffer(x, f"<u{len(x) // groups_of(n)}").astype(np.int32) for x, n in zip(column.to_pylist(), sizes.tolist(), strict=True)]
    return np.stack([fold(x, GROUPS) for x in fine]) if fine else np.zeros((0, GROUPS), np.int32), fine


def _profiles(rows: DataFrame, level: np.ndarray) -> DataFrame:
    """(k, n, c, other, prefix, vector) for each row of (k, t): set size, both hashes of its class of equal sets (null if empty); prefix and vector only for the first row of a text in a task."""
    shared = rows.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, data, at, fresh in _distinct_texts(batches, 1, 0):
            ns, cs, others, prefixes, vectors = [], [], [], [], []
            for s, f in zip(shingle_sets(data, at), fresh, strict=True):
                ns.append(len(s))
                c, other = _class_of(s) if len(s) else (None, None)
                cs.append(c)
                others.append(other)
                use = f and len(s) > 0
                prefixes.append(_prefix(s, shared.value).tobytes() if use else None)
                vectors.append(_vector_bytes(count_vector(s, groups_of(len(s)))) if use else None)
            keys = batch.column(0).slice(first, len(ns))
            yield pa.RecordBatch.from_arrays([keys, pa.array(ns, pa.int64()), pa.array(cs, pa.int64()), pa.array(others, pa.int64()), pa.array(prefixes, pa.binary()), pa.array(vectors, pa.binary())], ["k", "n", "c", "other", "prefix", "vector"])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, n long, c long, other long, prefix binary, vector binary")


def _keyed_runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[np.ndarray | pa.Array]]:
    """Batches of rows sorted by their first column, re-cut so that no value of it goes over a cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        if held and held[-1].column(0)[held[-1].num_rows - 1].as_py() == key[0] and key[0] == key[-1]:
            held.append(batch)
            continue
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut == 0:
            if held:
                yield [pa.concat_arrays([b.column(k) for b in held]) for k in range(columns)]
            held = [batch]
        else:
            held.append(batch.slice(0, cut))
            yield [pa.concat_arrays([b.column(k) for b in held]) for k in range(columns)]
            held = [batch.slice(cut)]
    if held:
        yield [pa.concat_arrays([b.column(k) for b in held]) for k in range(columns)]


def _split_long(rows: DataFrame, group: str, *rest: str) -> DataFrame:
    """Rows (group, part, rest): part -1 stays; others are chunks of a long group, which becomes one group for each pair of chunks."""
    long = rows.filter("part >= 0")
    parts = long.groupBy(group).agg((F.max("part") + 1).alias("m"))
    pairs = long.join(parts, group).select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other"))
    new = F.xxhash64(group, F.least("part", "other"), F.greatest("part", "other"))
    return rows.filter("part < 0").select(group, *rest).union(pairs.select(new.alias(group), *rest))


def _size_step(sizes: np.ndarray) -> np.ndarray:
    return np.minimum((1 << STEP_BITS) - 1, np.log(np.maximum(1, sizes)) / np.log(SIZE_STEP)).astype(np.uint64)


def _lists(profiles: DataFrame) -> DataFrame:
    """(g, c): lists of classes that share a prefix shingle and could link by size.

    Lists with one least class become one list (its pairs include theirs), so the many lists of a family of near copies, one for
    each shingle of their prefixes, are about one. Lists of over CHUNK are split into pairs of chunks.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, step = batch.column(0).to_numpy(zero_copy_only=False), _size_step(batch.column(2).to_numpy(zero_copy_only=False))
            raw = batch.column(1).to_pylist()
            for lot in range(0, len(raw), 2000):
                some = raw[lot : lot + 2000]
                n = np.array([len(x) // 8 for x in some], np.int64)
                h = np.frombuffer(b"".join(some), np.uint64) >> np.uint64(STEP_BITS) << np.uint64(STEP_BITS)
                key = h | np.repeat(step[lot : lot + 2000], n)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(c[lot : lot + 2000], n))], ["h", "c"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by (h, c). A run of one shingle is cut where the size step jumps; the rest of it that
        # goes on over the end of a batch is held, but for whole chunks of it.
        h, c, part = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

        def emit(h: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            h, c = h[fresh], c[fresh]
            starts = np.flatnonzero(np.concatenate([[True], h[1:] - h[:-1] > SIZE_STEPS]))
            sizes = np.diff(np.append(starts, len(h)))
            rows = np.repeat(sizes > 1, sizes)
            g, c = np.repeat(np.minimum.reduceat(c, starts), sizes)[rows], c[rows]
            _, once = np.unique(mix(g.view(np.uint64)) + c.view(np.uint64), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(g[once]), pa.array(np.full(len(once), -1, np.int32)), pa.array(c[once])], ["g", "part", "c"])

        def chunk(h: np.ndarray, c: np.ndarray, part: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), part, np.int32)), pa.array(c)], ["g", "part", "c"])

        long, last = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h = np.concatenate([h, batch.column(0).to_numpy(zero_copy_only=False)])
            c = np.concatenate([c, batch.column(1).to_numpy(zero_copy_only=False)])
            jumps = np.flatnonzero(h[1:] - h[:-1] > SIZE_STEPS) + 1
            if long is not None:
                over = len(jumps) > 0 or h[0] - last > SIZE_STEPS
                end = 0 if h[0] - last > SIZE_STEPS else int(jumps[0]) if len(jumps) else len(h)
                while end >= CHUNK or (over and end):
                    take = min(end, CHUNK)
                    last = h[take - 1]
                    yield chunk(np.full(take, long), c[:take], part)
                    h, c, end, part = h[take:], c[take:], end - take, part + 1
                if not over:
                    continue
                long = None
                jumps = np.flatnonzero(h[1:] - h[:-1] > SIZE_STEPS) + 1
            cut = int(jumps[-1]) if len(jumps) else 0
            if cut:
                yield from emit(h[:cut], c[:cut])
                h, c = h[cut:], c[cut:]
            if len(h) >= CHUNK:
                fresh = np.ones(len(c), bool)
                fresh[1:] = c[1:] != c[:-1]
                h, c = h[fresh], c[fresh]
                if len(h) >= CHUNK:
                    long, part = h[0], 0
                while len(h) >= CHUNK:
                    last = h[CHUNK - 1]
                    yield chunk(np.full(CHUNK, long), c[:CHUNK], part)
                    h, c, part = h[CHUNK:], c[CHUNK:], part + 1
        if long is not None and len(h):
            yield chunk(np.full(len(h), long), c, part)
        elif len(h):
            yield from emit(h, c)

    keyed = profiles.filter("prefix is not null and k is not null").select("c", "prefix", "n").mapInArrow(spread, "h long, c long")
    found = keyed.repartition(fine(profiles.sparkSession), F.shiftright("h", STEP_BITS)).sortWithinPartitions("h", "c").mapInArrow(runs, "g long, part int, c long")
    found = materialize(found.distinct(), "lists")
    # Lists that merging made long are cut too.
    long = found.filter("part < 0").groupBy("g").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).filter("chunks > 1")
    if not long.isEmpty():
        cut = found.join(materialize(long, "long-lists"), "g", "left").select("g", F.when((F.col("part") < 0) & (F.col("chunks") > 1), F.pmod(F.xxhash64("c", F.lit("list")), "chunks").cast("int")).otherwise(F.col("part")).alias("part"), "c")
        found = materialize(cut, "cut-lists")
    return _split_long(found, "g", "c").distinct()


def _bound_links(lists: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b): for each list a spanning forest of the pairs of classes that the overlap bound lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, c, n, v in _keyed_runs(batches, 4):
            g, c, n = (x.to_numpy(zero_copy_only=False) for x in (g, c, n))
            v, fine = _vectors(v, n)
            starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            sizes = np.diff(np.append(starts, len(g)))
            two = starts[sizes == 2]
            two = two[may_link(np.minimum(v[two], v[two + 1]).sum(axis=1), n[two] + n[two + 1])]
            check = fine_check(fine, n)
            two = two[[bool(check(at, np.array([at + 1]))[0]) for at in two.tolist()]] if len(two) else two
            a, b = [c[two]], [c[two + 1]]
            for at, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                links = spanning_links(v[at : at + size], n[at : at + size], fine_check(fine[at : at + size], n[at : at + size]))
                if links:
                    x, y = np.array(links).T
                    a.append(c[at + x])
                    b.append(c[at + y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    spark = lists.sparkSession
    placed = lists.join(vectors, "c").select("g", "c", "n", "vector").repartition(fine(spark), "g").sortWithinPartitions("g")
    return placed.mapInArrow(run, "a long, b long")


def _true_links(groups: DataFrame) -> DataFrame:
    """(a, b): for each group of (g, c, t) a spanning forest of its true links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, c, t in _keyed_runs(batches, 3):
            g, c = g.to_numpy(zero_copy_only=False), c.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(g)], strict=True):
                members, sets = [], []
                for _, _, data, offsets in text_slices(t.slice(at, end - at)):
                    sets += shingle_sets(data, offsets)
                for k, s in enumerate(sets):  # another text of the same key is not of this class
                    if len(s) and c[at + k] in _class_of(s):
                        members.append(k)
                own = {int(c[at + k]): k for k in members}
                members = sorted(own.values())
                if len(members) < 2:
                    continue
                sets = [sets[k] for k in members]
                links = spanning_links(np.stack([count_vector(s) for s in sets]), np.array([len(s) for s in sets]), exact_check(sets))
                if links:
                    x, y = np.array(links).T
                    ids = c[at + np.array(members)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y])], ["a", "b"])

    return groups.mapInArrow(run, "a long, b long")


def _classes(profiles: DataFrame) -> DataFrame:
    """(c, least, n, vector, low, high): for each class its least key, set size and count vector, and the range of its second hash."""
    rows = profiles.filter("c is not null and k is not null").groupBy("c")
    one = rows.agg(F.min("k").alias("least"), F.first("n").alias("n"), F.first("vector", ignorenulls=True).alias("vector"), F.min("other").alias("low"), F.max("other").alias("high"))
    return materialize(one, "classes")


def jaccard_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for each row: set size, and the least key reachable by links of Jaccard similarity 0.8 or more.

    1. Equal shingle sets are one class; all that follows is on classes, so copies never meet in a join.
    2. Classes are listed by the shingles of their prefix (rarest first), of which two linked sets share one.
    3. In each list an R-tree of count vectors prunes by the summed coordinate minima; what it lets
       through is kept as a spanning forest, not as pairs. Components of that graph hold all links.
    4. Inside each such component the texts are fetched once (behind a Bloom filter of their keys), and the
       R-tree again leads to pairs, now verified on the true sets. Components of true links are the result.
    Lists and components of over CHUNK classes (or CHUNK_SHINGLES shingles) are split into pairs of chunks. Without a cap: no pair
    that could link is dropped.

    Null and empty texts have 0 shingles and link with nothing: their component is their own key.
    Rows with a null key get a null component and link nothing. Repeated rows are answered row by
    row; other columns are ignored whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    profiles = materialize(_profiles(rows, _frequencies(rows.select("t"))), "profiles")
    classes = _classes(profiles)
    clash = classes.filter("low <> high").select("c")
    if not clash.isEmpty():  # different sets with one hash: their rows go by the other one
        fused = profiles.join(clash.withColumn("clash", F.lit(True)), "c", "left")
        both = profiles.columns
        profiles = materialize(fused.withColumn("c", F.when(F.col("clash"), F.col("other")).otherwise(F.col("c"))).select(*both), "profiles")
        classes = _classes(profiles)
    loose = connected_components(_bound_links(_lists(profiles), classes.select("c", "n", "vector")), "a", "b")

    wanted = materialize(classes.join(loose.withColumnRenamed("node", "c"), "c").select("c", F.col("least").alias("k"), "n", F.col("component").alias("g")), "wanted")
    bloom = spark.sparkContext.broadcast(BlockedBloom.build(wanted.select(F.xxhash64("k").alias("h")), "h", wanted.count()).words)

    @F.arrow_udf("boolean")
    def possible(hashes: pa.Array) -> pa.Array:
        return pa.array(BlockedBloom(bloom.value).might_hold(hashes.to_numpy(zero_copy_only=False)))

    texts = rows.filter("k is not null").filter(possible(F.xxhash64("k")))
    chunks = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / CHUNK_SHINGLES)).cast("int")
    sizes = wanted.groupBy("g").agg(F.when(chunks > 1, chunks).otherwise(0).alias("chunks"))
    placed = wanted.join(sizes, "g").select("c", "k", "g", F.when(F.col("chunks") > 0, F.pmod(F.xxhash64("c"), F.col("chunks")).cast("int")).otherwise(-1).alias("part"))
    groups = _split_long(placed, "g", "c", "k").join(texts, "k").select("g", "c", "t")
    links = _true_links(groups.repartition(fine(spark), "g").sortWithinPartitions("g"))
    true = connected_components(links, "a", "b")

    linked = classes.select("c", "least").join(true.withColumnRenamed("node", "c"), "c")
    roots = linked.groupBy("component").agg(F.min("least").alias("root"))
    named = classes.select("c", "least").join(linked.join(roots, "component").select("c", "root"), "c", "left").select("c", F.coalesce("root", "least").alias("root"))
    named = materialize(named, "named")
    discard(classes, wanted)
    out = skewed_join(profiles.select("k", "n", "c"), named, ["c"], "left")
    own = F.when(F.col("k").isNotNull(), F.coalesce("root", "k"))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))

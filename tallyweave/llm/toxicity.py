"""Toxicity: class-conditional Kneser-Ney models of the characters of words."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .langid import _classes
from .runtime import by_hash, code_points, discard, materialize, text_slices
from .words import mix

#: Characters in the longest n-grams; each order backs off to the one before.
ORDER = 6
#: Weight of the shared probability in a context, as a number of occurrences.
SHARED = 8.0
DISCOUNT = 0.75
#: Share of its words that a toxic text draws from the model of the toxic class; the others are ordinary.
TOXIC_SHARE = 0.01
#: Words without evidence that every text counts as more, when its log-likelihoods are normalised by its length.
MORE_WORDS = 30
#: About so many labelled documents are used at most, chosen by the hash of their key. Up to this bound all are.
MOST_LABELS = 200_000
#: The driver fetches about so many n-grams at once.
FETCHED = 1 << 19
#: Bytes of texts in which equal pairs of words are put together before they are shuffled.
PAIR_BYTES = 8 << 20
#: Words whose odds a worker remembers between texts; with more it starts over.
KNOWN_WORDS = 1 << 20


def _word_codes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters of a run of texts, the start and end of each word (run of letters) among the characters, and its row."""
    codes, first = code_points(data, at)
    code = _classes()[codes]
    inside = np.concatenate([[False], code != 0, [False]])
    edge = np.zeros(len(code) + 1, bool)
    edge[first] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return code, starts, ends, np.searchsorted(first, starts, "right") - 1


def _hash_words(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word, by its characters from first to last."""
    total = np.zeros(len(starts), np.uint64)
    size = ends - starts
    left = np.arange(len(starts))
    for k in range(int(size.max(initial=0))):
        left = left[size[left] > k]
        total[left] = (total[left] * np.uint64(0x100000001B3) + code[starts[left] + k]) * np.uint64(0x9E3779B97F4A7C15)
    return mix(total)


def _grams(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters of words with a start and an end mark: for each place the word, the distance from its start and the character, and for each order the
    64-bit code of the n-gram that ends there; the code less the character is that of its context (the n-gram without its last character).

    An n-gram that would reach over the start is cut at the mark.
    """
    size = ends - starts + 2
    first = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(np.arange(len(starts)), size)
    inner = np.arange(first[-1]) - first[word] - 1
    chars = np.where(inner < 0, 1, 2).astype(np.uint64)
    body = (inner >= 0) & (inner < (ends - starts)[word])
    chars[body] = code[(starts[word] + inner)[body]]
    chars += np.uint64(1)
    grams = np.zeros((ORDER, len(chars)), np.uint64)
    total, factor = np.zeros(len(chars), np.uint64), 1
    for k in range(ORDER):
        ok = np.flatnonzero(inner + 1 >= k)  # places with k characters before them in the word
        total[ok] += chars[ok - k] * np.uint64(factor)
        factor = factor * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        grams[k] = total
    return word, inner, chars, grams


def word_counts(labelled: DataFrame) -> DataFrame:
    """(w, n0, n1) for (t, y): after how many different words a word occurs, in each class.

    These are Kneser-Ney continuation counts: copies and near copies of a text add nothing, a word put in at many places adds much. They
    have no upper bound: the different (word, predecessor) pairs are counted, each with the classes it occurs in, predecessors by their 64-bit hash.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for first, _, data, at in text_slices(batch.column(0), PAIR_BYTES):
                code, starts, ends, row = _word_codes(data, at)
                if not len(starts):
                    continue
                h = _hash_words(code, starts, ends)
                before = np.concatenate([[np.uint64(0)], h[:-1]])
                before[1:][row[1:] != row[:-1]] = 0
                order = np.lexsort((before, h))
                new = np.flatnonzero(np.concatenate([[True], (np.diff(h[order]) != 0) | (np.diff(before[order]) != 0)]))
                classes = np.bitwise_or.reduceat(np.where(label[first + row[order]] == 1, 2, 1).astype(np.int8), new)
                raw, where = code.astype("<u4").tobytes(), order[new]
                words = [raw[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(before[where].view(np.int64)), pa.array(classes)], ["w", "before", "classes"])

    found = labelled.filter("y in (0, 1)").mapInArrow(pairs, "w string, before long, classes byte").groupBy("w", "before").agg(F.bit_or("classes").alias("classes"))
    return found.groupBy("w").agg(*(F.count_if(F.col("classes").bitwiseAND(F.lit(c).cast("byte")) > 0).alias(n) for c, n in ((1, "n0"), (2, "n1"))))


def gram_counts(words: DataFrame) -> DataFrame:
    """(k, gram, last, c0, c1, c) for words with counts: n-grams of k + 1 characters by their 64-bit code, with their last character and their Kneser-Ney counts in each class and in both.

    N-grams of the highest order, and those that begin a word, have the words' counts. The others have continuation counts: before how many
    different characters they stand, in a class or in any.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)])
            for first, _, data, at in text_slices(batch.column(0)):
                codes, edges = code_points(data, at)
                word, inner, chars, grams = _grams(codes, edges[:-1], edges[1:])
                use = np.flatnonzero(inner >= 0)
                mine = n[:, first + word[use]]
                for k in range(ORDER):
                    # The character before the n-gram: none for the highest order and at the start of a word.
                    before = np.where((inner[use] > k - 1) & (k < ORDER - 1), chars[use - np.minimum(k + 1, inner[use] + 1)], np.uint64(0))
                    order = np.lexsort((before, grams[k][use]))
                    own, left = grams[k][use][order], before[order]
                    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (left[1:] != left[:-1])])) if len(own) else np.zeros(0, np.int64)
                    sums = [np.add.reduceat(m[order], new) if len(new) else m[:0] for m in mine]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(new), k, np.int8)), pa.array(own[new].view(np.int64)), pa.array(left[new].astype(np.int32)), pa.array(chars[use][order][new].astype(np.int32)), *map(pa.array, sums)],
                        ["k", "gram", "before", "last", "c0", "c1"],
                    )

    parts = words.mapInArrow(count, "k byte, gram long, before int, last int, c0 long, c1 long")
    parts = parts.groupBy("k", "gram", "before").agg(F.min("last").alias("last"), F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    counted = lambda n, name: F.sum(F.when(F.col("before") == 0, n).otherwise((n > 0).cast("long"))).alias(name)
    return parts.groupBy("k", "gram").agg(F.min("last").alias("last"), counted(F.col("c0"), "c0"), counted(F.col("c1"), "c1"), counted(F.col("c0") + F.col("c1"), "c"))


class Table:
    """Places of 64-bit codes in a list sorted by their scramble, found by its leading bits; absent ones get the place after the last."""

    def __init__(self, keys: np.ndarray) -> None:
        """``keys``: different scrambled codes, sorted."""
        self.__setstate__(np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF)))

    def __getstate__(self) -> np.ndarray:
        return self.keys

    def __setstate__(self, keys: np.ndarray) -> None:
        bits = max(1, len(keys).bit_length() - 2)
        self.keys, self.shift = keys, np.uint64(64 - bits)
        #: For each value of the leading bits the place of the first key from it on.
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32 if len(keys) < 1 << 31 else np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        hashes = mix(codes)
        at = self.first[(hashes >> self.shift).astype(np.int64)]
        left = np.flatnonzero(self.keys[at] < hashes)
        while len(left):
            at[left] += 1
            left = left[self.keys[at[left]] < hashes[left]]
        at[self.keys[at] != hashes] = len(self.keys) - 1
        return at


@dataclass
class Model:
    """For each order the parts of the probabilities in tables as large as the number of n-grams and contexts; then the logistic weights.

    In a context h, P(c) of both classes together is interpolated Kneser-Ney: (count - DISCOUNT) / total, and what the discounts leave times P of the next lower order. In one class
    SHARED occurrences more are spread by P of both together, so what is rare or unseen has one probability in both classes. Each P sums to 1.
    """

    grams: list[Table]
    direct: list[np.ndarray]  # for each order n-grams x 3 (class 0, class 1, both), float32, 0 for an unseen one
    contexts: list[Table]
    backoff: list[np.ndarray]  # for each order contexts x 5: weight of the lower order (3) and of both classes (2), float32
    base: float  # probability of any character below the lowest order
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def __getstate__(self) -> dict:
        """Each executor keeps a broadcast as a file; probabilities repeat, so they pack well."""
        packed = {k: [zlib.compress(x.tobytes(), 1) for x in getattr(self, k)] for k in ("direct", "backoff")}
        return {k: v for k, v in vars(self).items() if k not in ("shared", "known")} | packed

    def __setstate__(self, state: dict) -> None:
        for k, width in (("direct", 3), ("backoff", 5)):
            packed = state.pop(k)
            setattr(self, k, [np.frombuffer(zlib.decompress(packed.pop(0)), np.float32).reshape(-1, width) for _ in range(ORDER)])
        vars(self).update(state)

    def probabilities(self, gram: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """P of each character behind its context, in the classes and in both (3 x places); ``gram`` has the codes of all orders."""
        p = np.full((3, gram.shape[1]), self.base)
        for k in range(ORDER):
            direct = self.direct[k][self.grams[k].find(gram[k])]
            backoff = self.backoff[k][self.contexts[k].find(gram[k] - chars)]
            both = direct[:, 2] + backoff[:, 2] * p[2]
            for y in (0, 1):
                p[y] = direct[:, y] + backoff[:, y] * p[y] + backoff[:, 3 + y] * both
            p[2] = both
        return p

    def word_odds(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log P(word | toxic text) - log P(word | ordinary text): words of a toxic text are of the toxic class in TOXIC_SHARE of all cases, else ordinary."""
        word, inner, chars, grams = _grams(code, starts, ends)
        use = np.flatnonzero(inner >= 0)
        logs = np.log(self.probabilities(grams[:, use], chars[use]))
        odds = np.bincount(word[use], weights=logs[1] - logs[0], minlength=len(starts))
        return np.log1p(TOXIC_SHARE * np.expm1(np.minimum(odds, 100)))

    def remembered_odds(self, kinds: np.ndarray, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """:meth:`word_odds` of different words, given by their sorted hashes too; up to KNOWN_WORDS are remembered."""
        keys, odds = getattr(self, "known", (np.zeros(0, np.uint64), np.zeros(0)))
        at = np.searchsorted(keys, kinds)
        new = at == len(keys)
        new[~new] = keys[at[~new]] != kinds[~new]
        out = np.empty(len(kinds))
        out[~new] = odds[at[~new]]
        out[new] = self.word_odds(code, starts[new], ends[new])
        if len(keys) + new.sum() > KNOWN_WORDS:
            self.known = kinds, out
        else:
            self.known = np.insert(keys, at[new], kinds[new]), np.insert(odds, at[new], out[new])
        return out

    def evidence(self, column: pa.Array) -> np.ndarray:
        """For each text the difference of its log-likelihoods under the two models, normalised by its length in words."""
        out = np.zeros(len(column))
        for first, end, data, at in text_slices(column, 1 << 19):
            code, starts, ends, row = _word_codes(data, at)
            if not len(starts):
                continue
            kinds, where, kind = np.unique(_hash_words(code, starts, ends), return_index=True, return_inverse=True)
            odds = self.remembered_odds(kinds, code, starts[where], ends[where])[kind]
            out[first:end] = np.bincount(row, weights=odds, minlength=end - first) / (np.bincount(row, minlength=end - first) + MORE_WORDS)
        return out


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights and bias by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(w))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fold(key: str = "doc_id") -> Column:
    """0 to 3; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % 4


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", held_out: int = 2, calibrate: int = 3, most: int = MOST_LABELS) -> Model:
    """Fit on labelled documents outside the fold ``held_out``: counts on all folds but ``calibrate``, logistic weights on that one.

    Counts cover all labelled documents (up to ``most``). Executors count words by text and n-grams by word; the driver gets
    the sums of all different n-grams, part by part, and one number for each document of the calibration fold, on which a slope and a bias are fitted.

    Null keys and labels are ignored, null texts are empty; of several labels of one key the greatest counts; repeated documents count once for their words' places, and each in the calibration.
    """
    spark = docs.sparkSession
    said = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("k is not null and y is not null")
    said = said.filter(fold("k") != held_out)
    said = materialize(by_hash(said, "k", most, said.count()).groupBy("k").agg(F.max("y").alias("y")), "labels")
    if said.count() <= 2 * most:  # a key and a byte or so each: some megabytes at most, where a shuffle would move the texts
        said = F.broadcast(said)
    known = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(said, "k")
    counts = materialize(gram_counts(word_counts(known.filter(fold("k") != calibrate).select("t", "y"))), "grams")

    many = {r.k: r.n for r in counts.groupBy("k").agg(F.count("*").alias("n")).collect()}

    def of_order(k: int) -> list[np.ndarray]:
        """Scrambled codes, sorted, with their contexts and counts; fetched in parts, so that the driver never holds all columns twice."""
        parts, n = [], -(-many.get(k, 1) // FETCHED)
        for part in range(n):
            rows = counts.filter((F.col("k") == k) & (F.pmod("gram", F.lit(n)) == part)).select("gram", "last", "c0", "c1", "c").toArrow()
            gram, last, *found = (x.to_numpy() for x in rows.columns)
            code = gram.view(np.uint64)
            parts.append((mix(code), mix(code - last.astype(np.uint64)), *(c.astype(np.min_scalar_type(int(c.max(initial=1)))) for c in found)))
            del rows, gram, last, found, code
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        del parts
        order = np.argsort(columns[0])
        for i, c in enumerate(columns):
            columns[i] = c[order]
        return columns

    grams, direct, contexts, backoff = [], [], [], []
    for i in reversed(range(ORDER)):  # the largest while there is room
        key, before, *found = of_order(i)
        kinds, context = np.unique(before, return_inverse=True)
        del before
        p, rest = np.zeros((len(key) + 1, 3), np.float32), np.zeros((len(kinds) + 1, 5), np.float32)
        for y, c in enumerate(found):
            use = np.flatnonzero(c > 0)
            more = SHARED if y < 2 else 0.0
            total = np.bincount(context[use], weights=c[use], minlength=len(kinds)) + more
            different = np.bincount(context[use], minlength=len(kinds))
            p[use, y] = np.maximum(c[use] - DISCOUNT, 0) / total[context[use]]
            rest[:-1, y] = DISCOUNT * different / total
            if y < 2:
                rest[:-1, 3 + y] = more / total
        rest[-1] = 0, 0, 1, 1, 1  # a context never seen: what both classes have there is what they have one order lower
        for made, one in ((grams, Table(key)), (direct, p), (contexts, Table(kinds)), (backoff, rest)):
            made.insert(0, one)
        del key, found, c, kinds, context, use, total, different, p, rest, one
    discard(counts)
    model = Model(grams, direct, contexts, backoff, 1 / (many.get(0, 0) + 1), np.zeros(2), np.zeros(1), np.ones(1))
    model.shared = spark.sparkContext.broadcast(model)  # the tables; the weights below go with each task
    got = known.filter(fold("k") == calibrate).select("y", _evidence(model.shared)(F.col("t")).alias("x")).toArrow()
    y = got.column("y").to_numpy().astype(np.float64)
    if len(y):
        x = got.column("x").to_numpy()[:, None]
        model.centre, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        model.weights = _logistic((x - model.centre) / model.scale, y)
    return model


def _evidence(shared):
    @F.arrow_udf("double")
    def evidence(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.evidence(texts))

    return evidence


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """(key, score, predicted) for each row: the chance of the toxic label, and whether it is at least ``threshold``.

    The text's log-likelihoods under the models of toxic and ordinary texts are compared: their difference, normalised by length, is the
    one feature of the score, with a slope and a bias. The model (as large as its number of different n-grams) is broadcast; no shuffle.

    Null and empty texts get the score of a text without words. Null keys and repeated rows are kept row by row; other
    columns are ignored; an empty table gives an empty result. With no labels every score is 0.5.
    """
    shared, weights, centre, scale = model.shared, model.weights, model.centre, model.scale

    @F.arrow_udf("double")
    def judge(texts: pa.Array) -> pa.Array:
        x = (shared.value.evidence(texts) - centre[0]) / scale[0]
        return pa.array(1 / (1 + np.exp(-np.clip(x * weights[0] + weights[1], -50, 50))))

    out = docs.select(F.col(key).alias("k"), judge(F.col(text)).alias("score"))
    return out.select(F.col("k").alias(key), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(fold(key) == 2, F.lit(False))

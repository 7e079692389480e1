"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import code_points, text_slices

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: About so many labelled documents at most the model is fitted on, chosen by the hash of their key.
TRAIN_DOCS = 20_000
MOST_LANGS = 200
#: N-grams that count as independent evidence in the score.
EVIDENCE = 64

_letters: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """For each code point: its lower-case form if it is a letter, else 0."""
    if not _letters:
        table = np.zeros(sys.maxunicode + 1, np.uint32)
        for code in range(sys.maxunicode + 1):
            char = chr(code)
            if char.isalpha():
                low = char.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _letters.append(table)
    return _letters[0]


def ngram_buckets(data: np.ndarray, at: np.ndarray, buckets: int = BUCKETS) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the bucket of each character n-gram with the row starts among them; and whether each row has a letter.

    Letters are lower-cased, all else is one blank; runs of blanks count as one.
    """
    codes, first = code_points(data, at)
    code = _classes()[codes]
    edge = np.zeros(len(code) + 1, bool)
    edge[first] = True
    keep = np.ones(len(code), bool)
    if len(code):
        keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | edge[1:-1]
    place = np.concatenate([[0], np.cumsum(keep)])
    code, first = code[keep], place[first]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    seen = np.concatenate([[0], np.cumsum(code != 0)])
    orders = []
    total = np.zeros(len(code), np.uint32)
    for k in range(max(ORDERS)):
        n = max(0, len(code) - k)
        total = total[:n] * np.uint32(0x01000193) + code[k:] + np.uint32(1)
        if k + 1 in ORDERS:
            ok = (row[:n] == row[k:]) & (seen[k + 1 :] > seen[:n])
            h = total[ok] * np.uint32(0x9E3779B1) + np.uint32(k)
            found = ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(8)) % np.uint32(buckets)
            orders.append((found.astype(np.int64), np.concatenate([[0], np.cumsum(ok)])[np.minimum(first, n)]))
    return orders, seen[first[1:]] > seen[first[:-1]]


@dataclass
class Model:
    langs: list[str]
    logs: np.ndarray  # buckets x langs, float32

    def score(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """The likeliest language and its share of the evidence, for each text.

        N-grams of a text are not independent: its log-likelihoods count as the mean of its n-grams times EVIDENCE at most, so the score is a tempered posterior.
        """
        names, scores = [], []
        columns = [np.ascontiguousarray(self.logs[:, k], np.float64) for k in range(len(self.langs))]
        for _, _, data, at in text_slices(column, 1 << 18):
            orders, letters = ngram_buckets(data, at, len(self.logs))
            n = sum(np.diff(first) for _, first in orders)
            total = np.zeros((len(n), len(self.langs)))
            if len(self.langs):
                for found, first in orders:
                    full = np.flatnonzero(np.diff(first) > 0)
                    for k in range(len(self.langs) if len(full) else 0):
                        total[full, k] += np.add.reduceat(columns[k][found], first[:-1][full])
                total *= (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
                odds = np.exp(total - total.max(axis=1, keepdims=True))
                best, share = total.argmax(axis=1), odds.max(axis=1) / odds.sum(axis=1)
            for r in range(len(n)):
                known = letters[r] and len(self.langs) > 0
                names.append(self.langs[best[r]] if known else "und")
                scores.append(float(share[r]) if known else 0.0)
        return names, np.array(scores, np.float64)


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = TRAIN_DOCS, buckets: int = BUCKETS) -> Model:
    """Fit on labelled texts: all of them, or about ``most``, for each language an equal share of that chosen by the hash of their key; of a language with less, all.

    Executors count n-grams in ``buckets`` slots for each language; the driver gets at most
    buckets x languages sums, whatever the size of the corpus.

    Rows with a null key, text or language are not learned from; repeated rows count as often as they stand there; an empty table gives a model of no language; more than MOST_LANGS
    languages raise, since the matrix is broadcast.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).filter("k is not null and l is not null and t is not null")
    sizes = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    each = max(1, most // max(1, len(sizes)))
    large = [lang for lang, n in sizes.items() if n > each] if sum(sizes.values()) > most else []
    keep = ~F.col("l").isin(large)
    for name in large:
        keep = keep | ((F.col("l") == name) & (F.pmod(F.xxhash64("k"), F.lit(sizes[name])) < each))
    sample = rows.filter(keep).select("t", "l")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            for start, end, data, at in text_slices(batch.column(0)):
                own, label = np.unique(names[start:end].astype(str), return_inverse=True)
                total = np.zeros(len(own) * buckets, np.int64)
                for found, first in ngram_buckets(data, at, buckets)[0]:
                    total += np.bincount(np.repeat(label, np.diff(first)) * buckets + found, minlength=len(total))
                for name, part in zip(own.tolist(), total.reshape(len(own), buckets), strict=True):
                    sums[name] = sums.get(name, 0) + part
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(total[at])], ["l", "b", "n"])

    sums = sample.mapInArrow(count, "l string, b long, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    names = sums.column("l").to_pylist()
    langs = sorted(set(names))
    if len(langs) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    counts = np.zeros((buckets, len(langs)))
    if langs:
        place = {name: k for k, name in enumerate(langs)}
        counts[sums.column("b").to_numpy(), [place[x] for x in names]] = sums.column("n").to_numpy()
    prior = counts.sum(axis=1, keepdims=True) + 1.0
    prior /= prior.sum()
    smooth = counts + 0.05 * buckets * prior
    return Model(langs, np.log(smooth / smooth.sum(axis=0, keepdims=True)).astype(np.float32) if langs else np.zeros((buckets, 0), np.float32))


def predict(docs: DataFrame, model: Model, *, text: str = "text", lang_column: str = "lang_pred", score_column: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score (0 to 1) in two more columns, which replace columns of the same names.

    The log-probability matrix (buckets x languages, float32, of bounded size) is broadcast; no
    shuffle. ``und`` with score 0 for null, empty and letterless texts, and for an empty model.
    Ties go to the first language in alphabetical order. Rows are kept one by one.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.logs))

    @F.arrow_udf("lang string, score double")
    def judge(texts: pa.Array) -> pa.Array:
        names, scores = Model(*shared.value).score(texts)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang", "score"])

    rest = [c for c in docs.columns if c not in (lang_column, score_column)]
    found = docs.select(*rest, judge(F.col(text)).alias("__judged"))
    return found.select(*rest, F.col("__judged.lang").alias(lang_column), F.col("__judged.score").alias(score_column))


def held_out(key: str = "doc_id"):
    """The fold that no model here learns languages from; a null key is in no fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))

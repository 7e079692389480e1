"""Quality rules over whole texts, line first, as DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line without any of these marks has no sentence end and fails the punctuation rule.
SENTENCE_MARKS = r"[.!?…。]"
#: A line with at least NAV_LEAST of these and one for NAV_WORDS words or fewer is navigation.
NAV_MARKS, NAV_LEAST, NAV_WORDS = "|›»•", 3, 3
#: A line in which over so many % of the characters are symbols fails the punctuation rule too.
SYMBOL_PERCENT = 5
#: Phrases that mark a line as boilerplate (fixed values).
BOILERPLATE = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "enable javascript", "released under the", "licensed under", "subscribe to our", "click here to", "lorem ipsum")
#: Share of the text (in %) that must be left.
LEFT_PERCENT = 50
BLANKS = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, wherever and however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; split at one plain blank, which needs no regular expression."""
    return F.filter(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), lambda w: w != "")


def _repeated(windows: Column, width: int) -> Column:
    """Words covered by windows that occur twice or more: sort (hash, place), keep places beside an equal hash, add up the union of their spans."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(pairs: Column) -> Column:
        same = lambda a, b: F.element_at(pairs, a)["h"] == F.element_at(pairs, b)["h"]
        beside = lambda x, i: F.when((i > 0), same(F.greatest(i, F.lit(1)), i + 1)).otherwise(False) | F.when(i + 1 < F.size(pairs), same(i + 1, F.least(i + 2, F.size(pairs)))).otherwise(False)
        return F.array_sort(F.transform(F.filter(pairs, beside), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        spans = F.transform(at, lambda p, i: F.when(i + 1 < F.size(at), F.least(F.lit(width), F.element_at(at, F.least(i + 2, F.size(at))) - p)).otherwise(width))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda total, x: total + x)

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(_let(placed, lambda pairs: _let(places(pairs), covered)))


def line_passes(line: Column) -> Column:
    """The line rules: it has a sentence mark and few symbols, is not navigation and holds no boilerplate phrase."""
    marks = F.length(line) - F.length(F.translate(line, NAV_MARKS, ""))
    navigation = (marks >= NAV_LEAST) & (marks * NAV_WORDS >= F.size(words_of(line)) - marks)
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    return line.rlike(SENTENCE_MARKS) & (symbols * 100 <= F.length(line) * SYMBOL_PERCENT) & ~navigation & ~line.rlike("(?i)" + "|".join(BOILERPLATE))


def assess(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """(key, cleaned, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row.

    Lines are judged first; ``cleaned`` has those that pass. A document is rejected when it fails the
    base rules (under 10 words, or over a fifth of its words in repeated windows) or when the lines
    left hold under half of its characters in lines with a word. One map over the scan, no shuffle.

    Null text counts as empty: no words, base_failed, not kept. Repeated rows and null keys are kept
    row by row; other columns are ignored whatever their names; an empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.select("k", "t", words_of(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: F.translate(x, " " + BLANKS, "") != "").alias("lines"))
    n = F.size("w")
    hashed = _let(F.transform("w", lambda x: F.xxhash64(x)), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - width + 1), lambda i: F.xxhash64(*(F.element_at(h, i + k) for k in range(width)))))
    windows = F.when(n >= width, hashed).otherwise(F.array().cast("array<bigint>"))
    total = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    rows = rows.select(
        "k", "lines", n.cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _let(windows, lambda x: _repeated(x, width)).alias("n_repeat_words"),
        F.filter("lines", line_passes).alias("left"),
    )
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    enough = total(F.col("left")) * 100 >= total(F.col("lines")) * LEFT_PERCENT
    return rows.select(F.col("k").alias(key), F.array_join("left", "\n").alias("cleaned"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & enough).alias("kept"))

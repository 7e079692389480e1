"""Token counts of whole texts: batch encoding that returns lengths only."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import text_slices

#: Longer texts are cut at safe boundaries, so that batches stay alike in bytes.
PIECE_BYTES = 1 << 16

#: One blank between ASCII letters, digits or common marks: a piece of this kind of vocabulary never goes over it.
_SAFE = re.compile(rb"(?<=[A-Za-z0-9.,;:!?]) (?=[A-Za-z0-9])")


def sentencepiece_splits(model) -> bool:
    """Whether a text may be cut at a single blank: the blank opens the next word's first piece, as the dummy prefix does for a text's first word.

    True if no piece holds the blank mark behind another character and a probe confirms the prefix.
    """
    mark = "▁"
    pieces = (model.id_to_piece(k) for k in range(model.get_piece_size()))
    if any(mark in piece.lstrip(mark) for piece in pieces):
        return False
    return all(model.encode(f"{a} {b}") == model.encode(a) + model.encode(b) for a, b in (("ab", "cd"), ("x.", "Y"), ("0", "zq9")))


def cut_text(raw: bytes, most: int = PIECE_BYTES) -> list[bytes]:
    """Cut at safe blanks (which go: the library puts one before each text) into parts of about ``most`` bytes; whole if there is none."""
    parts, start = [], 0
    while len(raw) - start > most:
        found = _SAFE.search(raw, start + most)
        if found is None:
            break
        parts.append(raw[start : found.start()])
        start = found.end()
    parts.append(raw[start:])
    return parts


def _sentencepiece(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], sentencepiece_splits(model)


def _tokenizers(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)], False


def _tiktoken(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    model = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(model.encode_ordinary(x)) for x in texts], False


_kept: dict[str, tuple[Callable[[list[str]], list[int]], bool]] = {}


def counter(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """A function from texts to token counts by the library for the file's kind, and whether texts may be cut; one for each Python worker."""
    if path not in _kept:
        kind = path.rpartition(".")[2]
        _kept[path] = {"model": _sentencepiece, "json": _tokenizers, "tiktoken": _tiktoken}[kind](path)
    return _kept[path]


def count_tokens(column: pa.Array, path: str) -> np.ndarray:
    """Token counts of a string column; null counts as empty."""
    count, cuts = counter(path)
    total = np.zeros(len(column), np.int64)
    for first, end, data, at in text_slices(column):
        raw, owner, parts = data.tobytes(), [], []
        for row in range(first, end):
            text = raw[at[row - first] : at[row - first + 1]]
            for part in cut_text(text) if cuts and len(text) > PIECE_BYTES else [text]:
                owner.append(row)
                parts.append(part.decode(errors="replace"))
        if parts:
            np.add.at(total, owner, count(parts))
    return total


def token_counts(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each row of ``docs``.

    ``tokenizer`` is the path of a .model, .json or .tiktoken file that every executor can open.
    Whole texts are counted without begin, end or added special tokens. Texts go to the library in
    batches of about a megabyte, and longer ones in parts cut where no token can lie, so memory does
    not follow the row count of an Arrow batch. No shuffle: the counts are a map over the scan.

    Null and empty texts have 0 bytes and 0 tokens. Bytes that are no UTF-8 are counted as U+FFFD. Null keys, repeated rows and ties are kept row
    by row; other columns are ignored whatever their names; an empty table gives an empty result.
    """
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pa.array(count_tokens(batch.column(1), tokenizer))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts], ["k", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("b"))
    out = rows.mapInArrow(run, f"k {kind.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

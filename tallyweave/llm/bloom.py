"""Blocked Bloom filters, built by executors and of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of 32 bits in a block of the filter, one bit of each is set for a key.
LANES = 8
BITS_PER_KEY = 16
#: Most blocks of 32 bytes that a filter has (16 MB to broadcast); with more keys the exact join behind it gets more rows.
MOST_BLOCKS = 1 << 19


class BlockedBloom:
    """A Bloom filter in blocks of 256 bits: a key sets one bit in each 32-bit word of one block, so a probe reads one cache line."""

    def __init__(self, words: np.ndarray):
        self.words = words  # blocks x LANES, uint32

    _SALT = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)

    @classmethod
    def masks(cls, keys: np.ndarray) -> np.ndarray:
        low = keys.astype(np.uint32)[:, None]
        return np.uint32(1) << ((low * cls._SALT) >> np.uint32(27))

    @staticmethod
    def blocks(keys: np.ndarray, n: int) -> np.ndarray:
        return ((keys.astype(np.uint64) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def build(cls, keys: DataFrame, column: str, n_keys: int) -> BlockedBloom:
        """From a column of 64-bit hashes. Executors fold their keys by block; at most MOST_BLOCKS rows come back."""
        n = int(min(MOST_BLOCKS, max(1, -(-n_keys * BITS_PER_KEY // 256))))

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                at, each = cls.blocks(h, n), cls.masks(h)
                yield pa.RecordBatch.from_arrays([pa.array(at)] + [pa.array(each[:, k].astype(np.int64)) for k in range(LANES)], ["block", *(f"w{k}" for k in range(LANES))])

        parts = keys.select(column).mapInArrow(fold, "block long, " + ", ".join(f"w{k} long" for k in range(LANES)))
        rows = parts.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(LANES))).toArrow()
        words = np.zeros((n, LANES), np.uint32)
        at = rows.column("block").to_numpy()
        for k in range(LANES):
            words[at, k] = rows.column(f"w{k}").to_numpy().astype(np.uint32)
        return cls(words)

    def might_hold(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.astype(np.int64).view(np.uint64)
        want = self.masks(h)
        return ((self.words[self.blocks(h, len(self.words))] & want) == want).all(axis=1)

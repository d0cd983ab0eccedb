"""Helpers the corpus operators share: words, shingles, bounded hash tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CACHED_WORDS = 1 << 18
EMPTY = np.empty(0, np.uint64)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """64-bit hash of a word; remembers words up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text, A-Z in lower case."""
    return text.lower().split() if text else []


def mix(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(31))
    values = values * _MIX
    return values ^ (values >> np.uint64(29))


def shingle_hashes(words: list[bytes], hashes: WordHashes, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles.

    Fewer words than n count as one shingle; the length is part of the hash.
    """
    count = len(words)
    if not count:
        return EMPTY
    single = np.fromiter(map(hashes.__getitem__, words), np.uint64, count)
    width = min(n, count)
    places = count - width + 1
    joined = single[:places].copy()
    for i in range(1, width):
        joined *= _MULTIPLIER
        joined += single[i : i + places]
    joined += np.uint64(width)
    return np.unique(mix(joined))


def binary(text: str) -> Column:
    """Text as bytes: no decoding on the way to Python, invalid bytes included."""
    return F.col(text).cast("binary")


def table_bits(entries: int, most: int, per_entry: int = 16, least: int = 16) -> int:
    """log2 of the cells of a hash table for so many entries, within bounds."""
    return max(least, min(most, (max(entries, 1) * per_entry - 1).bit_length()))


def cell_of(key: Column, bits: int) -> Column:
    """The top ``bits`` bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - bits)


class Membership:
    """Which keys may be in a set: a bit table of bounded size.

    A false positive lets a key through; callers settle those by an exact
    join, so the table only saves work and never decides a result.
    """

    MOST_BITS = 28  # 32 MB

    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table = bits, table

    @classmethod
    def of(cls, keys: DataFrame, key: str, per_entry: int = 16) -> Membership:
        """From a written table of 64-bit keys (it is read twice)."""
        bits = table_bits(keys.count(), cls.MOST_BITS, per_entry)
        cell = cell_of(F.col(key), bits)
        one = F.lit(1).cast("long")
        words = (
            keys.select(F.shiftright(cell, 6).alias("word"), (cell % 64).cast("int").alias("bit"))
            .select("word", F.call_function("shiftleft", one, F.col("bit")).alias("mask"))
            .groupBy("word")
            .agg(F.bit_or("mask").alias("mask"))
            .toArrow()
        )
        table = np.zeros(1 << (bits - 6), np.uint64)
        table[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
        return cls(bits, table)

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        cells = keys.view(np.uint64) >> np.uint64(64 - self.bits)
        return (self.table[cells >> np.uint64(6)] >> (cells & np.uint64(63))) & np.uint64(1) == 1


def slices(batch: pa.RecordBatch, text: int, rows: int = 256, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with few rows and few bytes of text: long texts come alone."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(float)))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = min(max(int(np.searchsorted(ends, before + size, "right")), start + 1), start + rows)
        yield batch.slice(start, stop - start)
        start = stop

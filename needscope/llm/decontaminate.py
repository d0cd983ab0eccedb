"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is contained in a document when at least ``percent`` % of its
n-word shingles occur there. A document is first reduced to the shingles that
some item may have, read from a bit table of bounded size. That changes no
containment and makes a short item large inside a long document. Items are
partitioned by size; for the least size of a partition and the size of the
reduced document, the wanted containment gives the least Jaccard similarity a
match can have, and that the longest bands of the MinHash signature that still
find it with a miss rate under ``MISS``. Where no bands do, the document meets
the partition's items shingle by shingle.

Bands and shingles of items and documents meet in one join on their keys, so
neither the items nor the documents pass through the driver; it sees only the
least size of each partition. Candidates are verified by exact containment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needscope.llm.common import Membership, WordHashes, binary, mix, shingle_hashes, slices, words_of
from needscope.sources.scratch import settle

HASHES = 64
BANDS = (4, 2, 1)  # hashes of a band
MISS = 1e-9
CELLS = 256  # of the bit table for each shingle of an item, while the table is within its bound
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BAND = mix(np.arange(101, 101 + HASHES, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_LIST = np.uint64(0xA0761D6478BD642F)


def signature(shingles: np.ndarray) -> np.ndarray:
    return mix(shingles[:, None] ^ _SEEDS).min(0)


def band_keys(part: int, width: int, signed: np.ndarray) -> np.ndarray:
    """One key for each band of a signature, for items of a size partition."""
    key = np.full(HASHES // width, np.uint64(part * 8 + width))
    for i in range(width):
        key = mix(key * _SEEDS[i] + signed[i::width])
    return mix(key + _BAND[: len(key)])


def list_keys(part: int, shingles: np.ndarray) -> np.ndarray:
    return mix(shingles + _LIST * np.array(part + 1, np.uint64))


def band_width(least: int, size: int, percent: int) -> int | None:
    """Longest bands that find an item of at least ``least`` shingles in a set of ``size``."""
    shared = least * percent / 100
    similar = shared / max(least + size - shared, shared)
    return next((w for w in BANDS if (1 - similar**w) ** (HASHES // w) <= MISS), None)


def partition_of(sizes: np.ndarray) -> np.ndarray:
    return np.log2(sizes).astype(np.int32)


def _item_sets(items: DataFrame, id: str, text: str, n: int) -> DataFrame:
    """(item, item_id, words, part, size, shingles) of the items with words, written."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number = WordHashes(), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, 1):
                words = [words_of(x.as_py()) for x in part.column(1)]
                keep = [i for i, w in enumerate(words) if w]
                found = [shingle_hashes(words[i], hashes, n) for i in keep]
                size = np.array([len(x) for x in found], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(number + np.arange(len(keep))), part.column(0).take(pa.array(keep, pa.int64())), pa.array([min(n, len(words[i])) for i in keep], pa.int32()),
                        pa.array(partition_of(size)), pa.array(size), pa.array([x.tobytes() for x in found], pa.binary()),
                    ],
                    ["item", "item_id", "words", "part", "size", "shingles"],
                )
                number += len(keep)

    rows = items.select(F.col(id).cast("long").alias("item_id"), binary(text).alias("text"))
    return settle(rows.mapInArrow(sets, "item long, item_id long, words int, part int, size long, shingles binary"), "items")


def _pairs(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str, n: int, percent: int) -> DataFrame:
    """(doc columns but the text, item_id, item_shingles, shared) of items contained in documents.

    ``docs`` has the text as binary column ``text`` in the last place.
    """
    held = _item_sets(items, item_id, item_text, n)
    parts = [(r["words"], r["part"], r["least"]) for r in held.groupBy("words", "part").agg(F.min("size").alias("least")).collect()]
    names = [name for name in docs.columns if name != text]
    extra = {f"__{i}": name for i, name in enumerate(names)}
    renamed = docs.toDF(*extra, "__text")
    schema = ", ".join(f"{new} {renamed.schema[new].dataType.simpleString()}" for new in extra)
    schema = schema and schema + ", "

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64))], ["key"])

    universe = settle(held.select("shingles").mapInArrow(spread, "key long").distinct(), "item-shingles")
    may = renamed.sparkSession.sparkContext.broadcast(Membership.of(universe, "key", CELLS))
    widths = sorted({words for words, _, _ in parts})
    fewest = {w: -(-percent * min(least for words, _, least in parts if words == w) // 100) for w in widths}

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number = WordHashes(), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, len(extra)):
                row, words_at, sets = [], [], []
                for at, value in enumerate(part.column(len(extra))):
                    words = words_of(value.as_py())
                    for w in widths:
                        if len(words) >= w:
                            found = shingle_hashes(words, hashes, w)
                            found = found[may.value.may_have(found)]
                            if len(found) >= fewest[w]:
                                row.append(at), words_at.append(w), sets.append(found.tobytes())
                if row:
                    take = pa.array(row)
                    columns = [pa.array(number + np.arange(len(row))), *[c.take(take) for c in part.columns[:-1]], pa.array(words_at, pa.int32()), pa.array(sets, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["row", *extra, "words", "found"])
                    number += len(row)

    reduced = settle(renamed.mapInArrow(reduce, f"row long, {schema}words int, found binary"), "reduced-documents")

    def doc_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = np.frombuffer(value.as_py(), np.uint64)
                signed, keys, listed = signature(found), [], []
                for w, part, least in parts:
                    if w != words or 100 * len(found) < percent * least:
                        continue
                    width = band_width(least, len(found), percent)
                    keys.append(list_keys(part, found) if width is None else band_keys(part, width, signed))
                    listed.append(np.full(len(keys[-1]), width is None))
                if keys:
                    key = np.concatenate(keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key), row)), pa.array(np.full(len(key), words, np.int32)), pa.array(key.view(np.int64)), pa.array(np.concatenate(listed))],
                        ["row", "words", "key", "listed"],
                    )

    def item_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words, part, size, value in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                found = np.frombuffer(value.as_py(), np.uint64)
                signed = signature(found)
                key = np.concatenate([*(band_keys(part, width, signed) for width in BANDS), list_keys(part, found)])
                told = [np.full(len(key), x) for x in (item, np.int32(words), size)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*told, key.view(np.int64))], ["item", "words", "size", "key"])

    asked = reduced.select("row", "words", "found").mapInArrow(doc_keys, "row long, words int, key long, listed boolean")
    offered = held.select("item", "words", "part", "size", "shingles").mapInArrow(item_keys, "item long, words int, size long, key long")
    met = asked.join(offered, ["words", "key"]).groupBy("row", "item", "size").agg(F.sum(F.col("listed").cast("int")).alias("listed"), F.count("*").alias("all"))
    met = met.where((F.col("listed") < F.col("all")) | (100 * F.col("listed") >= percent * F.col("size")))
    met = settle(met.select("row", "item"), "candidates")
    both = met.join(reduced.drop("words"), "row").join(held.select("item", "item_id", "size", "shingles"), "item")
    both = both.select(*extra, "item_id", "size", "found", "shingles")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, wanted = ([np.frombuffer(x.as_py(), np.uint64) for x in batch.column(len(extra) + i)] for i in (2, 3))
            shared = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(found, wanted)], np.int64)
            size = batch.column(len(extra) + 1).to_numpy()
            out = pa.RecordBatch.from_arrays([*batch.columns[: len(extra) + 2], pa.array(shared)], [*extra, "item_id", "item_shingles", "shared"])
            yield out.filter(pa.array(100 * shared >= percent * size))

    return both.mapInArrow(verify, f"{schema}item_id long, item_shingles long, shared long").withColumnsRenamed(extra)


def contamination(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", n: int = 5, percent: int = 80,
) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared): items contained in documents.

    Null, empty and word-free texts contain nothing and, as items, are in
    nothing. An item of m < n words is one shingle of m words and is found in
    every document that has these words side by side. Repeated rows on either
    side give repeated results; ids may be null or shared; extra columns are
    ignored; an empty side gives no rows. Texts are taken whole, however long.
    """
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), binary(text).alias("text"))
    return _pairs(rows, items, "text", item_id, item_text, n, percent)


def without_items(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 5, percent: int = 80
) -> DataFrame:
    """The documents that contain no item, all columns as they are.

    The cases are those of :func:`contamination`; documents without words stay.
    Rows go by the digest of their text, so equal texts go together.
    """
    digest = F.sha1(binary(text))
    dirty = _pairs(docs.select(digest.alias("digest"), binary(text).alias("text")), items, "text", item_id, item_text, n, percent)
    dirty = settle(dirty.select(F.col("digest").alias("__digest")).distinct(), "contaminated-texts")
    return docs.join(dirty, digest == F.col("__digest"), "left_anti")

"""Line dedup by a log-template tree of fixed depth.

A line falls into a leaf by its number of words and its leading words; words
with a digit are variable from the start. Inside a leaf, a word stays constant
at its place if enough documents have it there; all other places are variable.
Lines with the same constants share a template, and a line whose words are all
the same, digits included, is a template without variable places.

One rule says what is enough: something recurs if at least two distinct texts
have it and texts x constant words reach ``support``. With the default of 20,
ten words need two texts, four words five and a single word twenty. Only the
document with the smallest id keeps the lines of a template that recurs.

The first pass reports the leaves and exact lines of each document as hashes.
The second parses only lines whose leaf or exact line may recur. All counts are
combined before they are shuffled, so a line that a third of all documents
share is a single row after the first step. Equal texts count as one document:
copies are not boilerplate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needscope.llm.common import Membership, WordHashes, binary, shingle_hashes, slices, words_of
from needscope.sources.scratch import settle

LEAD = 3  # leading words that pick the leaf; only longer lines have variable places
SUPPORT = 20  # distinct texts x constant words from which lines recur
FEW = 10  # texts of a line below which near copies may stay whole (leave_similar)
CACHED_LINES = 1 << 14
_VARIABLE = re.compile(rb"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*")
_DIGIT = re.compile(rb"[0-9]")
MARK = b"<*>"


def line_keys(words: list[bytes]) -> tuple[bytes, int, int | None]:
    """(line, key of the exact line, key of its leaf) of a line with words."""
    line = b" ".join(words)
    exact = _hash(b"= " + line)
    if len(words) <= LEAD:
        return line, exact, None
    return line, exact, _hash(b"%d " % len(words) + _masked(b" ".join(words[:LEAD])))


def _masked(line: bytes) -> bytes:
    return _VARIABLE.sub(MARK, line) if _DIGIT.search(line) else line


def _hash(value: bytes) -> int:
    return xxhash.xxh64_intdigest(value)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _recurs(texts: str, words: str, support: int) -> Column:
    return (F.col(texts) >= 2) & (F.col(texts) * F.col(words) >= support)


def drop_recurring_lines(
    docs: DataFrame, id: str = "doc_id", text: str = "text", support: int = SUPPORT, constant: float = 0.5,
    leave_similar: int | None = None,
) -> DataFrame:
    """``docs`` with n_lines and n_dropped added and boilerplate lines taken out of the text.

    A template recurs once two or more distinct texts have it and texts x
    constant words reach ``support``; one with variable places must be
    constant in at least ``constant`` of its places. With ``leave_similar``,
    an exact line of fewer than FEW texts stays where the text has at least
    that % of 5-word Jaccard similarity with the one that keeps the line, so
    that a later join sees near copies whole.

    Lines end at ``\\n``; words are told apart as ``[^\\x20\\x09-\\x0D]+`` and
    blank lines stay. Null text stays null and has no lines; empty text is one
    empty line and stays. A document whose lines all go keeps an empty text.
    Repeated rows and equal texts count once and lose the same lines, but for
    the smallest id. A null id never keeps. Columns n_lines and n_dropped of
    the input are replaced, n_chars follows the new text if present, others
    stay as they are. An empty table gives no rows.
    """
    names = [f"__{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, names))
    plain = docs.toDF(*names)
    rows = plain.select(F.col(own[id]).cast("long").alias("id"), F.xxhash64(own[text]).alias("digest"), binary(own[text]).alias("text"))

    keys = _recurring_keys(rows, support)
    lines = settle(_lines_of(rows, keys), "lines")
    places = _in_templates(lines, keys, support, constant)
    exact = lines.select("id", "digest", "place", F.col("exact").alias("key"))
    again = exact.join(keys, "key").where(~F.col("id").eqNullSafe(F.col("first")))
    if leave_similar is None:
        places = places.unionByName(again.select("id", "digest", "place"))
    else:
        again = settle(again, "again-lines")
        places = places.unionByName(again.where(F.col("texts") >= FEW).select("id", "digest", "place"))
        few = again.where(F.col("texts") < FEW).select("id", "digest", "place", "first", "first_digest")
        similar = _similar(rows, few.drop("place").distinct(), settle(_by_text(places), "many-dropped"), leave_similar)
        pair = [F.col(f"few.{x}").eqNullSafe(F.col(f"similar.{x}")) for x in similar.columns]
        few = few.alias("few").join(similar.alias("similar"), pair, "left_anti")
        places = places.unionByName(few.select("id", "digest", "place"))
    gone = settle(_by_text(places), "dropped-lines").select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.col("gone").alias("__gone"))
    joined = plain.join(
        gone, F.col(own[id]).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(own[text]) == F.col("__digest")), "left"
    )
    parts = F.split(own[text], "\n", -1)
    left = _left_of(own[text], "__gone")
    joined = joined.withColumn("__new", F.when(F.col("__gone").isNull(), F.col(own[text])).otherwise(left))
    out = {name: F.col(own[name]) for name in docs.columns}
    out[text] = F.col("__new")
    if "n_chars" in out:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(F.col("__gone").isNull(), F.col(own["n_chars"])).otherwise(F.length("__new").cast(kind))
    out["n_lines"] = F.coalesce(F.size(parts), F.lit(0)).cast("long")
    out["n_dropped"] = F.coalesce(F.size("__gone"), F.lit(0)).cast("long")
    return joined.select(*[column.alias(name) for name, column in out.items()])


def _by_text(places: DataFrame) -> DataFrame:
    return places.groupBy("id", "digest").agg(F.collect_set("place").alias("gone"))


def _left_of(text: str, gone: str) -> Column:
    """The lines of the text that are not in ``gone``."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(gone, i)), "\n")


def _recurring_keys(rows: DataFrame, support: int) -> DataFrame:
    """(key, texts, first, first_digest) of leaves and exact lines that may recur.

    A leaf is as good as its words would be if all were constant. ``first`` is
    the smallest id, null if all ids are.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                found, sizes, counts = [], [], []
                for text in part.column(2):
                    here: dict[int, int] = {}
                    for line in (text.as_py() or b"").split(b"\n"):
                        if words := line.split():
                            _, exact, leaf = line_keys(words)
                            here[exact] = len(words)
                            if leaf is not None:
                                here[leaf] = len(words)
                    found.extend(here), sizes.extend(here.values()), counts.append(len(here))
                row = pa.array(np.repeat(np.arange(part.num_rows), counts))
                yield pa.RecordBatch.from_arrays(
                    [_signed(found), pa.array(sizes, pa.int32()), part.column(0).take(row), part.column(1).take(row)], ["key", "words", "id", "digest"]
                )

    reached = rows.mapInArrow(keys, "key long, words int, id long, digest long").groupBy("key", "words", "digest").agg(F.min("id").alias("id"))
    keeper = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "digest")))
    counted = reached.groupBy("key", "words").agg(F.count("*").alias("texts"), keeper.alias("keeper")).where(_recurs("texts", "words", support))
    return settle(counted.select("key", "texts", F.col("keeper.id").alias("first"), F.col("keeper.digest").alias("first_digest")), "line-keys")


def _lines_of(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Lines that may recur, as hashes: (id, digest, place, leaf, line, words, exact).

    Leaf, line and words are null where only the exact line may recur.
    """
    shared = rows.sparkSession.sparkContext.broadcast(Membership.of(keys, "key"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed, may = _ParsedLines(), shared.value.may_have
        for batch in batches:
            for part in slices(batch, 2):
                at, places, leaves, exacts, texts = [], [], [], [], []
                for row, text in enumerate(part.column(2)):
                    for place, line in enumerate((text.as_py() or b"").split(b"\n")):
                        if words := line.split():
                            whole, exact, leaf = line_keys(words)
                            at.append(row), places.append(place), exacts.append(exact), leaves.append(leaf or 0), texts.append(whole)
                exact, leaf = np.array(exacts, np.uint64), np.array(leaves, np.uint64)
                in_leaf = (leaf != 0) & may(leaf)
                keep = np.flatnonzero(in_leaf | may(exact))
                if not len(keep):
                    continue
                none = ~in_leaf[keep]
                told = [parsed.get(exacts[i], texts[i]) if in_leaf[i] else (0, None) for i in keep]
                take = pa.array(np.array(at)[keep])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(take), part.column(1).take(take), pa.array(np.array(places, np.int32)[keep]),
                        pa.array(leaf[keep].view(np.int64), mask=none), pa.array(np.array([h for h, _ in told], np.uint64).view(np.int64), mask=none),
                        pa.array([w for _, w in told], pa.binary()), pa.array(exact[keep].view(np.int64)),
                    ],
                    ["id", "digest", "place", "leaf", "line", "words", "exact"],
                )

    return rows.mapInArrow(lines, "id long, digest long, place int, leaf long, line long, words binary, exact long")


class _ParsedLines:
    """(hash of the line with variable words masked, 32-bit hashes of its words, 0 for a variable one)."""

    def __init__(self) -> None:
        self.lines: dict[int, tuple[int, bytes]] = {}
        self.words: dict[bytes, int] = {}

    def get(self, exact: int, line: bytes) -> tuple[int, bytes]:
        if (told := self.lines.get(exact)) is None:
            if len(self.lines) >= CACHED_LINES:
                self.lines.clear()
            if len(self.words) >= 1 << 17:
                self.words.clear()
            masked = _masked(line)
            known = self.words
            hashes = [known[w] if w in known else known.setdefault(w, 0 if w == MARK else xxhash.xxh32_intdigest(w)) for w in masked.split()]
            told = self.lines[exact] = _hash(masked), np.array(hashes, np.uint32).tobytes()
        return told


def _in_templates(lines: DataFrame, keys: DataFrame, support: int, constant: float) -> DataFrame:
    """(id, digest, place) of lines of recurring templates, but for those of the first id."""
    hot = lines.where("leaf is not null").join(keys.select(F.col("key").alias("leaf")), "leaf", "left_semi")
    # equal lines once; digests stand for distinct texts
    seen = settle(hot.groupBy("leaf", "line", "digest").agg(F.min("id").alias("id"), F.first("words").alias("words")), "seen-lines")
    distinct = seen.groupBy("leaf", "line").agg(F.count("*").alias("texts"), F.first("words").alias("words"))
    templates = settle(_templates(distinct, support, constant), "templates")
    held = seen.join(templates, "line").groupBy("template", "constants", "digest").agg(F.min("id").alias("id"))
    recurring = held.groupBy("template", "constants").agg(F.count("*").alias("texts"), F.min("id").alias("first"))
    recurring = recurring.where(_recurs("texts", "constants", support))
    known = settle(templates.join(recurring, "template").select("line", "first"), "recurring-lines")
    places = hot.select("id", "digest", "line", "place").join(known, "line")
    return places.where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "digest", "place")


def _templates(lines: DataFrame, support: int, constant: float) -> DataFrame:
    """(line, template, constants) of the distinct lines whose template is constant enough."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.frombuffer(x.as_py(), np.uint32) for x in batch.column(2)]
            if not words:
                continue
            sizes = [len(x) for x in words]
            line, leaf, texts = (np.repeat(batch.column(i).to_numpy(), sizes) for i in (0, 1, 3))
            size, word = np.repeat(np.array(sizes, np.int32), sizes), np.concatenate(words)
            place = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
            fixed = word != 0
            columns = [x[fixed] for x in (line, leaf, place, word.astype(np.int64), texts, size)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["line", "leaf", "place", "word", "texts", "size"])

    kind = "line long, leaf long, place int, word long, texts long, size int"
    open_ = settle(lines.select("line", "leaf", "words", "texts").mapInArrow(places, kind), "line-words")
    fixed = open_.groupBy("leaf", "place", "word", "size").agg(F.sum("texts").alias("all")).where(_recurs("all", "size", support))
    kept = open_.join(fixed.drop("size"), ["leaf", "place", "word"]).groupBy("line", "leaf", "size").agg(
        F.sort_array(F.collect_list(F.struct("place", "word"))).alias("fixed")
    )
    kept = kept.where(F.size("fixed") >= constant * F.col("size"))
    return kept.select("line", F.xxhash64("leaf", "fixed").alias("template"), F.size("fixed").alias("constants"))


def _similar(rows: DataFrame, pairs: DataFrame, gone: DataFrame, percent: int) -> DataFrame:
    """The pairs (id, digest, first, first_digest) of similar texts, without the lines ``gone``."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch, 2):
                sets = [shingle_hashes(words_of(x.as_py()), hashes).tobytes() for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.binary())], ["id", "digest", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for one, other in zip(batch.column(4), batch.column(5)):
                a, b = (np.frombuffer(x.as_py(), np.uint64) for x in (one, other))
                both = len(np.intersect1d(a, b, assume_unique=True))
                near.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select([0, 1, 2, 3]).filter(pa.array(near, pa.bool_()))

    pairs = settle(pairs, "line-pairs")
    wanted = pairs.select("id", "digest").unionByName(pairs.select(F.col("first").alias("id"), F.col("first_digest").alias("digest"))).distinct()
    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.digest") == F.col(f"{b}.digest"))
    texts = rows.alias("r").join(settle(wanted, "paired-texts").alias("w"), same("r", "w"), "left_semi")
    texts = texts.alias("r").join(gone.alias("g"), same("r", "g"), "left").select("r.id", "r.digest", F.col("r.text").cast("string").alias("text"), "gone")
    texts = texts.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(_left_of("text", "gone")).cast("binary"))
    sets = settle(texts.select("id", "digest", "text").mapInArrow(shingles, "id long, digest long, shingles binary"), "paired-shingles")
    sets = sets.dropDuplicates(["id", "digest"])
    one = pairs.alias("p").join(sets.alias("s"), same("p", "s")).select("p.*", F.col("s.shingles").alias("one"))
    other = sets.select(F.col("id").alias("first"), F.col("digest").alias("first_digest"), F.col("shingles").alias("other"))
    both = one.join(other, ["first", "first_digest"]).select("id", "digest", "first", "first_digest", "one", "other")
    return settle(both.mapInArrow(compare, "id long, digest long, first long, first_digest long"), "similar-texts")

"""Spelling variants by a variable-length gram index.

The gram dictionary is pruned by frequency: a gram is extended by one more
character only while more than a threshold of all positions of the vocabulary
hold it. A word is decomposed into the gram that starts at each of its places.
Such a gram depends on its own characters and, if it may be extended, on the
next one, so one edit at place i affects only grams that hold i or that end
just before it and may grow.

A pair of near words is looked for in the class of the shorter length. There,
a gram left of the edit keeps its distance from the start, and one right of it
its distance from the end. A word of the class asks for two of its grams, one
by start and one by end, so far apart that no edit affects both: of the two
lists at least one holds the near word. Among all such choices it takes the
one with the least estimated list entries. Longer words of the class only
answer. A list is read in two parts, as the edit can touch only one half of
what the gram leaves open. Candidates are verified by edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needscope.llm.common import Membership, binary, mix, slices
from needscope.sources.scratch import settle

LEAST_LENGTH = 7  # code points of a word
LEAST_GRAM, MOST_GRAM = 2, 8
DICTIONARY = 1 << 14  # a gram is extended if more than one of so many positions holds it
COSTED = 1 << 18  # grams that one of so many positions holds have their frequency kept
RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
EVERY = 31
COUNTED = 1 << 17  # distinct words a task counts before it passes them on
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CLASS, _AT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xE7037ED1A0B428DB)
_SIDES = np.array([0xA0761D6478BD642F, 0x1D8E4E27C47D124F], np.uint64)
_PARTS = np.array([0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def spelling_variants(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = 2, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word.

    Words are the maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of whole texts, A-Z
    in lower case, of at least LEAST_LENGTH code points and ``least``
    occurrences. Of a run whose crc32 with the id (``<id>:<run>``) is
    divisible by EVERY, the code point crc32 % length is deleted first; a null
    id counts as empty there. Two words are near at edit distance one. The
    form of a word is its near word of most occurrences (ties: the smallest),
    if it has at least ``times`` as many; the root is the last form in a row.

    Null and empty texts have no words; repeated rows and equal texts count as
    often as they occur. Extra columns are ignored; an empty table gives no rows.
    """
    words = settle(count_words(docs, id, text).where(F.col("n") >= least), "words")
    near = settle(near_words(words), "near-words")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    told = words.join(best, "word", "left").withColumn("most", -F.col("best.less"))
    good = F.col("most") >= times * F.col("n")
    told = told.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(good, F.col("best.near")).alias("form"), F.when(good, F.col("most")).alias("form_n"),
    )
    told = settle(told, "forms")
    roots = _roots(told.where("form is not null").select("word", "form")).select("word", F.col("form").alias("root"))
    return told.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def count_words(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(word, n): occurrences, added up inside the tasks first."""
    most = COUNTED

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            for doc, value in zip(batch.column(0), batch.column(1)):
                raw = value.as_py()
                if not raw:
                    continue
                start = zlib.crc32(f"{doc.as_py() or ''}:".encode())
                for word in RUN.findall(raw.lower().decode("utf-8", "replace")):
                    crc = zlib.crc32(word.encode(), start)
                    if crc % EVERY == 0:
                        at = crc % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_LENGTH:
                            continue
                    seen[word] = seen.get(word, 0) + 1
                if len(seen) >= most:
                    yield _counts(seen)
                    seen.clear()
        if seen:
            yield _counts(seen)

    rows = docs.select(F.col(id).cast("string").alias("id"), binary(text).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counts(seen: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])


class Spans:
    """The words of a batch end to end, with hashes of any of their parts.

    All characters are below U+0100, one byte each.
    """

    def __init__(self, words: list[str]):
        self.words = words
        self.size = np.array([len(x) for x in words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        code = np.frombuffer("".join(words).encode("latin-1"), np.uint8).astype(np.uint64) + np.uint64(1)
        total = len(code)
        self.word = np.repeat(np.arange(len(words)), self.size)
        self.at = np.arange(total) - self.start[self.word]
        self.left = self.size[self.word] - self.at  # characters from here to the end
        power = np.cumprod(np.r_[np.uint64(1), np.full(total, _BASE, np.uint64)])
        self.back = np.cumprod(np.r_[np.uint64(1), np.full(total, _INVERSE, np.uint64)])
        self.sums = np.r_[np.uint64(0), np.cumsum(code * power[:-1])]

    def hash(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of the characters at the flat places low to high, without high; the length counts."""
        return mix((self.sums[high] - self.sums[low]) * self.back[low] + (high - low).astype(np.uint64))


class GramDictionary:
    """Frequent grams by hash: which may be extended, and what a list of them costs."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, positions: int):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.most = positions // DICTIONARY
        self.rest = max(1, positions // COSTED)

    def count(self, hashes: np.ndarray) -> np.ndarray:
        """Positions that hold the gram; a low guess where they are too few to be known."""
        if not len(self.hashes):
            return np.full(len(hashes), self.rest)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.counts[at], self.rest)

    def grams(self, spans: Spans, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, whether it may grow, cost) of the gram at each place
        of each word; ``longest`` has the most characters by word."""
        place = np.flatnonzero(spans.left >= LEAST_GRAM)
        most = longest[spans.word[place]]
        length = np.full(len(place), LEAST_GRAM)
        cost = self.count(spans.hash(place, place + length))
        open_ = cost > self.most
        for n in range(LEAST_GRAM + 1, MOST_GRAM + 1):
            longer = np.flatnonzero(open_ & (length == n - 1) & (most >= n) & (spans.left[place] >= n))
            if not len(longer):
                break
            length[longer] = n
            cost[longer] = self.count(spans.hash(place[longer], place[longer] + n))
            open_[longer] = cost[longer] > self.most
        return place, length, open_ & (length < most), cost


def gram_dictionary(words: DataFrame) -> GramDictionary:
    """Counted in two passes, the second only where the first left grams to extend.

    Both thresholds follow the number of positions, so at most COSTED grams of
    a length are kept.
    """
    positions = words.agg(F.sum(F.length("word"))).first()[0] or 0
    middle = 4
    kept = _gram_counts(words, range(LEAST_GRAM, middle + 1), None, positions)
    if len(kept[0]):
        more = _gram_counts(words, range(middle + 1, MOST_GRAM + 1), GramDictionary(*kept, positions), positions)
        kept = tuple(np.concatenate(x) for x in zip(kept, more))
    return GramDictionary(*kept, positions)


def _gram_counts(words: DataFrame, lengths: range, known: GramDictionary | None, positions: int) -> tuple[np.ndarray, np.ndarray]:
    shared = words.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in slices(batch, 0, 4096):
                spans = Spans(part.column(0).to_pylist())
                found = []
                for n in lengths:
                    place = np.flatnonzero(spans.left >= n)
                    if known is not None:
                        place = place[known.count(spans.hash(place, place + lengths[0] - 1)) > known.most]
                    found.append(spans.hash(place, place + n))
                hashes, times = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(times)], ["gram", "n"])

    counted = words.select("word").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    kept = counted.where(F.col("n") > positions // COSTED).toArrow()
    return kept["gram"].to_numpy().view(np.uint64), kept["n"].to_numpy()


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for every ordered pair of words at edit distance one."""
    shared = words.sparkSession.sparkContext.broadcast(gram_dictionary(words))
    kind = "key long, word string, n long"

    def emit(part: pa.RecordBatch, row: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        row = pa.array(row)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column(0).take(row), part.column(1).take(row)], ["key", "word", "n"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 1024):
                spans = Spans(part.column(0).to_pylist())
                yield emit(part, *asked_keys(spans, shared.value))

    asked = settle(words.select("word", "n").mapInArrow(ask, kind), "asked-grams")
    wanted = words.sparkSession.sparkContext.broadcast(Membership.of(asked, "key"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 1024):
                spans = Spans(part.column(0).to_pylist())
                for row, key in answered_keys(spans, shared.value):
                    may = wanted.value.may_have(key)
                    yield emit(part, row[may], key[may])

    held = words.select("word", "n").mapInArrow(answer, kind)
    found = asked.join(held.select("key", F.col("word").alias("near"), F.col("n").alias("near_n")), "key")
    found = found.where((F.levenshtein("word", "near", 1) == 1) & ((F.length("word") < F.length("near")) | (F.col("word") < F.col("near"))))
    # a pair is met under several keys and, if equally long, from both sides
    once = found.select("word", "n", "near", "near_n").distinct()
    back = once.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return once.select("word", "near", "near_n").unionByName(back)


def longest_gram(length: np.ndarray) -> np.ndarray:
    """Half of the word: then a gram by start and one by end always fit side by side."""
    return np.minimum(MOST_GRAM, (length + 1) // 2)


def asked_keys(spans: Spans, grams: GramDictionary) -> tuple[np.ndarray, np.ndarray]:
    """(word, key): two grams of each word that no edit affects both, in two parts each."""
    place, length, grows, cost = grams.grams(spans, longest_gram(spans.size))
    word = spans.word[place]
    reach = spans.at[place] + length + grows  # edits from here on leave the gram as it is
    # cheapest gram at or behind each place; later words stand higher, so they never win for an earlier one
    cost = np.minimum(cost, (1 << 20) - 1)
    behind = np.full(len(spans.word) + 1, np.iinfo(np.int64).max)
    behind[place] = (word << 53) | (cost << 33) | place
    behind = np.minimum.accumulate(behind[::-1])[::-1]
    fits = reach <= spans.size[word] - LEAST_GRAM
    first = np.flatnonzero(fits)
    other = behind[spans.start[word[first]] + reach[first]]
    total = cost[first] + ((other >> 33) & ((1 << 20) - 1))
    order = np.lexsort((total, word[first]))
    chosen = order[np.unique(word[first][order], return_index=True)[1]]
    by_start, by_end = first[chosen], np.searchsorted(place, other[chosen] & ((1 << 33) - 1))
    size = spans.size
    keys = _keys(spans, word[by_start], size[word[by_start]], place[by_start], length[by_start], 0)
    keys += _keys(spans, word[by_end], size[word[by_end]], place[by_end], length[by_end], 1)
    return np.concatenate([row for row, _ in keys]), np.concatenate([key for _, key in keys])


def answered_keys(spans: Spans, grams: GramDictionary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, key) of all grams, in the class of the word's length and in that of one less."""
    for shorter in (0, 1):
        size = spans.size - shorter
        place, length, _, _ = grams.grams(spans, longest_gram(size))
        here = size[spans.word[place]] >= LEAST_LENGTH
        place, length = place[here], length[here]
        for side, offset in enumerate((spans.at[place] + length, spans.left[place])):
            inside = offset <= size[spans.word[place]]  # further out, no word of the class has a gram
            at = place[inside]
            yield from _keys(spans, spans.word[at], size[spans.word[at]], at, length[inside], side)


def _keys(spans: Spans, word: np.ndarray, size: np.ndarray, place: np.ndarray, length: np.ndarray, side: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two list parts of grams by start (side 0) or by end (side 1) in the class ``size``.

    Left of a gram by end, or right of one by start, lies the edit; it leaves
    the near or the far half of that stretch as it is. The near part of a
    stretch right of the gram stands by start and the far one by end, and the
    other way round.
    """
    at, end = spans.at[place], spans.start[word] + spans.size[word]
    if side == 0:
        offset = at + length
        middle = (offset + size + 1) // 2
        parts = ((place + length, spans.start[word] + middle), (end - (size - middle), end))
    else:
        offset = spans.left[place]
        middle = (size - offset) // 2
        parts = ((spans.start[word], spans.start[word] + middle), (end - (size - middle), place))
    key = spans.hash(place, place + length) + _CLASS * size.astype(np.uint64) + _SIDES[side] + _AT * offset.astype(np.uint64)
    return [(word, mix(mix(key) + spans.hash(low, high) + _PARTS[n])) for n, (low, high) in enumerate(parts)]


def _roots(forms: DataFrame) -> DataFrame:
    """(word, form) with each form followed to its last, by doubling: each
    step has ``times`` as many occurrences, so chains are short."""
    while True:
        next_ = forms.select(F.col("word").alias("form"), F.col("form").alias("next"))
        jumped = settle(forms.join(next_, "form", "left").select("word", F.coalesce("next", "form").alias("form"), F.col("next").isNotNull().alias("moved")), "roots")
        forms = jumped.select("word", "form")
        if jumped.where("moved").isEmpty():
            return forms

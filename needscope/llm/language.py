"""Language identification by string kernels.

The blended spectrum kernel counts the character n-grams, n = 1 to 3, that two
texts both hold (presence, not frequency), normalised by both sizes. Nyström
landmarks from the training texts turn it into features, on which one-versus-
rest kernel ridge regression is fitted. A batch of texts is scored by matrix
products: presence by landmarks, then landmarks by languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from needscope.llm.common import binary
from needscope.sources.scratch import settle

CELLS = 1 << 14  # hashed n-grams
PER_LANGUAGE = 400  # training texts of a language
MOST_TRAINING = 8_000  # training texts in all; with many languages each gets fewer
MOST_LANGUAGES = 400  # the most frequent ones are learned, ties by name
PARTS = 32  # of a language, ranked apart before they meet
LANDMARKS = 128
RIDGE = 1e-3
BATCH = 128
CHUNK = 1 << 20  # characters looked at together
UNKNOWN = "und"
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def held_out(id: str) -> Column:
    """crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def grams(text: str) -> np.ndarray:
    """Cells of the character n-grams of the lower-cased text, sorted."""
    present = np.zeros(CELLS, bool)
    lowered = text.lower()
    for start in range(0, max(len(lowered), 1), CHUNK):
        codes = np.frombuffer(lowered[start : start + CHUNK + 2].encode("utf-32-le", "replace"), np.uint32)
        hashed = np.zeros(len(codes), np.uint32)
        for n, multiplier in enumerate(_MULTIPLIERS):
            if len(codes) <= n:
                break
            hashed = (hashed[: len(codes) - n] * np.uint32(0x01000193)) ^ (codes[n:] + np.uint32(n + 1))
            hashed = hashed * multiplier
            present[hashed >> np.uint32(18)] = True
    return np.flatnonzero(present)


def _decoded(value: bytes | None) -> str:
    return value.decode("utf-8", "replace") if value else ""


@dataclass(frozen=True)
class LanguageModel:
    """landmarks: CELLS x m, scaled; weights: m x languages, and an offset row."""

    languages: tuple[str, ...]
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        presence = np.zeros((len(texts), CELLS), np.float32)
        for row, text in enumerate(texts):
            presence[row, grams(text)] = 1
        kernel = presence @ self.landmarks
        kernel /= np.sqrt(np.maximum(presence.sum(1, keepdims=True), 1))
        return kernel @ self.weights[:-1] + self.weights[-1]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        labels, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, text in enumerate(texts) if any(map(str.isalpha, text))] if self.languages else []
        if known:
            found = self.scores([texts[i] for i in known])
            best = found.argmax(1)
            score[known] = np.clip((1 + found[np.arange(len(known)), best]) / 2, 0, 1)
            for i, language in zip(known, best):
                labels[i] = self.languages[language]
        return labels, score


def fit_languages(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fit on a bounded sample: the ``PER_LANGUAGE`` texts of each language with
    the smallest hash of the id, none of the held-out fold, null ids or languages.

    An id counts once for a language, with the text of the least hash, however
    many rows it has. At most MOST_LANGUAGES languages and MOST_TRAINING texts
    take part, each of at most 2 * CELLS bytes once reduced to its n-grams.
    Without such rows the model knows no language and answers ``und``.
    """
    rows = docs.select(F.col(id).alias("id"), binary(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    frequent = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    languages = [r["lang"] for r in frequent.collect()]
    each = min(PER_LANGUAGE, MOST_TRAINING // max(len(languages), 1))
    # first within parts of a language, so that no task ranks more than PARTS * each rows of one
    chosen = rows.where(F.col("lang").isin(languages)).select("id", "lang").distinct()
    chosen = chosen.withColumn("part", F.pmod(F.xxhash64("id", "lang"), F.lit(PARTS)))
    for group in (["lang", "part"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*group).orderBy(F.xxhash64("id"), "id"))
        chosen = chosen.withColumn("place", place).where(F.col("place") <= each).drop("place")
    # written, so that the planner sees its size and leaves the texts unshuffled
    chosen = settle(chosen.select("id", "lang"), "training-ids")

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [grams(_decoded(x.as_py())).astype(np.uint16).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.select([0, 1]).columns, pa.array(cells, pa.binary())], ["id", "lang", "cells"])

    texts = rows.join(chosen, ["id", "lang"]).groupBy("id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    kind = f"id {docs.schema[id].dataType.simpleString()}, lang string, cells binary"
    sample = sorted((r["lang"], str(r["id"]), bytes(r["cells"])) for r in texts.mapInArrow(presence, kind).collect())
    return _fit([lang for lang, _, _ in sample], [np.frombuffer(cells, np.uint16) for _, _, cells in sample])


def _fit(langs: list[str], cells: list[np.ndarray]) -> LanguageModel:
    names = sorted(set(langs))
    if not names:
        return LanguageModel((), np.zeros((CELLS, 0), np.float32), np.zeros((1, 0), np.float32))

    def presence(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), CELLS), np.float32)
        for at, row in enumerate(rows):
            out[at, cells[row]] = 1 / np.sqrt(max(len(cells[row]), 1))
        return out

    target = np.where(np.array(langs)[:, None] == np.array(names), 1.0, -1.0)
    # landmarks by turns from all languages
    turn = np.zeros(len(langs), int)
    seen: dict[str, int] = {}
    for row, name in enumerate(langs):
        turn[row] = seen[name] = seen.get(name, -1) + 1
    chosen = np.argsort(turn, kind="stable")[:LANDMARKS]
    landmarks = presence(chosen).T
    values, vectors = np.linalg.eigh(landmarks.T.astype(np.float64) @ landmarks)
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    blocks = [presence(np.arange(low, min(low + BATCH, len(cells)))) @ landmarks for low in range(0, len(cells), BATCH)]
    features = np.c_[np.concatenate(blocks) @ root, np.ones(len(langs))]
    # every language weighs the same
    weight = (1 / np.array([langs.count(name) for name in names]))[[names.index(x) for x in langs]]
    gram = (features * weight[:, None]).T @ features + RIDGE * np.eye(features.shape[1])
    solved = np.linalg.solve(gram, (features * weight[:, None]).T @ target)
    return LanguageModel(tuple(names), np.ascontiguousarray(landmarks), np.r_[root @ solved[:-1], solved[-1:]].astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with lang_pred and score (0 to 1), one row per row.

    ``und`` with score 0 for null text and text without letters. Whole texts
    count, however long. Columns of ``keep`` called lang_pred or score are
    replaced; others are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [name for name in keep if name not in ("lang_pred", "score")]
    rows = docs.select(*names, binary(text).alias("__text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                labels, scores = shared.value.predict([_decoded(x.as_py()) for x in part.column(len(names))])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(labels, pa.string()), pa.array(scores)], [*names, "lang_pred", "score"])

    kept = rows.select(*names).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(score, kept)


def in_known_language(docs: DataFrame, model: LanguageModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """Documents that some one-versus-rest classifier claims, all columns as
    they are. ``und`` and scores under ``least`` (every classifier says no) go."""
    names = [f"__{i}" for i in range(len(docs.columns))]
    told = identify(docs.toDF(*names), model, names[docs.columns.index(text)], tuple(names))
    kept = told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*names).toDF(*docs.columns)

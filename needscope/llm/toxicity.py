"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of words and their beginnings is
trained from confirmed toxic texts and unlabelled texts. With class prior p,
the risk is p R+(positive) + max(0, R-(unlabelled) - p R-(positive)): the part
that stands for the negatives may not fall below zero, where a step would only
fit the positives among the unlabelled; such a step goes the other way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needscope.llm.common import binary, mix
from needscope.llm.language import held_out

BITS = 18
CELLS = 1 << BITS
PREFIXES = (4, 5, 6)  # bytes of a word's beginnings, which tie its forms together
POSITIVES = 2_000  # texts the model is trained on, at most
UNLABELLED = 6_000
STEPS = 300
RATE = 0.1
DECAY = 1e-4
FEWEST = 5  # positives that must hold a feature
SURPLUS = 5.0  # deviations above chance that a feature's share of the positives must be
_SPACE, _POINT = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_POINT[list(b".,;:!?()\"'")] = True
_FIRST, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_cells(text: bytes | None) -> np.ndarray:
    """Cells of the words of a text and of their beginnings, with repeats.

    A word is told by its first and last eight bytes and its length, without
    one closing punctuation mark.
    """
    if not text:
        return np.empty(0, np.int64)
    codes = np.frombuffer(b" " * 8 + text.lower() + b" " * 8, np.uint8)
    blank = _SPACE[codes]
    starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    ends = ends - (_POINT[codes[ends - 1]] & (ends - starts > 1))
    length = (ends - starts).astype(np.uint64)
    eight = np.lib.stride_tricks.sliding_window_view(codes, 8)
    first, last = eight[starts].copy().view("<u8")[:, 0], eight[ends - 8].copy().view(">u8")[:, 0]
    bits = np.minimum(length, 8) * np.uint64(8)
    mask = np.where(bits == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (bits % 64)) - np.uint64(1))
    keys = [mix((first & mask) * _FIRST ^ (last & mask) * _LAST ^ length)]
    for n in PREFIXES:
        begins = first[length >= n] & np.uint64((1 << 8 * n) - 1)
        keys.append(mix(begins * _FIRST + np.uint64(n)))
    return (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: bytes | None) -> np.ndarray:
    return np.unique(word_cells(text))


@dataclass(frozen=True)
class ToxicModel:
    weights: np.ndarray  # by cell
    offset: float

    def score(self, text: bytes | None) -> float:
        cells = word_cells(text)
        here = np.unique(cells[self.weights[cells] != 0])
        margin = float(self.weights[here].sum()) + self.offset
        return float(1 / (1 + np.exp(-np.clip(margin, -60, 60))))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> ToxicModel:
    """Minimise the non-negative risk with logistic loss by Adam, full batches.

    Without positives there is nothing to learn and every score is near 0.
    """
    weights = np.zeros(CELLS, np.float32)
    if not positive or not unlabelled:
        return ToxicModel(weights, -30.0)
    in_positive = np.bincount(np.concatenate(positive), minlength=CELLS) / len(positive)
    in_all = np.bincount(np.concatenate(unlabelled), minlength=CELLS) / len(unlabelled)
    # what is in no more positives than chance would put there carries noise only
    surplus = (in_positive - in_all) / np.sqrt((in_all + 1 / len(unlabelled)) / len(positive))
    used = np.flatnonzero((surplus > SURPLUS) & (in_positive * len(positive) >= FEWEST))
    if not len(used):
        return ToxicModel(weights, float(np.log(prior / (1 - prior))))
    every = positive + unlabelled
    cells = np.concatenate(every)
    column = np.full(CELLS, -1, np.int32)
    column[used] = np.arange(len(used))
    row = np.repeat(np.arange(len(every)), [len(x) for x in every])
    at = column[cells]
    row, at = row[at >= 0], at[at >= 0]
    is_positive = np.arange(len(every)) < len(positive)
    w, b = np.zeros(len(used)), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, STEPS + 1):
        margin = np.bincount(row, w[at], len(every)) + b
        chance = 1 / (1 + np.exp(-np.clip(margin, -60, 60)))
        # losses: positive log(1 + e^-m), negative log(1 + e^m); slopes c - 1 and c
        loss = np.logaddexp(0, margin)
        negative = loss[~is_positive].mean() - prior * loss[is_positive].mean()
        slope = np.where(is_positive, -prior * chance / is_positive.sum(), chance / (~is_positive).sum())
        if negative >= 0:
            slope = slope + np.where(is_positive, prior * (chance - 1) / is_positive.sum(), 0)
        else:
            slope = -slope
        grad = np.r_[np.bincount(at, slope[row], len(used)) + DECAY * w, slope.sum()]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    weights[used] = w
    return ToxicModel(weights, b)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", seed: int = 11
) -> ToxicModel:
    """Fit on at most ``POSITIVES`` texts labelled 1 and ``UNLABELLED`` texts of
    any kind, those with the smallest hashes of the id; the held-out fold and
    null ids are left out. The class prior is the share of label 1 among the
    labels of the training fold. Repeated rows of one id count once, with the
    text of the least hash.
    """
    rows = docs.select(F.col(id).alias("id"), binary(text).alias("text")).where(F.col("id").isNotNull() & ~held_out("id"))
    known = labels.select(F.col(id).alias("id"), F.col(label).alias("label"))
    known = known.where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out("id"))
    prior = known.agg(F.avg(F.col("label").cast("double"))).first()[0] or 0.0
    order = F.xxhash64("id", F.lit(seed))

    def sample(ids: DataFrame, most: int) -> list[np.ndarray]:
        chosen = ids.select("id").distinct().orderBy(order, "id").limit(most)

        def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = [features(x.as_py()).astype(np.int32).tobytes() for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary())], ["id", "cells"])

        kind = f"id {docs.schema[id].dataType.simpleString()}, cells binary"
        texts = rows.join(chosen, "id").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        found = sorted(texts.mapInArrow(present, kind).collect(), key=lambda r: r["id"])
        return [np.frombuffer(bytes(r["cells"]), np.int32) for r in found]

    positive = sample(known.where(F.col("label") == 1), POSITIVES)
    return train(positive, sample(rows, UNLABELLED), min(max(prior, 1e-4), 0.5))


def score_toxicity(docs: DataFrame, model: ToxicModel, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted), one row per row: score 0 to 1, predicted 1 from 0.5.

    Null and empty texts have no features and get the offset's score, under
    0.5. Whole texts count. Extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([shared.value.score(x.as_py()) for x in batch.column(1)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id).alias("doc_id"), binary(text).alias("text"))
    kind = f"doc_id {docs.schema[id].dataType.simpleString()}, score double, predicted int"
    return rows.mapInArrow(score, kind)

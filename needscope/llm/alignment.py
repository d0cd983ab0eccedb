"""Token alignment of two tokenizers by pointer jumping.

Both tokenizers cut the same bytes. Every token points to its farthest-right
overlapping token, itself where both end together; doubling the pointers of a
whole batch converges to the terminal token of each component, and tokens of
one terminal are a group. All pairs of tokens across a group are links.

How many documents hold a linked pair of ids is counted over the corpus. Tasks
combine the documents of a block, by a bounded number of links, before pairs
are shuffled; counts return to the blocks by a join on the pair, so neither the
pairs of the corpus nor those of a document meet in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needscope.llm.common import binary, slices
from needscope.llm.tokens import PartEncoder, byte_bpe, piece_bpe
from needscope.sources.scratch import settle

BLOCK_LINKS = 2_000_000  # distinct pairs of documents in a block, about
ID_BITS = 24  # of a token id within a pair
GROUPS = "groups"


def groups_of(a_length: np.ndarray, b_length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each A and each B token, numbered from 0 in text order.

    The lengths are bytes of tokens that cover the same bytes end to end;
    several texts may follow each other, as they end together.
    """
    a_end, b_end = np.cumsum(a_length), np.cumsum(b_length)
    over_a, over_b = np.searchsorted(b_end, a_end), np.searchsorted(a_end, b_end)
    terminal = b_end[over_a] == a_end
    own = np.arange(len(a_end))
    pointer = np.r_[np.where(terminal, own, len(own) + over_a), over_b]
    while True:
        further = pointer[pointer]
        if (further == pointer).all():
            break
        pointer = further
    number = (np.cumsum(terminal) - 1)[pointer]
    return number[: len(own)], number[len(own) :]


def links_of(a_group: np.ndarray, b_group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and B tokens of all links, ordered by A token."""
    count = np.bincount(b_group, minlength=int(a_group[-1]) + 1 if len(a_group) else 0)
    times = count[a_group]
    a = np.repeat(np.arange(len(a_group)), times)
    first = np.cumsum(times) - times
    return a, (np.cumsum(count) - count)[a_group[a]] + np.arange(len(a)) - first[a]


class Aligner:
    """Encodes texts by both tokenizers and aligns those that both cover."""

    def __init__(self, a_path: str, b_path: str):
        self.encoders: tuple[PartEncoder, PartEncoder] = byte_bpe(a_path), piece_bpe(b_path)
        self.tables = tuple(encoder.table for encoder in self.encoders)
        self.lengths = tuple(np.array([len(x) for x in table], np.int64) for table in self.tables)
        # an id with the sign behind it: first those of A, then those of B
        self.signs = [b"%d%c" % (i, sign) for table, last in zip(self.tables, b"|;") for i in range(len(table)) for sign in (ord(","), last)]

    def encode(self, raw: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(A ids, B ids) by text; none where the bytes are not those of space + text."""
        texts = [self._text(x) for x in raw]
        known = [i for i, text in enumerate(texts) if text]
        found = [(np.empty(0, np.uint32), np.empty(0, np.uint32))] * len(raw)
        for at, (i, *ids) in enumerate(zip(known, *(encoder.ids([texts[i] for i in known]) for encoder in self.encoders))):
            doubtful = any(encoder.changed[at] for encoder in self.encoders)
            if not doubtful or all(b"".join(map(table.__getitem__, x.tolist())) == b" " + raw[i] for table, x in zip(self.tables, ids)):
                found[i] = tuple(ids)
        return found

    @staticmethod
    def _text(raw: bytes | None) -> str:
        try:
            return raw.decode() if raw else ""
        except UnicodeDecodeError:
            return ""

    def align(self, raw: list[bytes | None]) -> tuple[dict[str, list], np.ndarray, np.ndarray]:
        """(columns by document, keys of distinct links, their numbers).

        A key is the document's place, the A id and the B id in one number.
        """
        pairs = self.encode(raw)
        a, b = (np.concatenate(x).astype(np.int64) for x in zip(*pairs))
        a_end, b_end = (np.cumsum([0, *map(len, x)]) for x in zip(*pairs))
        a_group, b_group = groups_of(self.lengths[0][a], self.lengths[1][b])
        number = int(a_group[-1]) + 1 if len(a_group) else 0
        of_a, of_b = np.bincount(a_group, minlength=number), np.bincount(b_group, minlength=number)

        # text of the groups: ids in order, A tokens of a group before its B tokens
        last = lambda group: np.r_[group[1:] != group[:-1], np.ones(min(1, len(group)), bool)]
        signs = np.empty(len(a) + len(b), np.int64)
        signs[np.arange(len(a)) + (np.cumsum(of_b) - of_b)[a_group]] = 2 * a + last(a_group)
        signs[np.arange(len(b)) + np.cumsum(of_a)[b_group]] = 2 * (len(self.tables[0]) + b) + last(b_group)
        ends = a_end + b_end
        texts = [b"".join(map(self.signs.__getitem__, signs[low:high].tolist()))[:-1] for low, high in zip(ends, ends[1:])]

        doc = np.repeat(np.arange(len(raw)), np.diff(a_end))
        left, right = links_of(a_group, b_group)
        key, times = np.unique((doc[left] << (2 * ID_BITS)) | (a[left] << ID_BITS) | b[right], return_counts=True)
        columns = {
            "n_a": np.diff(a_end), "n_b": np.diff(b_end), GROUPS: texts,
            "n_groups": np.bincount(doc[np.flatnonzero(last(a_group))], minlength=len(raw)),
            "n_links": np.bincount(doc[left], minlength=len(raw)),
        }
        return columns, key, times


class _Block:
    """Documents of one task until their links fill a block."""

    def __init__(self, number: int, ids: pa.DataType):
        self.number, self.ids, self.parts, self.links = number, ids, [], 0

    def add(self, docs: pa.Array, columns: dict, key: np.ndarray, times: np.ndarray) -> None:
        self.parts.append((docs, columns, key, times))
        self.links += len(key)

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The documents, with their links as places in the block's sorted pairs, and the pairs."""
        mask = (np.int64(1) << (2 * ID_BITS)) - 1
        pair, place, docs = np.unique(np.concatenate([key & mask for _, _, key, _ in self.parts]), return_inverse=True, return_counts=True)
        done = 0
        for ids, columns, key, times in self.parts:
            ends = np.searchsorted(key >> (2 * ID_BITS), np.arange(1, len(ids)))
            cut = lambda values: [x.astype("<u4").tobytes() for x in np.split(values, ends)]
            told = {"doc_id": ids, "places": cut(place[done : done + len(key)]), "times": cut(times), **columns}
            done += len(key)
            yield self._batch(schema, told, len(ids))
        yield self._batch(schema, {"pair": pair, "docs": docs}, len(pair))

    def _batch(self, schema: pa.Schema, told: dict, rows: int) -> pa.RecordBatch:
        told["block"] = np.full(rows, self.number)
        arrays = [pa.nulls(rows, f.type) if f.name not in told else told[f.name] if isinstance(told[f.name], pa.Array) else pa.array(told[f.name], f.type) for f in schema]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)


def align_tokens(
    docs: DataFrame, a_path: str, b_path: str, id: str = "doc_id", text: str = "text", of_groups: dict[str, Column] | None = None
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), one row per row.

    A encodes space + text by a byte-level tokenizer, B the text by one of
    pieces that adds the space; strings of special tokens are plain text.
    Null and empty text, text that is not UTF-8, and text whose joined bytes A
    or B changes have no tokens: zeros and an empty string. ``groups`` lists
    the ids of each group, ``a1,a2|b1;a3|b2,b3``; ``of_groups`` names columns
    made of it instead. The count of a pair of ids is the number of rows that
    hold it linked, so repeated rows count again; n_best are the links whose
    count is the highest of their A id, count_sum adds the counts of all
    links. Extra columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema[id].dataType.simpleString()
    counted = "n_a long, n_b long, n_groups long, n_links long"
    kinds = f"block long, doc_id {kind}, {counted}, {GROUPS} string, places binary, times binary, pair long, docs long"
    rows, most = docs.select(F.col(id).alias("doc_id"), binary(text).alias("text")), BLOCK_LINKS

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = Aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        schema = block = None
        for batch in batches:
            ids = batch.schema.field(0).type
            schema = schema or pa.schema([
                ("block", pa.int64()), ("doc_id", ids), *[(x, pa.int64()) for x in ("n_a", "n_b", "n_groups", "n_links")], (GROUPS, pa.string()),
                ("places", pa.binary()), ("times", pa.binary()), ("pair", pa.int64()), ("docs", pa.int64()),
            ])
            for part in slices(batch, 1):
                block = block or _Block(number, ids)
                block.add(part.column(0), *aligner.align([x.as_py() for x in part.column(1)]))
                if block.links >= most:
                    yield from block.batches(schema)
                    block, number = None, number + 1
        if block:
            yield from block.batches(schema)

    made = {GROUPS: F.col(GROUPS)} if of_groups is None else of_groups
    found = rows.mapInArrow(align, kinds)
    found = settle(found.select(*[c for c in found.columns if c != GROUPS], *[column.alias(f"of_{name}") for name, column in made.items()]), "aligned")
    pairs = found.where("pair is not null").select("block", "pair", "docs")
    counts = settle(pairs.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.shiftright("pair", ID_BITS)), "pair-counts")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    known = counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    told = pairs.select(F.col("block").alias("in_block"), "pair").join(known, "pair")

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("pair")
        count, best = right["count"].to_numpy(), right["best"].to_numpy()
        places, times = ([np.frombuffer(x.as_py(), "<u4") for x in left[name]] for name in ("places", "times"))
        n_best = [int(t[best[p]].sum()) for p, t in zip(places, times)]
        count_sum = [int((t * count[p]).sum()) for p, t in zip(places, times)]
        left = left.drop_columns(["block", "places", "times"])
        return left.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    held = found.where("pair is null").drop("pair", "docs")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    extra = [f"`of_{name}` {held.schema[f'of_{name}'].dataType.simpleString()}" for name in made]
    schema = f"doc_id {kind}, {counted}, {', '.join(extra)}, n_best long, count_sum long"
    out = held.groupBy("block").cogroup(told.groupBy("in_block")).applyInArrow(add_up, schema)
    return out.select(*names, *[F.col(f"of_{name}").alias(name) for name in made])

"""Best-fit packing of tokenized documents, planned on a histogram of lengths.

Pieces of one length are alike, so best-fit decreasing runs over counts: the
pieces of a length go, as many at a time as there are equal sequences, into
the sequences with the least room that holds them. The plan names, for ranges
of the ranks within a length, the sequence and the place in it. Its size
follows the capacity, not the corpus. Pieces are ranked within their length,
in parts of bounded size, and take the slot of their rank.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from needscope.llm.common import binary, slices
from needscope.llm.tokens import word_bpe
from needscope.sources.scratch import settle

CAPACITY = 4_096  # tokens of a sequence
END = 1  # id behind each document
PART_ROWS = 500_000  # pieces of a length ranked in one task, about


def pieces(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids): documents as little-endian 32-bit ids.

    A document is the ids of its text and the id ``end``. Only one longer than
    ``capacity`` is cut, into full pieces and a last one that may be shorter.
    Null and empty text is the id ``end`` alone; bytes that are not UTF-8 are
    read as U+FFFD. Repeated rows stay; extra columns are ignored; an empty
    table gives no rows.
    """
    kind = docs.schema[id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_bpe(tokenizer)
        for batch in batches:
            for part in slices(batch, 1):
                texts = [(x.as_py() or b"").decode("utf-8", "replace") for x in part.column(1)]
                row, number, start, length, ids = [], [], [], [], []
                for at, found in enumerate(encoder.ids(texts)):
                    whole = np.r_[found, np.uint32(end)].astype("<u4")
                    for place, low in enumerate(range(0, len(whole), capacity)):
                        here = whole[low : low + capacity]
                        row.append(at), number.append(place), start.append(low), length.append(len(here)), ids.append(here.tobytes())
                columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col(id).alias("doc_id"), binary(text).alias("text"))
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids binary")


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces a sequence, offset), in this order.

    Best-fit decreasing. A group is a number of sequences with the same
    content, a chain of (length, pieces); a length splits at most one group.
    """
    room: dict[int, list] = {}  # room left -> groups (sequences, content)
    rooms: list[int] = []

    def put(left: int, sequences: int, content: tuple | None) -> None:
        if sequences:
            if left not in room:
                insort(rooms, left)
            room.setdefault(left, []).append((sequences, content))

    for length in sorted(histogram, reverse=True):
        open_ = histogram[length]
        while open_:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                sequences, content = room[left].pop()
                if not room[left]:
                    del room[left], rooms[at]
            else:
                left, content = capacity, None
                sequences = -(-open_ // (capacity // length))
            each = left // length
            full, rest = min(sequences, open_ // each), 0
            put(left - each * length, full, (content, length, each))
            open_ -= full * each
            if full < sequences and open_:
                rest, open_ = open_, 0
                put(left - rest * length, 1, (content, length, rest))
            put(left, sequences - full - (rest > 0), content)

    rows, sequence, rank = [], 0, dict.fromkeys(histogram, 0)
    for groups in room.values():
        for sequences, content in groups:
            chain = []
            while content:
                content, length, each = content
                chain.append((length, each))
            offset = 0
            for length, each in reversed(chain):
                rows.append((length, rank[length], sequence, each, offset))
                rank[length] += sequences * each
                offset += length * each
            sequence += sequences
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` with sequence_id and offset, for a written table of pieces.

    Needs doc_id, piece and a length from 1 to ``capacity``; all columns stay,
    but for sequence_id and offset, which are replaced. Equal rows are ranked
    in any order. Offsets of a sequence are gapless from 0.
    """
    cut = cut.drop("sequence_id", "offset")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # a row per length
    shared = cut.sparkSession.sparkContext.broadcast(plan_slots(histogram, capacity))
    parts = -(-max(histogram.values(), default=1) // PART_ROWS)
    order = [name for name in cut.columns if name != "length"]
    dealt = cut.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    counts = dealt.groupBy("length", "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"), "rank-starts")
    within = F.row_number().over(Window.partitionBy("length", "__part").orderBy(*order)) - 1
    ranked = dealt.withColumn("__rank", within).join(starts, ["length", "__part"])
    ranked = ranked.select(*cut.columns, (F.col("__before") + F.col("__rank")).alias("__rank"))
    names = cut.columns
    length_at, rank_at = names.index("length"), len(names)

    def slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        keys = (plan[:, 0] << 44) | plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (length_at, rank_at))
            here = plan[np.searchsorted(keys, (length << 44) | rank, "right") - 1] if len(plan) else plan
            turn = rank - here[:, 1]
            columns = [pa.array(here[:, 2] + turn // here[:, 3]), pa.array(here[:, 4] + turn % here[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(slot, cut.schema.add("sequence_id", "long").add("offset", "long"))


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, of at most the capacity."""
    held = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(held, F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))

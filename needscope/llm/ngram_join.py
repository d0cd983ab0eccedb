"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when their sets of n-word shingles have a Jaccard
similarity of at least ``percent`` / 100. Shingles stand in one global order:
rare ones first, those seen often in the corpus last, by frequency class and
hash. If two sets of sizes a and b link, they share at least
``t = ceil(percent * size / 100)`` shingles for either size, and so at least k
of the first ``size - t + k`` of both, for any k. Each document picks its own
k: a longer prefix meets more lists but needs more matches before its pair is
verified. The choice minimises estimated list entries plus estimated
verifications, both read from the frequency classes. A pair is a candidate
when it shares min(k1, k2) prefix shingles.

Frequencies only shape order and cost, never the result, so they are kept in
a table of bounded size. They are counted over all documents, for the part of
each set in which its prefix can lie.

Lists of at most ``SMALL`` documents are paired in full. The documents of
longer lists first try the leader that meets most others; lists that then
still hold several components are merged where they hold much the same
documents, and compared block against block, so that no row stands for a pair. Equal shingle sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needscope.llm.common import Membership, WordHashes, binary, cell_of, shingle_hashes, table_bits, words_of
from needscope.llm.graph import components
from needscope.sources.scratch import settle

WINDOW = 1_000_000  # shingles a task adds up before it passes them on
FREQUENT = 8  # occurrences from which a shingle gets a class
CLASS_BITS = 24  # frequency table: at most 16 MB
LONGEST = 64  # most matches asked for
UNSEEN = 0.1  # entries expected to be met in the list of a shingle without a class
VERIFY = 1 / 8  # cost of a verification for each shingle of the set, in list entries
BLOCK = 400  # documents of a block of a long list
COLUMNS = 4_096  # shingles counted at a time when blocks meet
SMALL = 12  # documents in a list that is paired in full
LIST_ROWS = 2_000_000  # list entries in a bucket, about
LED = 256  # pairs that a document's set meets in one task, about


def jaccard_components(
    docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80
) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash, cluster), one row per row of ``docs``.

    component_id is the smallest id reachable by links, the own id included.
    Where ids are shared, text_hash (xxhash64) tells the rows of an id apart
    and cluster the components; cluster is null without words.
    Null or empty text, or text without words: no shingles, linked with
    nothing. Fewer than n words are one shingle. Repeated rows and equal texts
    share a set and so a component; a null id takes part in links, but is
    never a component id unless all ids of the component are null. Extra
    columns are ignored. An empty table gives no rows. Shingles and sets are
    told apart by 64-bit hashes.
    """
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), binary(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    signs = settle(_signatures(rows, n, percent, _frequency_classes(rows, n, percent)), "signatures")
    nodes = (
        signs.where("n > 0")
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("k").alias("k"), F.first("prefix").alias("prefix"))
    )
    lists = settle(_lists(nodes, _buckets(signs)), "lists")
    links = _links(lists, signs, rows, n, percent)
    known = signs.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    named = known.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = settle(named, "named")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = named.join(least, "component").select("node", "component_id", F.col("component").alias("cluster"))
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    told = signs.select("doc_id", "n", "node", "text_hash").join(labels, "node", "left")
    return told.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "text_hash", "cluster")


# ---- frequency classes ----

def _frequency_classes(rows: DataFrame, n: int, percent: int) -> tuple[int, np.ndarray]:
    """(bits, table): class of the shingles that share the top bits of a hash.

    Each document reports the part of its set, by hash, in which its prefix
    will lie; arrays of 40-bit hashes meet by hash range and are counted.
    """
    buckets = max(8, len(rows.inputFiles()), rows.sparkSession.sparkContext.defaultParallelism)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = WordHashes(), [], 0

        def report() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held) >> np.uint64(24), return_counts=True)
            bucket = ((found >> np.uint64(8)) * np.uint64(buckets)) >> np.uint64(32)
            here, starts = np.unique(bucket, return_index=True)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(here.astype(np.int32)),
                    pa.array([packed(x << np.uint64(24)) for x in np.split(found, starts[1:])], pa.binary()),
                    pa.array([np.minimum(x, 65535).astype(np.uint16).tobytes() for x in np.split(times, starts[1:])], pa.binary()),
                ],
                ["bucket", "shingle", "times"],
            )

        for batch in batches:
            for text in batch.column(0):
                found = shingle_hashes(words_of(text.as_py()), hashes, n)
                need = (percent * len(found) + 99) // 100
                held.append(found[: 2 * (len(found) - need) + LONGEST])
                size += len(held[-1])
                if size >= WINDOW:
                    yield report()
                    held, size = [], 0
        if size:
            yield report()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            for bucket, *blob in zip(*(column.to_pylist() for column in batch.columns)):
                parts.setdefault(bucket, []).append(blob)
        for bucket in list(parts):
            shingles, times = zip(*parts.pop(bucket))
            found, at = np.unique(np.concatenate([unpacked(x) for x in shingles]), return_inverse=True)
            total = np.bincount(at, np.concatenate([np.frombuffer(x, np.uint16) for x in times])).astype(np.int64)
            often = total >= FREQUENT
            yield pa.RecordBatch.from_arrays([pa.array((found[often] << np.uint64(24)).view(np.int64)), pa.array(total[often])], ["shingle", "times"])

    dealt = rows.select("text").mapInArrow(deal, "bucket int, shingle binary, times binary")
    often = settle(dealt.repartition(buckets, "bucket").mapInArrow(count, "shingle long, times long"), "frequent")
    bits = table_bits(often.count(), CLASS_BITS, per_entry=32)
    level = F.floor(F.log2("times")).cast("int")
    cells = often.groupBy(cell_of(F.col("shingle"), bits).alias("cell")).agg(F.max(level).alias("level")).toPandas()
    table = np.zeros(1 << bits, np.uint8)
    table[cells["cell"].to_numpy(np.int64)] = cells["level"].to_numpy(np.uint8)
    return bits, table


# ---- prefixes ----

def choose_matches(levels: np.ndarray, size: int, need: int) -> int:
    """Matches to ask for: least prefix + entries met + verifications.

    ``levels`` are the classes of the set in prefix order. No more candidates
    can share k lists than the lists hold entries divided by k.
    """
    most = min(LONGEST, need)
    last = size - need
    level = levels[: last + most].astype(float)
    met = np.cumsum(np.where(level > 0, np.exp2(level), UNSEEN))[last:]
    asked = np.arange(1, most + 1)
    return int(asked[np.argmin(last + asked + met * (1 + VERIFY * size / asked))])


def packed(shingles: np.ndarray) -> bytes:
    """The top 40 bits of each hash."""
    return (shingles >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return wide.view("<u8")[:, 0]


def _signatures(rows: DataFrame, n: int, percent: int, classes: tuple[int, np.ndarray]) -> DataFrame:
    bits, table = classes
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, level_of, shift = WordHashes(), shared.value, np.uint64(64 - bits)
        for batch in batches:
            sizes, nodes, asked, prefixes = [], [], [], []
            for text in batch.column(1):
                found = shingle_hashes(words_of(text.as_py()), hashes, n)
                size = len(found)
                sizes.append(size)
                nodes.append(set_hash(found) if size else None)
                if not size:
                    asked.append(0), prefixes.append(None)
                    continue
                levels = level_of[found >> shift]
                if levels.any():
                    order = np.argsort(levels, kind="stable")
                    found, levels = found[order], levels[order]
                need = (percent * size + 99) // 100
                k = choose_matches(levels, size, need)
                asked.append(k)
                prefixes.append(packed(found[: size - need + k]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(asked, pa.int32()), pa.array(prefixes, pa.binary())],
                ["doc_id", "text_hash", "n", "node", "k", "prefix"],
            )

    return rows.mapInArrow(sign, "doc_id long, text_hash long, n long, node long, k int, prefix binary")


def set_hash(found: np.ndarray) -> int:
    """64-bit identity of a sorted set of hashes."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))


# ---- inverted lists ----

def _buckets(signs: DataFrame) -> int:
    entries = signs.agg(F.sum(F.length("prefix"))).first()[0] or 0
    return max(8, -(-entries // 5 // LIST_ROWS))


def _lists(nodes: DataFrame, buckets: int) -> DataFrame:
    """Entries of every list with two or more nodes, a row per bucket.

    Entries travel as arrays, grouped by node: 32 bits of the shingle (enough
    to tell lists of one bucket apart, up to a few extra candidates), and once
    per node its size, its matches and how many entries are its own.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [unpacked(x.as_py()) for x in batch.column(3)]
            if not tokens:
                continue
            token, row = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
            bucket = ((token >> np.uint64(8)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            token, row, bucket = token[order].astype(np.uint32), row[order], bucket[order]
            run = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])])
            own, row = np.diff(np.r_[run, len(row)]), row[run]
            found, starts = np.unique(bucket, return_index=True)
            at_run = np.searchsorted(run, starts)
            cut = lambda values, kind, at: pa.array([x.tobytes() for x in np.split(values.astype(kind), at[1:])], pa.binary())
            node, n, k = (batch.column(i).to_numpy()[row] for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.astype(np.int32)), cut(token, np.uint32, starts), cut(node, np.int64, at_run), cut(n, np.int32, at_run), cut(k, np.int8, at_run), cut(own, np.int32, at_run)],
                ["bucket", "token", "node", "n", "k", "own"],
            )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            for bucket, *blob in zip(*(column.to_pylist() for column in batch.columns)):
                parts.setdefault(bucket, []).append(blob)
        for bucket in list(parts):
            token, node, n, k, own = (
                np.concatenate([np.frombuffer(x, kind) for x in column])
                for column, kind in zip(zip(*parts.pop(bucket)), (np.uint32, np.int64, np.int32, np.int8, np.int32))
            )
            order = np.argsort(token, kind="stable")
            token = token[order]
            _, times = np.unique(token, return_counts=True)
            keep = np.repeat(times > 1, times)
            if keep.any():
                token, at = token[keep], np.repeat(np.arange(len(own), dtype=np.int32), own)[order[keep]]
                again = np.lexsort((node[at], token))
                token, at = token[again], at[again]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (token, node[at], n[at], k[at]))],
                    ["bucket", "token", "node", "n", "k"],
                )

    kind = "bucket int, token binary, node binary, n binary, k binary"
    dealt = nodes.select("node", "n", "k", "prefix").mapInArrow(deal, f"{kind}, own binary")
    return dealt.repartition(buckets, "bucket").mapInArrow(gather, kind)


def _each_list(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for bucket, *blob in zip(*(column.to_pylist() for column in batch.columns)):
        token, node, n, k = (np.frombuffer(x, kind) for x, kind in zip(blob, (np.uint32, np.int64, np.int32, np.int8)))
        start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        yield bucket, token, node, n, k, np.diff(np.r_[start, len(token)])


def pairs_within(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs inside consecutive groups of the given sizes."""
    first, second = [], []
    starts = np.cumsum(counts) - counts
    for size in np.unique(counts):
        if size > 1:
            left, right = np.triu_indices(size, 1)
            at = starts[counts == size][:, None]
            first.append((at + left).ravel())
            second.append((at + right).ravel())
    none = np.empty(0, np.int64)
    return (np.concatenate(first), np.concatenate(second)) if first else (none, none)


def _links(lists: DataFrame, signs: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Verified links (a, b) between nodes; they connect what all links connect."""
    found = (
        lists.mapInArrow(lambda batches: _pairs_of_short(batches, percent), "a long, b long, matches int, need int")
        .groupBy("a", "b")
        .agg(F.sum("matches").alias("matches"), F.first("need").alias("need"))
    )
    # long lists may hold the missing matches, but no more than either has entries there
    entries = settle(lists.mapInArrow(_entries_of_long, "list long, node long, n int, k int"), "long-lists")
    more = settle(entries.groupBy("node").agg(F.count("*").alias("more")), "long-entries")
    for side in ("a", "b"):
        found = found.join(more.select(F.col("node").alias(side), F.col("more").alias(f"more_{side}")), side, "left")
    hidden = F.least(F.coalesce("more_a", F.lit(0)), F.coalesce("more_b", F.lit(0)))
    found = found.where(F.col("matches") + hidden >= F.col("need")).select("a", "b")
    # the documents of long lists first try leaders: those that meet most others
    sizes = entries.groupBy("list").agg(F.count("*").alias("size"))
    central = entries.join(sizes, "list").groupBy("node").agg(F.sum("size").alias("central"))
    entries = settle(entries.join(central, "node"), "long-lists")
    first = settle(found.union(_led(entries.withColumn("component", F.col("node")), F.col("central"))).distinct(), "candidates")
    known = signs.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    ends = first.select(F.col("a").alias("node")).union(first.select(F.col("b").alias("node"))).union(entries.select("node")).distinct()
    sets = settle(_sets(rows, settle(ends.join(known, "node"), "flagged"), n), "sets")
    links = settle(_verified(first, sets, percent), "links")

    if entries.isEmpty():
        return links
    parts = settle(_mixed(entries, components(links)), "mixed")
    return settle(links.union(_linked_in_blocks(_merged(parts), sets, percent)), "links")


def _pairs_of_short(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, token, node, n, k, counts in _each_list(batch):
            short = np.repeat(counts <= SMALL, counts)
            i, j = pairs_within(counts[counts <= SMALL])
            node, n, k = node[short], n[short].astype(np.int64), k[short]
            fits = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            i, j = i[fits], j[fits]
            if not len(i):
                continue
            pair = np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], 1)
            order = np.lexsort((pair[:, 1], pair[:, 0]))
            pair, need = pair[order], np.minimum(k[i], k[j])[order]
            start = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]).any(1)])
            times = np.diff(np.r_[start, len(pair)])
            a, b = pair[start].T
            columns = [a, b, times.astype(np.int32), need[start].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a", "b", "matches", "need"])


def _led(entries: DataFrame, rank: Column) -> DataFrame:
    """(a, b): each document with the leader it meets most often; a list's
    leader has the highest rank, and another component than the document."""
    leaders = entries.groupBy("list").agg(F.max_by(F.struct("node", "component"), F.struct(rank, "node")).alias("leader"))
    met = (
        entries.join(leaders, "list")
        .where("component <> leader.component")
        .groupBy(F.col("node").alias("a"), F.col("leader.node").alias("b"))
        .agg(F.count("*").alias("matches"))
    )
    return met.groupBy("a").agg(F.max_by("b", F.struct("matches", "b")).alias("b"))


def _entries_of_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bucket, token, node, n, k, counts in _each_list(batch):
            long = np.repeat(counts > SMALL, counts)
            name = (np.int64(bucket) << np.int64(32)) | token[long].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(name), pa.array(node[long]), pa.array(n[long]), pa.array(k[long].astype(np.int32))], ["list", "node", "n", "k"]
            )


def _mixed(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Entries of lists that still hold more than one component."""
    placed = entries.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return placed.join(mixed.select("list"), "list", "left_semi")


def _merged(parts: DataFrame) -> DataFrame:
    """Entries in which lists of much the same documents are one list.

    Near copies of one text meet in a list for each common shingle. Lists with
    the same leader merge into the largest of them if it holds half of their
    documents or more; others stay. Every pair of a list is still in a list.
    """
    leader = F.max_by("node", F.struct("central", "node"))
    lists = settle(parts.groupBy("list").agg(F.count("*").alias("size"), leader.alias("leader")), "list-leaders")
    largest = lists.groupBy("leader").agg(F.max_by("list", F.struct("size", "list")).alias("largest"))
    near = lists.join(largest, "leader").select("list", "size", "largest")
    held = parts.select(F.col("list").alias("largest"), "node")
    shared = parts.join(near, "list").join(held, ["largest", "node"]).groupBy("list", "size", "largest").agg(F.count("*").alias("shared"))
    into = shared.where("2 * shared >= size").select("list", "largest")
    merged = parts.join(into, "list", "left").withColumn("list", F.coalesce("largest", "list"))
    return merged.select("list", "node", "n", "component").distinct()


def _linked_in_blocks(parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside lists that hold several components, without a row per pair.

    Two blocks meet in one task, which counts all overlaps as matrix products
    and returns a spanning set of links. Blocks of one and the same component,
    or whose sizes exclude a link, don't meet.
    """
    placed = settle(_in_blocks(parts), "blocks")
    blocks = placed.groupBy("list", "block").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    x, y = blocks.alias("x"), blocks.alias("y")
    several = F.least("x.low", "y.low") < F.greatest("x.high", "y.high")
    fits = (100 * F.col("x.most") >= percent * F.col("y.least")) & (100 * F.col("y.most") >= percent * F.col("x.least"))
    met = x.join(y, (F.col("x.list") == F.col("y.list")) & (F.col("x.block") <= F.col("y.block")) & several & fits)
    met = settle(met.select(F.col("x.list").alias("list"), F.col("x.block").alias("i"), F.col("y.block").alias("j")), "block-pairs")
    left = placed.join(met, [placed["list"] == met["list"], placed["block"] == met["i"]]).select(met["list"], "i", "j", "node")
    right = placed.join(met.where("i < j"), [placed["list"] == met["list"], placed["block"] == met["j"]]).select(met["list"], "i", "j", "node")

    def link(rows: pa.Table) -> pa.Table:
        node = rows["node"].to_numpy()
        found = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["shingles"]]
        at = spanning(overlaps(found), np.array([len(x) for x in found]), percent)
        other = at != np.arange(len(node))
        return pa.table([pa.array(node[other]), pa.array(node[at[other]])], ["a", "b"])

    held = left.union(right).join(sets.dropDuplicates(["node"]), "node").select("list", "i", "j", "node", "shingles")
    return held.groupBy("list", "i", "j").applyInArrow(link, "a long, b long").distinct()


def _in_blocks(parts: DataFrame) -> DataFrame:
    """(list, node, n, component, block): blocks of about BLOCK documents.

    Lists of more documents are cut by size first, in steps of 25 %. A
    component that fills half a block has blocks of its own, the others share.
    Only counts are gathered; a document finds its block by hash.
    """
    lists = parts.groupBy("list").agg(F.count("*").alias("all"))
    step = F.when(F.col("all") > BLOCK, F.floor(F.log("n") / np.log(1.25))).otherwise(0)
    banded = settle(parts.join(lists, "list").select("list", "node", "n", "component", step.alias("band")), "banded")
    sizes = banded.groupBy("list", "band", "component").agg(F.count("*").alias("size"))
    chunks = F.ceil(F.sum("size") / BLOCK).alias("chunks")
    own = settle(sizes.where(F.col("size") >= BLOCK / 2).groupBy("list", "band", "component").agg(chunks), "own-blocks")
    shared = settle(sizes.where(F.col("size") < BLOCK / 2).groupBy("list", "band").agg(chunks), "shared-blocks")
    block = lambda *of: F.xxhash64("band", *of).alias("block")
    kept = ["list", "node", "n", "component"]
    alone = banded.join(own, ["list", "band", "component"]).select(*kept, block("component", F.pmod(F.xxhash64("node"), "chunks")))
    rest = banded.join(own, ["list", "band", "component"], "left_anti").join(shared, ["list", "band"])
    return alone.unionByName(rest.select(*kept, block(F.pmod(F.xxhash64("component"), "chunks"))))


def overlaps(found: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets."""
    token, column, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(found)), [len(x) for x in found])
    shared = times[column] > 1
    row, column = row[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(found), len(found)), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, width, COLUMNS):
        low, high = np.searchsorted(column, [start, start + COLUMNS])
        present = np.zeros((len(found), min(COLUMNS, width - start)), np.float32)
        present[row[low:high], column[low:high] - start] = 1
        total += present @ present.T
    return total.astype(np.int64)


def spanning(shared: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """For each set the least place that links reach inside the block."""
    linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    np.fill_diagonal(linked, True)
    at = np.arange(len(sizes))
    while True:
        lower = np.where(linked, at[None, :], len(sizes)).min(1)
        lower = lower[lower]
        if (lower == at).all():
            return at
        at = lower


# ---- verification ----

def _sets(rows: DataFrame, flagged: DataFrame, n: int) -> DataFrame:
    """(node, shingles) of the documents that may be in a candidate pair."""
    may = Membership.of(flagged.select(F.xxhash64("doc_id").alias("key")), "key")
    shared = rows.sparkSession.sparkContext.broadcast(may)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            kept = batch.filter(pa.array(shared.value.may_have(batch.column(0).to_numpy())))
            found = [shingle_hashes(words_of(text.as_py()), hashes, n) for text in kept.column(1)]
            found = [x for x in found if len(x)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_hash(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["node", "shingles"]
            )

    return rows.select(F.xxhash64("doc_id").alias("key"), "text").mapInArrow(build, "node long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (left, right))
                both = np.concatenate([x, y])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                linked.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    # a leader of very many pairs meets them in several tasks
    parts = settle(pairs.groupBy("b").agg(F.ceil(F.count("*") / LED).cast("int").alias("parts")), "pair-parts")
    salted = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.join(parts, sets["node"] == parts["b"]).select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("shingles").alias("right"))
    held = salted.join(left, "a").join(right, ["b", "part"]).select("a", "b", "left", "right")
    return held.mapInArrow(check, "a long, b long").distinct()

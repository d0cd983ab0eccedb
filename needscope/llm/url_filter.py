"""URL filter over a sorted digest array.

Each rule (host, path, verdict) has a 64-bit xxhash key. The sorted keys and
the rules' full strings are written to the shared folder and shipped to every
executor as files, where tasks memory-map them: only the pages a search
touches are read. A URL is looked up under every suffix of its host and every
path prefix of a length that occurs in the rules, in one binary search per
batch, and a hit counts only if the stored string is equal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needscope.sources.scratch import scratch_dir, settle

URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SHARD_RULES = 4_000_000  # rules of one file


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    found = URL.search(url) if url else None
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


def suffixes(host: str) -> list[str]:
    """The host and its parent domains, longest first."""
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))] if host else []


@dataclass(frozen=True)
class DigestArray:
    """Written shards of (keys, offsets, strings), in key order, and the path lengths in use."""

    shards: tuple[str, ...]
    lengths: tuple[int, ...]


def build_digests(rules: DataFrame) -> DigestArray:
    """Write the array for ``rules`` of (host, path, verdict).

    Rules are told apart by host + path; of repeated ones a block wins. Rules
    with a null are left out. The driver sees only the names of the files.
    """
    spark = rules.sparkSession
    folder = f"{scratch_dir(spark)}/digests-{uuid4().hex}"
    whole = rules.dropna().select(F.concat(F.translate("host", _UPPER, _UPPER.lower()), "path").alias("rule"), "verdict", F.length("path").alias("n"))
    whole = settle(whole.groupBy("rule").agg(F.max("verdict").alias("verdict"), F.max("n").alias("n")), "rules")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array([xxhash.xxh64_intdigest(x) for x in batch.column(0).to_pylist()], np.uint64)
            signed = (keys ^ np.uint64(1 << 63)).view(np.int64)  # same order as unsigned keys
            yield pa.RecordBatch.from_arrays([pa.array(signed), *batch.columns[:2]], ["key", "rule", "verdict"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("key", pa.int64()), ("rule", pa.string()), ("verdict", pa.string())]))
        if not table.num_rows:
            return
        keys = table["key"].to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
        texts = [f"{v[0]}{r}".encode() for r, v in zip(table["rule"].to_pylist(), table["verdict"].to_pylist())]
        offsets = np.cumsum([0, *map(len, texts)]).astype(np.int64)
        name = f"{keys[0]:016x}-{uuid4().hex[:8]}"
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at)
        for kind, content in (("keys", keys.tobytes()), ("offsets", offsets.tobytes()), ("strings", b"".join(texts))):
            with store.open_output_stream(f"{at}/{name}.{kind}") as out:
                out.write(content)
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    count = max(1, -(-whole.count() // SHARD_RULES))
    sorted_ = whole.mapInArrow(keyed, "key long, rule string, verdict string").repartitionByRange(count, "key").sortWithinPartitions("key", "rule")
    names = sorted(row["name"] for row in settle(sorted_.mapInArrow(write, "name string"), "digest-files").collect())
    lengths = sorted({row["n"] for row in whole.select("n").distinct().collect()})
    for name in names:
        for kind in ("keys", "offsets", "strings"):
            spark.sparkContext.addFile(f"{folder}/{name}.{kind}")
    return DigestArray(tuple(names), tuple(lengths))


_UPPER = "".join(chr(c) for c in range(65, 91))


class Probe:
    """The shards, memory-mapped on the executor."""

    def __init__(self, digests: DigestArray):
        path = lambda name, kind: SparkFiles.get(f"{name}.{kind}")
        self.keys = [np.memmap(path(n, "keys"), np.uint64, "r") for n in digests.shards]
        self.offsets = [np.memmap(path(n, "offsets"), np.int64, "r") for n in digests.shards]
        self.strings = [np.memmap(path(n, "strings"), np.uint8, "r") for n in digests.shards]
        self.first = np.array([k[0] for k in self.keys], np.uint64)

    def verdicts(self, texts: list[str]) -> list[str | None]:
        """The stored verdict letter of each text, None where it isn't stored."""
        found: list[str | None] = [None] * len(texts)
        if not texts or not self.keys:
            return found
        keys = np.array([xxhash.xxh64_intdigest(x) for x in texts], np.uint64)
        for number, stored in enumerate(self.keys):
            last = self.first[number + 1] if number + 1 < len(self.first) else None
            mine = np.flatnonzero((keys >= self.first[number]) & (True if last is None else keys <= last))
            low, high = np.searchsorted(stored, keys[mine], "left"), np.searchsorted(stored, keys[mine], "right")
            for at in np.flatnonzero(low < high):
                text = texts[mine[at]].encode()
                for place in range(low[at], high[at]):  # more than one only where keys collide
                    begin, end = self.offsets[number][place : place + 2]
                    held = self.strings[number][begin:end].tobytes()
                    if held[1:] == text:
                        found[mine[at]] = held[:1].decode()
        return found


def filter_urls(pages: DataFrame, rules: DataFrame, id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per row of ``pages``.

    A rule fits its host and all subdomains where the path starts with the
    rule's path; the longest host + path wins. A URL that no rule fits isn't
    in the array and is allowed. Null URLs, or those without ``://``, have an
    empty host and path. Repeated rows stay; extra columns are ignored.
    """
    digests = build_digests(rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = Probe(digests)
        for batch in batches:
            parts = [host_and_path(x) for x in batch.column(1).to_pylist()]
            asked = [
                (row, f"{suffix}{path[:length]}")
                for row, (host, path) in enumerate(parts)
                for suffix in suffixes(host)
                for length in digests.lengths
                if length <= len(path)
            ]
            best: dict[int, tuple[str, str]] = {}
            for (row, text), verdict in zip(asked, probe.verdicts([text for _, text in asked])):
                if verdict and (row not in best or len(text) > len(best[row][0])):
                    best[row] = (text, verdict)
            rule = [best[row][0] if row in best else None for row in range(len(parts))]
            verdict = ["block" if row in best and best[row][1] == "b" else "allow" for row in range(len(parts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"))
    return rows.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")

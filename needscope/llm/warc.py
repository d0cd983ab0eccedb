"""Deterministic sharded WARC writer, and a reader for its archives.

Records are cut into shards by key ranges that follow from the data alone: the
quantiles of the ids of least hash bound ranges, whose payloads are weighed
exactly and joined to shards. An id whose payloads alone exceed a shard is
dealt to several by their digest. Records are sorted inside a shard and written
as one gzip member each. A shard rolls over
to a new file by compressed size. Headers, record ids and digests are made
anew from the record, so equal input gives equal bytes. A task writes under a
temporary name and renames; only files that the manifest lists count, and the
manifest is the last thing written. A repeated task writes the same bytes to
the same name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from needscope.llm.common import binary, slices
from needscope.sources.scratch import settle

LEAST_REVISIT = 1_000  # bytes from which equal payloads are stored once
SHARD_BYTES = 16 << 20  # payload of a shard, about
FILE_BYTES = 8 << 20  # compressed size at which a file is closed
BINS = 4_096  # key ranges that the driver weighs
SAMPLED = 65_536  # ids, about, whose quantiles bound the ranges
SALTS = 16
DATE = "2000-01-01T00:00:00Z"
FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_BREAKS = re.compile(r"[\x00-\x1f\x7f]+")


@dataclass(frozen=True)
class Record:
    page_id: int | None
    url: str | None
    payload: bytes
    digest: str
    refers_to: int | None
    revisit: bool


def plan_records(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to, revisit), one row per row.

    Of equal payloads of at least ``LEAST_REVISIT`` bytes the largest page_id
    is stored and the others refer to it. Null html is an empty payload.
    Repeated rows of the largest page_id are all stored. A null page_id refers
    to the largest known one and is stored if there is none.
    """
    payload = F.coalesce(binary(html), F.lit(b""))
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    digest = F.sha1("payload")
    long = rows.where(F.length("payload") >= LEAST_REVISIT).select("page_id", digest.alias("digest"))
    first = long.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1 and response is not null")
    # a payload of very many pages meets its response in several tasks
    first = settle(first.select("digest", "response"), "responses").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("digest", digest).withColumn("salt", F.coalesce(F.pmod("page_id", F.lit(SALTS)), F.lit(0)).cast("int"))
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return salted.join(first, ["digest", "salt"], "left").select(
        "page_id", "url", "payload", "digest", F.when(revisit, F.col("response")).alias("refers_to"), revisit.alias("revisit")
    )


def write_archives(pages: DataFrame, folder: str, **names: str) -> DataFrame:
    """Write all pages below ``folder``; the manifest (file, records, bytes, sha256).

    An empty table gives an empty manifest. Extra columns are ignored.
    """
    key, size = names.get("id", "page_id"), F.coalesce(F.octet_length(names.get("html", "html")), F.lit(0)) + 1
    shard_of, shards = _shards(pages.select(F.col(key).cast("long").alias("key"), size.alias("size")))
    records = plan_records(pages, **names)
    records = records.withColumn("shard", shard_of("page_id", F.xxhash64("digest", "url")))
    placed = records.repartition(shards, "shard").sortWithinPartitions("shard", "page_id", "digest", "url")

    limit = FILE_BYTES

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at)
        roll = _Roll(store, at, limit)
        for batch in batches:
            for part in slices(batch, 2):
                for row in part.to_pylist():
                    number = row.pop("shard")
                    yield from roll.add(number, encode(Record(**row)))
        yield from roll.close()

    manifest = placed.select("page_id", "url", "payload", "digest", "refers_to", "revisit", "shard")
    manifest.mapInArrow(write, "file string, records long, bytes long, sha256 string").write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


def _shards(pages: DataFrame) -> tuple[Callable[[str, Column], Column], int]:
    """(column of the shard from id and hash, number of shards), of about equal payload.

    Bounds compare, so ids may lie as far apart as longs can. The driver sees
    a bounded number of ids and one weight for each range. Null ids come first.
    """
    known = pages.where("key is not null")
    share = min(1.0, SAMPLED / max(known.count(), 1))
    # 2**31 - 1 hashes: the sample is the same in any order of rows
    picked = known.where(F.pmod(F.xxhash64("key"), F.lit(2**31 - 1)) < int(share * (2**31 - 1)) + 1)
    ids = np.sort(picked.select("key").distinct().toArrow()["key"].to_numpy())
    bounds = np.unique(ids[np.linspace(0, len(ids), BINS, endpoint=False).astype(int)]) if len(ids) else ids

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            at, back = np.unique(np.searchsorted(bounds, key, "right"), return_inverse=True)
            low, high = np.full(len(at), np.iinfo(np.int64).max), np.full(len(at), np.iinfo(np.int64).min)
            np.minimum.at(low, back, key), np.maximum.at(high, back, key)
            total = np.bincount(back, batch.column(1).to_numpy(), len(at)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, total, low, high)], ["bin", "size", "low", "high"])

    weighed = known.mapInArrow(weigh, "bin long, size long, low long, high long").groupBy("bin").agg(F.sum("size").alias("size"), F.min("low").alias("low"), F.max("high").alias("high"))
    first, number, parts = np.zeros(len(bounds) + 1, np.int32), 0, np.ones(len(bounds) + 1, np.int32)
    held, last = 0, 0
    for row in weighed.orderBy("bin").collect():
        first[last + 1 : row["bin"]] = number
        if held and held + row["size"] > SHARD_BYTES:
            number, held = number + 1, 0
        first[row["bin"]] = number
        if row["low"] == row["high"] and row["size"] > SHARD_BYTES:
            parts[row["bin"]] = -(-row["size"] // SHARD_BYTES)
            number, held = number + int(parts[row["bin"]]) - 1, SHARD_BYTES
        held += row["size"]
        last = row["bin"]

    @F.pandas_udf("int")
    def place(key: pd.Series, spread: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, key.to_numpy(np.int64), "right")
        return pd.Series((first[at] + spread.to_numpy(np.int64) % parts[at]).astype(np.int32))

    return lambda key, spread: F.when(F.col(key).isNull(), F.lit(0)).otherwise(place(F.coalesce(key, F.lit(0)), spread)), number + 1


class _Roll:
    """The open file of one task."""

    def __init__(self, store: fs.FileSystem, at: str, limit: int):
        self.store, self.at, self.limit, self.out, self.shard, self.part = store, at, limit, None, None, 0

    def add(self, shard: int, member: bytes) -> Iterator[pa.RecordBatch]:
        if self.out and (shard != self.shard or self.bytes >= self.limit):
            yield from self.close()
        if not self.out:
            self.part = self.part + 1 if shard == self.shard else 0
            self.shard, self.bytes, self.records, self.sum = shard, 0, 0, hashlib.sha256()
            self.name = f"shard-{shard:06d}-{self.part:04d}.warc.gz"
            self.held = f"{self.at}/.{self.name}.{uuid4().hex}"
            self.out = self.store.open_output_stream(self.held, compression=None)
        self.out.write(member)
        self.sum.update(member)
        self.bytes += len(member)
        self.records += 1

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.out:
            self.out.close()
            self.store.move(self.held, f"{self.at}/{self.name}")
            self.out = None
            yield pa.RecordBatch.from_pylist([{"file": self.name, "records": self.records, "bytes": self.bytes, "sha256": self.sum.hexdigest()}])


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def encode(record: Record) -> bytes:
    """One gzip member: a response with its payload, or a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(record.payload)}\r\n\r\n".encode()
    block = http if record.revisit else http + record.payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if record.revisit else 'response'}",
        f"WARC-Record-ID: {record_id(record.page_id, record.digest)}",
        f"WARC-Date: {DATE}",
    ]
    if record.url is not None:
        lines.append(f"WARC-Target-URI: {_BREAKS.sub(' ', record.url)}")
    if record.revisit:
        lines.append(f"WARC-Refers-To: {record_id(record.refers_to, record.digest)}")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += [
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(record.digest)).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def members(stream) -> Iterator[bytes]:
    """The unpacked gzip members of a stream, one at a time."""
    unpacker, out = zlib.decompressobj(31), []
    while block := stream.read(1 << 20):
        while block:
            out.append(unpacker.decompress(block))
            block = b""
            if unpacker.eof:
                yield b"".join(out)
                block, unpacker, out = unpacker.unused_data, zlib.decompressobj(31), []
    if any(out):
        raise ValueError("the archive ends inside a record")


def decode(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload); digests and lengths must fit."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or _hex(fields["WARC-Block-Digest"]) != hashlib.sha1(block).hexdigest():
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def _hex(digest: str) -> str:
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


def _page(record: str) -> int | None:
    page = record.split(":")[2]
    return int(page) if page else None


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), a row
    per record of the files that the manifest lists, from the archives alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with store.open_input_stream(f"{at}/{name}", compression=None) as stream:
                    for member in members(stream):
                        fields, http, payload = decode(member)
                        kind, digest = fields["WARC-Type"], _hex(fields["WARC-Payload-Digest"])
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
                        rows.append({
                            "page_id": _page(fields["WARC-Record-ID"]), "payload_bytes": int(http["Content-Length"]), "payload_digest": digest,
                            "record_type": kind, "refers_to": _page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
                        })
                yield pa.RecordBatch.from_pylist(rows, schema)

    manifest = spark.read.parquet(f"{folder}/manifest")
    files = manifest.count()
    return manifest.select("file").repartition(max(1, files), "file").mapInArrow(read, FIELDS)

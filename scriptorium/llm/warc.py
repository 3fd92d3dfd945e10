"""Content-addressed WARC archive.

Archives are ordinary ``.warc.gz`` files, a gzip member per record, in which a payload
of some size that stands more than once is written once and revisited after that. Read
back, they are stored as two tables: ``payloads`` holds the bytes of each distinct
payload once under its SHA-256, ``headers`` the exact header bytes of every record with
that digest. The original records are the join of the two.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.token_files import filesystem, put_file
from scriptorium.plans.store import broadcast_if, materialise

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Repeated payloads' digests up to this number are broadcast (about 60 bytes each).
LEADERS = 500_000
SHARD = "shard long, path string, n_records long"
RECORD = "header binary, digest string, payload binary"


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id}|{digest}'.encode()).hexdigest())}>"


def header_block(page_id, url, digest: str, sha1: str, size: int, leader) -> bytes:
    """The exact header bytes of a record; ``leader`` is set for a revisit."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if leader is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha1}", f"Scriptorium-Content: sha256:{digest}"]
    if page_id is not None:
        lines.append(f"Scriptorium-Page: {page_id}")
    if leader is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(leader, digest)}", f"Scriptorium-Refers-To-Page: {leader}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {size if leader is None else 0}", "", ""]
    return "\r\n".join(lines).encode()


def _none(x):
    return None if x is None or x != x else x


def _writer(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, place = filesystem(folder)
        files.create_dir(place, recursive=True)
        shard, n = TaskContext.get().partitionId(), 0

        def members():
            nonlocal n
            for b in batches:
                for page_id, url, digest, sha1, leader, payload in zip(b["page_id"], b["url"], b["digest"], b["sha1"], b["leader"], b["payload"]):
                    leader = _none(leader)
                    head = header_block(_none(page_id), url, digest, sha1, len(payload), leader)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    yield packer.compress(head + (bytes(payload) if leader is None else b"") + b"\r\n\r\n") + packer.flush()
                    n += 1

        put_file(files, f"{place}/part-{shard:06d}.warc.gz", members())
        yield pd.DataFrame({"shard": [shard], "path": [f"{folder}/part-{shard:06d}.warc.gz"], "n_records": [n]})

    return write


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 1000) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) under ``folder``; returns
    the archives' paths, a row each.

    Of rows with equal payloads of at least ``min_bytes`` the one with the largest
    page_id is a response and the others revisit it; every other row is a response. Null
    html is an empty payload, a null url gives no target, a null page_id is never
    revisited; rows that repeat the largest page_id are all responses. Other columns are
    ignored. Payloads stay where they are read unless repeated digests are too many to
    broadcast; then they are dealt by digest, and AQE splits a digest with many rows.
    Page ids pass Python as text, as pandas holds a long column with nulls in doubles.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    skinny = pages.select(F.sha2(payload, 256).alias("digest"), F.col("page_id").cast("long").alias("page_id"), F.length(payload).alias("size")).where(F.col("size") >= min_bytes)
    leaders = materialise(skinny.groupBy("digest").agg(F.max("page_id").alias("leader"), F.count("*").alias("n")).where("n > 1").select("digest", "leader"), "warc-leaders")
    leaders = broadcast_if(leaders, leaders.count(), LEADERS)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("sha1", F.sha1("payload"))
    told = rows.join(leaders, "digest", "left").withColumn("leader", F.when(~F.col("page_id").eqNullSafe(F.col("leader")), F.col("leader")))
    return materialise(told.select(F.col("page_id").cast("string"), "url", "digest", "sha1", F.col("leader").cast("string"), "payload").mapInPandas(_writer(folder), SHARD), "warc-manifest")


def records(stream) -> Iterator[tuple[bytes, bytes]]:
    """(header bytes, block) of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        head, length = [line], 0
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            head.append(line)
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length":
                length = int(value)
        head.append(line)
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("a WARC record ends early")
        yield b"".join(head), block


def _reader(with_payload: bool, step: int = 500):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                files, place = filesystem(path)
                rows = []
                with files.open_input_stream(place, compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw, 1 << 20)) as stream:
                    for header, block in records(stream):
                        fields = dict(x.split(b": ", 1) for x in header.split(b"\r\n") if b": " in x)
                        named = fields.get(b"Scriptorium-Content", b"").removeprefix(b"sha256:").decode()
                        if fields.get(b"WARC-Type") == b"revisit":
                            if with_payload:
                                continue
                            digest = named
                        else:
                            digest = hashlib.sha256(block).hexdigest()
                            if named and named != digest:
                                raise ValueError(f"payload of {fields.get(b'WARC-Record-ID')} does not have its digest")
                        rows.append((header, digest, block if with_payload else None))
                        if len(rows) == step:
                            yield pd.DataFrame(rows, columns=["header", "digest", "payload"])
                            rows = []
                yield pd.DataFrame(rows, columns=["header", "digest", "payload"])

    return read


def store_archives(archives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads) from archives' paths: ``headers`` (header, digest) has every
    record, ``payloads`` (digest, payload) each distinct verified payload once. Tasks
    drop their own repeats before payloads are exchanged by digest."""
    dealt = archives.select("path").repartition(max(1, archives.count()))
    headers = materialise(dealt.mapInPandas(_reader(False), RECORD).select("header", "digest"), "warc-headers")
    once = dealt.mapInPandas(_reader(True), RECORD).groupBy("digest").agg(F.first("payload").alias("payload"))
    return headers, materialise(once, "warc-payloads", compression="zstd")


def _field(name: str):
    found = F.regexp_extract(F.col("header").cast("string"), rf"\n{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def describe(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """A row per record, from its header and the stored payload of its digest. The bytes
    are measured and digested where they are stored; only the figures are exchanged."""
    figures = payloads.select("digest", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), (F.sha2("payload", 256) == F.col("digest")).alias("verified"))
    found = headers.join(figures, "digest", "left")
    return found.select(
        _field("Scriptorium-Page").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        _field("WARC-Type").alias("record_type"),
        _field("Scriptorium-Refers-To-Page").cast("long").alias("refers_to"),
        "verified",
    )


def reconstruct(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(header, record, payload): the original records' bytes, and for revisits too the
    payload they stand for. A record whose payload is not stored has a null payload."""
    full = headers.join(payloads, "digest", "left")
    is_revisit = _field("WARC-Type") == "revisit"
    block = F.when(is_revisit, F.lit(b"")).otherwise(F.col("payload"))
    return full.select("header", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"), "payload")

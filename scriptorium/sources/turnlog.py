"""A connector for logs of dialogue turns, as a Python data source: ``format("turnlog")``.

A log is a folder. ``data`` has gzipped JSON lines, ``commits`` a numbered file for each
append that lists its data files with their rows and the range of their conversations. An
append is there once its commit is, whole; what a lost one wrote is never read. Batch
reads plan a partition for some files and leave out those whose range no filter on
conv_id can meet; stream reads take commit numbers as offsets.

    register(spark)
    df.write.format("turnlog").mode("append").save(path)
    spark.read.format("turnlog").load(path).where("conv_id = 7")
    spark.readStream.format("turnlog").load(path)
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "conv_id long, turn long, role string, text string"
_ARROW = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
#: Bytes of data files that a partition takes, and rows of an Arrow batch.
BYTES, ROWS = 64_000_000, 2_000


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def commits(uri: str, after: int = -1, to: int | None = None) -> list[dict]:
    """The data files of the commits numbered ``after`` < n <= ``to``."""
    from pyarrow import fs

    files, place = _open(uri)
    out = []
    for info in files.get_file_info(fs.FileSelector(f"{place}/commits", allow_not_found=True)):
        if info.base_name.endswith(".json") and after < (n := int(info.base_name[:-5])) and (to is None or n <= to):
            with files.open_input_stream(info.path) as f:
                out += [{**x, "commit": n} for x in json.loads(f.read())]
    return sorted(out, key=lambda x: (x["commit"], x["file"]))


def latest(uri: str) -> int:
    from pyarrow import fs

    files, place = _open(uri)
    names = [i.base_name for i in files.get_file_info(fs.FileSelector(f"{place}/commits", allow_not_found=True))]
    return max((int(n[:-5]) for n in names if n.endswith(".json")), default=-1)


@dataclass
class Files(InputPartition):
    names: list[str]


def planned(found: list[dict], size: int) -> list[Files]:
    """Partitions of about ``size`` bytes."""
    out, held, total = [], [], 0
    for x in found:
        if held and total + x["bytes"] > size:
            out.append(Files(held))
            held, total = [], 0
        held.append(x["file"])
        total += x["bytes"]
    return out + ([Files(held)] if held else [])


def rows_of(uri: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    files, place = _open(uri)
    for name in names:
        held = []
        with files.open_input_stream(f"{place}/data/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as lines:
            for line in lines:
                held.append(json.loads(line))
                if len(held) == ROWS:
                    yield pa.RecordBatch.from_pylist(held, _ARROW)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, _ARROW)


class TurnReader(DataSourceReader):
    def __init__(self, uri: str, size: int):
        self.uri, self.size, self.low, self.high = uri, size, None, None

    def pushFilters(self, filters: list[Filter]):
        """Ranges of conv_id leave files out; Spark still applies every filter to the rows."""
        for f in filters:
            if getattr(f, "attribute", None) == ("conv_id",) and isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                values = [v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None]
                if values and isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(min(values), self.low if self.low is not None else min(values))
                if values and isinstance(f, (EqualTo, In, LessThan, LessThanOrEqual)):
                    self.high = min(max(values), self.high if self.high is not None else max(values))
            yield f

    def partitions(self) -> list[Files]:
        kept = []
        for x in commits(self.uri):
            bounded = self.low is not None or self.high is not None
            if bounded and x["low"] is None:  # only null conversations
                continue
            if (self.low is not None and x["high"] < self.low) or (self.high is not None and x["low"] > self.high):
                continue
            kept.append(x)
        return planned(kept, self.size) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from rows_of(self.uri, partition.names)


class TurnStream(DataSourceStreamReader):
    def __init__(self, uri: str, size: int):
        self.uri, self.size = uri, size

    def initialOffset(self) -> dict:
        return {"commit": -1}

    def latestOffset(self) -> dict:
        return {"commit": latest(self.uri)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return planned(commits(self.uri, start["commit"], end["commit"]), self.size)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from rows_of(self.uri, partition.names)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    told: dict | None


class TurnWriter(DataSourceWriter):
    def __init__(self, uri: str):
        self.uri = uri

    def write(self, rows: Iterator) -> Written:
        files, place = _open(self.uri)
        files.create_dir(f"{place}/data", recursive=True)
        name, n, low, high = f"{uuid.uuid4().hex}.jsonl.gz", 0, None, None
        with files.open_output_stream(f"{place}/data/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=6) as out:
            for r in rows:
                out.write(json.dumps({c: r[c] for c in _ARROW.names}, ensure_ascii=False).encode() + b"\n")
                n += 1
                if r["conv_id"] is not None:
                    low, high = min(r["conv_id"], low if low is not None else r["conv_id"]), max(r["conv_id"], high if high is not None else r["conv_id"])
        size = files.get_file_info(f"{place}/data/{name}").size
        if not n:
            files.delete_file(f"{place}/data/{name}")
        return Written({"file": name, "rows": n, "bytes": size, "low": low, "high": high} if n else None)

    def commit(self, messages: list[Written | None]) -> None:
        """One file makes the append visible. Appends are one at a time."""
        files, place = _open(self.uri)
        files.create_dir(f"{place}/commits", recursive=True)
        told = [m.told for m in messages if m is not None and m.told]
        hidden, name = f"{place}/commits/_{uuid.uuid4().hex}", f"{place}/commits/{latest(self.uri) + 1:08d}.json"
        with files.open_output_stream(hidden) as out:
            out.write(json.dumps(told).encode())
        files.move(hidden, name)

    def abort(self, messages: list[Written | None]) -> None:
        files, place = _open(self.uri)
        for m in messages:
            if m is not None and m.told:
                files.delete_file(f"{place}/data/{m.told['file']}")


class TurnLog(DataSource):
    """Options: ``path``, and ``bytes`` of data files that a partition takes."""

    @classmethod
    def name(cls) -> str:
        return "turnlog"

    def schema(self) -> str:
        return SCHEMA

    def _size(self) -> int:
        return int(self.options.get("bytes", BYTES))

    def reader(self, schema: StructType) -> TurnReader:
        return TurnReader(self.options["path"], self._size())

    def streamReader(self, schema: StructType) -> TurnStream:
        return TurnStream(self.options["path"], self._size())

    def writer(self, schema: StructType, overwrite: bool) -> TurnWriter:
        if overwrite:
            raise ValueError("a turn log is appended to")
        return TurnWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TurnLog)

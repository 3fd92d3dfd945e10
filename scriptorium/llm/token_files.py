"""Token-ID output: flat files of unsigned integers with 64-bit document offsets.

A shard ``NNNNNN.ids`` holds the ids of consecutive documents, little-endian, in two
bytes each where the vocabulary allows and four otherwise. ``NNNNNN.idx`` beside it
holds the number of documents n, n document ids, n null marks and n + 1 offsets into
the shard, all 64-bit. Shards follow each other in ascending doc_id order; their bases
in the whole sequence are the prefix sums of the shards' token counts. Both files are
fit to be memory-mapped, and are so on local paths.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.tokens import TokenizerFile, encoder
from scriptorium.plans.store import materialise

#: Bytes of stored texts that a shard takes.
SHARD_BYTES = 256_000_000
SHARD = "shard long, n_docs long, n_tokens long, dtype string"


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI that the workers can reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def put_file(files, path: str, blocks) -> None:
    """Write under a name of this attempt's own, then rename: a lost or repeated task
    leaves whole files only."""
    attempt = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(attempt) as out:
        for block in blocks:
            out.write(block)
    if files.type_name != "local" and files.get_file_info(path).is_file:
        files.delete_file(path)
    files.move(attempt, path)


def _writer(file: TokenizerFile, folder: str, end_id: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, shard = encoder(file), TaskContext.get().partitionId()
        files, place = filesystem(folder)
        files.create_dir(place, recursive=True)
        end = np.array([end_id], dtype=own.dtype).tobytes()
        width, ids, nulls, sizes = len(end), array("q"), array("b"), array("q")  # 17 bytes a document

        def blocks():
            for batch in batches:
                for doc_id, is_null, text in zip(batch["doc_id"], batch["no_id"], batch["text"]):
                    data = own.packed(text) + end
                    ids.append(doc_id)
                    nulls.append(is_null)
                    sizes.append(len(data) // width)
                    yield data

        put_file(files, f"{place}/{shard:06d}.ids", blocks())
        offsets = np.concatenate([[0], np.cumsum(np.array(sizes, dtype="<i8"))]).astype("<i8")
        put_file(files, f"{place}/{shard:06d}.idx", [np.concatenate([np.array([len(ids)], dtype="<i8"), np.array(ids, dtype="<i8"), np.array(nulls, dtype="<i8"), offsets]).astype("<i8").tobytes()])
        yield pd.DataFrame({"shard": [shard], "n_docs": [len(ids)], "n_tokens": [int(offsets[-1])], "dtype": [own.dtype]})

    return write


def write_token_files(docs: DataFrame, tokenizer: TokenizerFile, folder: str, end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into ``folder``; returns the manifest, a row a
    shard with its base.

    Null texts are empty; every document ends with ``end_id``. Null doc_ids come first.
    Rows of one doc_id are ordered by a hash of the text, then the text: repeated rows
    are all written. An empty table gives no documents. Other columns are ignored.
    Texts are dealt to shards by ranges of (doc_id, hash), so that neither one id nor
    one text makes a shard large. Their number is that of the session's shuffle partitions,
    or as many as keep shards at SHARD_BYTES of the input, by the plan's own estimate.
    """
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = size if size < 2**55 else 0  # Spark's word for not known
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().cast("int").alias("no_id"), F.coalesce("text", F.lit("")).alias("text"))
    keys = [F.col("no_id").desc(), F.col("doc_id"), F.col("tie")]
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(shards, *keys).sortWithinPartitions(*keys, "text")
    written = materialise(ordered.mapInPandas(_writer(tokenizer, folder, end_id), SHARD), "token-manifest").collect()  # a row a shard
    bases, base = [], 0
    for r in sorted(written, key=lambda r: r["shard"]):
        bases.append((r["shard"], r["n_docs"], r["n_tokens"], r["dtype"], base))
        base += r["n_tokens"]
    return spark.createDataFrame(bases, SHARD + ", base long")


def reader_of(files, path: str, dtype: str) -> tuple[Callable[[int, int], np.ndarray], int]:
    """(what gives the values from one place to another, how many there are): of a memory map on
    a local path, else of the bytes in between alone."""
    n = files.get_file_info(path).size // np.dtype(dtype).itemsize
    if files.type_name == "local":
        held = np.memmap(path, dtype=dtype, mode="r") if n else np.empty(0, dtype)
        return lambda a, b: held[a:b], n
    f, width = files.open_input_file(path), np.dtype(dtype).itemsize
    return lambda a, b: np.frombuffer(f.read_at((b - a) * width, a * width), dtype), n


def _reader(folder: str, step: int = 1000):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, place = filesystem(folder)
        for batch in batches:
            for shard, dtype, base in zip(batch["shard"], batch["dtype"], batch["base"]):
                ids, _ = reader_of(files, f"{place}/{shard:06d}.ids", dtype)
                index, _ = reader_of(files, f"{place}/{shard:06d}.idx", "<i8")
                n = int(index(0, 1)[0])
                for at in range(0, n, step):
                    to = min(n, at + step)
                    offsets = np.array(index(2 * n + 1 + at, 2 * n + 2 + to))
                    held = ids(int(offsets[0]), int(offsets[-1])).astype("<u4")
                    crcs = [zlib.crc32(held[a:b].tobytes()) for a, b in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0])]
                    own_ids = pd.arrays.IntegerArray(np.array(index(1 + at, 1 + to), dtype="int64"), np.array(index(n + 1 + at, n + 1 + to), dtype=bool))
                    yield pd.DataFrame({"doc_id": own_ids, "start": base + offsets[:-1], "n_tokens": np.diff(offsets), "ids_crc32": np.array(crcs, dtype="int64")})

    return read


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per written document, from the files: doc_id, start (ids of all documents
    before it), n_tokens (with the end id), ids_crc32 over the ids as unsigned 32-bit."""
    shards = max(1, manifest.count())
    dealt = manifest.where("n_docs > 0").repartition(shards)
    return dealt.mapInPandas(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(spark: SparkSession, manifest: DataFrame, folder: str, start: int, length: int) -> np.ndarray:
    """``length`` ids from position ``start`` of the whole sequence: a training window."""
    files, place = filesystem(folder)
    parts = []
    for r in manifest.where((F.col("base") < start + length) & (F.col("base") + F.col("n_tokens") > start)).orderBy("base").collect():
        ids, n = reader_of(files, f"{place}/{r['shard']:06d}.ids", r["dtype"])
        parts.append(ids(max(0, start - r["base"]), min(n, start + length - r["base"])).astype("<u4"))
    return np.concatenate(parts) if parts else np.empty(0, "<u4")

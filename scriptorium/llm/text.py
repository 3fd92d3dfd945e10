"""Words of texts as bytes, for the Python side. Texts come as UTF-8 (cast to binary)."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from xxhash import xxh3_64_intdigest

#: Whole texts of an Arrow batch: at 10 KB a text 10 MB, in a worker that holds it some times over.
BATCH = 1000
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def bounded_batches(spark: SparkSession, rows: int = BATCH) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the plans that run inside, as rows are whole
    texts here. The session's setting is as before afterwards."""
    before = spark.conf.get(ROWS)
    spark.conf.set(ROWS, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(ROWS, before)


def trimmed(function: Callable) -> Callable:
    """A function over batches that, at its end, hands memory it no longer needs back to the
    system: a reused worker would else keep the most that any of its tasks took."""

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # no such call in other C libraries
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


#: A-Z lower-cased, then maximal runs of digits, a-z and any non-ASCII character. Bytes
#: from 0x80 occur in UTF-8 only within non-ASCII characters, so runs never split one.
find_words = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def words(text: bytes | None) -> list[bytes]:
    return find_words(text.lower()) if text else []


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words, in order, from the words' hashes."""
    total = np.zeros(max(0, len(h) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(total)])
    return total


def shingles(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words. A text of fewer words,
    but not none, is one shingle."""
    found = words(text)
    return np.unique(run_hashes(word_hashes(found), min(size, len(found)))) if found else np.empty(0, np.uint64)

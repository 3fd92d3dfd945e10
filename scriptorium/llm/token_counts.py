"""Token counts through a digest cache.

The cache is a Parquet table (content digest, tokenizer digest, n_tokens) in a folder
that outlives the run. Counting joins the texts' digests to it, encodes each distinct
text that it lacks once, and appends those counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.tokens import TokenizerFile, encoder

CACHE = "content string, tokenizer string, n_tokens long"


def _counter(file: TokenizerFile):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(file)
        width = 2 if own.code == "H" else 4
        for batch in batches:
            yield pd.DataFrame({"content": batch["content"], "n_tokens": [len(own.packed(t)) // width for t in batch["body"]]})

    return count


def open_cache(spark, path: str) -> DataFrame:
    """The cache at ``path``; a first use starts an empty one."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        spark.createDataFrame([], CACHE).write.parquet(path)
    return spark.read.schema(CACHE).parquet(path)


def count_tokens(docs: DataFrame, tokenizer: TokenizerFile, cache_path: str, max_tokens: int = 1024, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns of each row of ``docs`` with n_bytes (UTF-8), n_tokens and
    over_limit (n_tokens > ``max_tokens``).

    The content that is digested is the whole text, null as empty; nothing else is
    normalised, as any other change could change the count. Repeated texts are encoded
    once: each map task drops its own repeats before the exchange, so a text that a
    third of all rows hold sends a row per task. An empty table appends nothing. Only
    ``text`` and ``carry`` are read. A run that dies before its append is harmless; two
    runs that append the same digest agree on its count.
    """
    spark, version = docs.sparkSession, tokenizer.digest
    cache = open_cache(spark, cache_path)
    body = F.coalesce(F.col("text"), F.lit(""))
    known = cache.where(F.col("tokenizer") == version).select("content", "n_tokens")
    texts = docs.select(F.sha2(body.cast("binary"), 256).alias("content"), body.alias("body"))
    misses = texts.join(known.select("content"), "content", "left_anti").groupBy("content").agg(F.first("body").alias("body"))
    new = misses.mapInPandas(_counter(tokenizer), "content string, n_tokens long")
    new.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    counts = spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer") == version).select("content", "n_tokens")
    counts = counts.dropDuplicates(["content"]) if cache_shared(counts) else counts
    digests = docs.select(*carry, F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body.cast("binary"), 256).alias("content"))
    return digests.join(counts, "content").select(*carry, "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))


def cache_shared(counts: DataFrame) -> bool:
    """Whether some digest stands in the cache twice, as after two runs at once."""
    return not counts.groupBy("content").count().where("count > 1").isEmpty()

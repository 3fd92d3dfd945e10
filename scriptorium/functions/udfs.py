"""User-defined functions of each kind, for what callers add in Python: scalar over Arrow
batches, aggregate, and table function. The engine's own operators prefer built-ins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType


@F.pandas_udf(DoubleType())
def capital_share(texts: pd.Series) -> pd.Series:
    """Share of A-Z among a text's characters; null of null or empty."""
    n = texts.str.len()
    return (texts.str.count("[A-Z]") / n.where(n > 0)).astype(float)


def geometric_means(events: DataFrame, key: str = "event_type", value: str = "value") -> DataFrame:
    """(key, gmean): an aggregate in Python, in two steps: tasks fold their own batches to a
    row a key, and built-in sums merge these. So no key's rows are gathered, as a grouped
    pandas function would gather them. Values that are null or not positive don't count."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = []
        for batch in batches:
            good = batch[batch["x"] > 0]
            parts.append(pd.DataFrame({"k": good["k"], "logs": np.log(good["x"]), "n": 1}).groupby("k", as_index=False).sum())
            if len(parts) == 64:
                parts = [pd.concat(parts).groupby("k", as_index=False).sum()]
        if parts:
            yield pd.concat(parts).groupby("k", as_index=False).sum()[["k", "logs", "n"]]

    rows = events.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(value).cast("double").alias("x"))
    folded = rows.mapInPandas(fold, "k string, logs double, n long")
    return folded.groupBy(F.col("k").alias(key)).agg(F.exp(F.sum("logs") / F.sum("n")).alias("gmean"))


@F.pandas_udf(DoubleType())
def spread(values: pd.Series) -> float:
    """Largest less smallest: a grouped aggregate over the rows of one group, for groups of
    bounded size."""
    return float(values.max() - values.min())


def spreads(rows: DataFrame, keys: tuple[str, ...], value: str = "value") -> DataFrame:
    """(keys, spread): :func:`spread` for many groups of any size, in two steps as
    :func:`geometric_means`: tasks fold batches to the ends of each group there, which built-in
    functions merge. A call a group would cost more than its rows. Null if all values are."""
    given = rows.select(*keys, F.col(value).cast("double").alias("low")).withColumn("high", F.col("low"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            odd = pc.fill_null(pc.is_nan(table["low"]), False)  # Arrow's ends leave these out, SQL's don't
            ends = table.filter(pc.invert(odd)).group_by(list(keys), use_threads=False).aggregate([("low", "min"), ("high", "max")])
            for part in (ends.rename_columns([*keys, "low", "high"]), table.filter(odd)):
                yield from part.cast(table.schema).to_batches()

    folded = given.mapInArrow(fold, given.schema)
    return folded.groupBy(*keys).agg((F.max("high") - F.min("low")).alias("spread"))


@F.udtf(returnType=StructType().add("pos", LongType()).add("word", StringType()), useArrow=True)
class WordsOf:
    """A table function: the words of a text between spaces, with their places."""

    def eval(self, text: str):
        if text is not None:
            for pos, word in enumerate(x for x in text.split(" ") if x):
                yield pos, word

"""Column functions that Spark has no built-in for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inner_product(a: Column | str, b: Column | str) -> Column:
    """Sum of products in double precision; null if either array or an element is."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(inner_product(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null where a vector has length zero."""
    return F.try_divide(inner_product(a, b), norm(a) * norm(b))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two arrays taken as sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def ngrams(words: Column, n: int) -> Column:
    """The runs of ``n`` words, joined by a space; empty where there are fewer."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.concat_ws(" ", *[F.get(words, i + (k - 1)) for k in range(n)]))).otherwise(F.array().cast("array<string>"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores added until no column of ``df`` is called so in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out

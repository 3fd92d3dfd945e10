"""Written intermediate tables in the folder that the whole cluster shares.

A long plan is cut by writing Parquet under ``spark.checkpoint.dir`` and reading it
back: the rows outlive any executor, both sides of a later join come from plain scans
(so adaptive execution may split skewed partitions), and nothing is computed twice.
A function marked :func:`scoped` leaves none behind but those its result still reads.
"""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}
_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, local mode
    (one machine, as in tests) gets a temporary folder; a cluster gets an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = tempfile.mkdtemp(prefix="scriptorium-")
    return "file://" + _local[context.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/scriptorium/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of what was written."""
    return materialise_to(df, name, **options)[0]


def materialise_to(df: DataFrame, name: str, **options) -> tuple[DataFrame, str]:
    """As :func:`materialise`, with the path, for tables that are dropped midway."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if scopes := getattr(_open, "scopes", None):
        scopes[-1].append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written under a hidden name beside it, and renamed."""
    folder, _, name = path.rpartition("/")
    files, place = _place(spark, path)
    _, hidden = _place(spark, f"{folder}/_{name}-{uuid.uuid4().hex}")
    out = files.create(hidden, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not files.rename(hidden, place):
        files.delete(hidden, False)
        raise OSError(f"could not write {path}")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Spark's own file systems."""
    files, place = _place(spark, path)
    files.delete(place, True)


def folders_read(df: DataFrame) -> set[str]:
    """Last names of the folders that a plan scans."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), set()
    for i in range(leaves.size()):
        if (leaf := leaves.apply(i)).getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            out |= {roots.apply(k).getName() for k in range(roots.size())}
    return out


def scoped(function: Callable) -> Callable:
    """Tables that ``function`` wrote with :func:`materialise` are deleted when it returns,
    but for those that a DataFrame it returns (alone or in a tuple) still reads: these
    pass to the scope around it, if there is one. After an error all are deleted."""

    @functools.wraps(function)
    def run(*args, **kwargs):
        scopes = _open.__dict__.setdefault("scopes", [])
        scopes.append([])
        read = set()
        try:
            out = function(*args, **kwargs)
            for df in out if isinstance(out, tuple) else (out,):
                if isinstance(df, DataFrame):
                    read |= folders_read(df)
            return out
        finally:
            made, spark = scopes.pop(), SparkSession.getActiveSession()
            for path in made:
                if path.rpartition("/")[2] in read:
                    if scopes:
                        scopes[-1].append(path)
                elif spark:
                    drop_path(spark, path)

    return run


def fingerprint(spark: SparkSession, path: str) -> str:
    """A name for the files under ``path`` as they are: their paths, sizes and times. Their
    contents are not read."""
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)").alias("x"))
    n, total = files.agg(F.count("*"), F.sum("x")).head()
    return f"{path}:{n}:{total}"


def spread(df: DataFrame) -> DataFrame:
    """``df`` itself, or, where its files give fewer partitions than there are cores, its rows
    dealt to one a core: one row group is one task, however much there is to compute. A plan
    with an exchange is left as it is: counting its partitions would run it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def broadcast_if(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """``df`` to be broadcast only if its counted rows are within ``limit``. Beyond it the
    join is a sort-merge one, whose skewed partitions AQE splits, whatever Spark makes of
    the size of the files."""
    return F.broadcast(df) if rows <= limit else df.hint("merge")


def counted(df: DataFrame, limit: int) -> DataFrame:
    """:func:`broadcast_if` for a written table: its rows are counted here."""
    return broadcast_if(df, df.count(), limit)


def hashed_sample(df: DataFrame, key: str, limit: int) -> list:
    """Up to ``limit`` distinct rows of ``df``, those of the least hash of ``key``, in that order.
    Rows under a cut-off that the row count gives are sent to the driver, some tenths more
    than asked for, whatever the number of tasks; an ordered limit would send ``limit`` rows
    of each task."""
    ordered = df.withColumn("hash_of", F.xxhash64(key))
    n = df.count()
    share = min(1.0, (limit + 6 * limit**0.5 + 6) / max(1, n))
    while True:
        rows = (ordered if share >= 1 else ordered.where(F.col("hash_of") <= int(-(2**63) + share * 2**64))).distinct().collect()
        if share >= 1 or len(rows) >= limit:
            best = sorted(rows, key=lambda r: (r["hash_of"], r[key]))[:limit]
            return best
        share = min(1.0, 4 * share)  # rows that repeat a key are one

"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: ContextVar[str] = ContextVar("scratch", default="stages")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where that is unset, in one process as in tests, a new temporary one; on a cluster an error, as executors would write to disks of their own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tidewell-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidewell/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own_dir(spark)}/{_SCRATCH.get()}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch(name: str) -> Iterator[None]:
    """Within it, stage() writes below a folder of this name, which drop_stages() can remove on its own."""
    token = _SCRATCH.set(name)
    try:
        yield
    finally:
        _SCRATCH.reset(token)


#: Rows of a small table that go to one file.
ROWS_A_FILE = 250_000


#: Rows that Python tasks over whole texts see at a time, and bytes from which on a batch is closed.
TEXTS_A_BATCH, BYTES_A_BATCH = 1_000, 4_000_000
_BATCH, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def stage(df: DataFrame, name: str, rows: int | None = None, batch: int | None = None, apart: bool = False, a_file: int = ROWS_A_FILE) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back, so that a lost executor costs no recomputation and reruns of a later task see the same rows.

    ``rows``, a bound of their number, is for narrow rows: few of them go to few files of ``a_file`` rows, however many partitions the session has.  With ``apart`` the
    tasks that make the rows stay as many as they are, and the rows are dealt to the files.
    ``batch`` bounds the rows, and BYTES_A_BATCH the bytes, that Python tasks hold at a time while these rows are made.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    if rows is not None:
        files = max(1, -(-rows // a_file))
        df = df.repartition(files) if apart else df.coalesce(files)
    before, bytes_before = spark.conf.get(_BATCH), spark.conf.get(_BYTES)
    if batch is not None:
        spark.conf.set(_BATCH, str(min(batch, int(before)) if int(before) > 0 else batch))
        spark.conf.set(_BYTES, str(BYTES_A_BATCH))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
        spark.conf.set(_BYTES, bytes_before)
    return spark.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession, name: str | None = None) -> None:
    """Remove what stage() has written for this application, or within scratch(name); results that read it must have been consumed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark) + (f"/{name}" if name else ""))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Narrow rows that are no burden to one task.
ALONE = 1_000_000


def joined_with_hot(left: DataFrame, right: DataFrame, keys: list[str], rows: int, how: str = "inner") -> DataFrame:
    """left.join(right, keys, how) where a key may hold a large part of the left side's ``rows``; ``right`` has a row for each key.

    Keys that hold more than a partition's share are as many as there are partitions at most: their rows of ``right`` are broadcast, so they need no shuffle.
    Up to ALONE rows, which one task can take even if all have one key, it is a plain join.
    """
    if rows <= ALONE:
        return left.join(right, keys, how)
    share = max(1_000, rows // partitions(left.sparkSession))
    hot = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > share).select(*keys)
    few = F.broadcast(right.join(F.broadcast(hot), keys, "left_semi"))
    names = [*left.columns, *(c for c in right.columns if c not in keys)]
    rest = left.join(F.broadcast(hot), keys, "left_anti").join(right, keys, how)
    return left.join(few, keys).select(*names).unionByName(rest.select(*names))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spaced(col) -> "F.Column":
    """The text with its white space (by code point) as single spaces, without any at its ends, in lower case."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[\x20\x09-\x0D]+", " "))

"""A shelf in buckets: a batch reads and writes only the buckets that its rows are in.

A row's bucket follows from (source, external_id).  Batch ``no`` finds each bucket as the latest version up to ``no`` has it and
writes the buckets that it touches as version ``no`` + 1, so that a batch that is run again after a failure reads what it read before
and replaces what it wrote.  The memory of bands grows by what each batch adds; from time to time it is written whole.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import lifecycle
from tidewell.sources.shared import removed

BUCKETS = 64
#: Batches after which the memory is written whole, without what is forgotten.
WHOLE = 32


def bucket(source: Column, external_id: Column) -> Column:
    return F.pmod(F.xxhash64(source, external_id), F.lit(BUCKETS)).cast("int")


def _listed(spark: SparkSession, folder: str, names: str) -> list[tuple[int, ...]]:
    """The numbers in the paths below ``folder`` that are like ``names``, as 'version=*/bucket=*'."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{names}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    numbers = re.compile(".*/" + names.replace("*", r"(\d+)"))
    return [tuple(map(int, numbers.match(f.getPath().toString()).groups())) for f in found or []]


def versions(spark: SparkSession, folder: str, no: int) -> dict[int, int]:
    """Of each bucket that was written before batch ``no``, its latest version."""
    out: dict[int, int] = {}
    for version, own in _listed(spark, folder, "version=*/bucket=*"):
        if version <= no:
            out[own] = max(version, out.get(own, 0))
    return out


def read(spark: SparkSession, folder: str, no: int, schema: str, only: list[int] | None = None) -> DataFrame:
    """The shelf as it was before batch ``no``, or the buckets ``only`` of it."""
    paths = [f"{folder}/version={v}/bucket={b}" for b, v in sorted(versions(spark, folder, no).items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert(spark: SparkSession, folder: str, no: int, jobs: DataFrame, as_of: datetime, schema: str) -> list[int]:
    """Write parsed jobs over the shelf as batch ``no``; the buckets that were written.  ``jobs`` is read twice."""
    own = bucket(F.col("source"), F.col("external_id"))
    touched = sorted(r[0] for r in jobs.select(own.alias("b")).distinct().collect())  # BUCKETS numbers at most
    written = lifecycle.shelf_upserted(read(spark, folder, no, schema, touched), jobs, as_of)
    if touched:
        written.withColumn("bucket", own).repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/version={no + 1}")
    else:
        removed(spark, f"{folder}/version={no + 1}")
    return touched


def swept(spark: SparkSession, folder: str, no: int) -> None:
    """Remove the versions that neither batch ``no``, should it be run again, nor a later one reads."""
    held = versions(spark, folder, no)
    for version, own in _listed(spark, folder, "version=*/bucket=*"):
        if version < held.get(own, 0):
            removed(spark, f"{folder}/version={version}/bucket={own}")


def remember(spark: SparkSession, folder: str, no: int, new: DataFrame, memory: DataFrame) -> None:
    """Write what batch ``no`` adds to the memory; every WHOLE batches all that is still remembered instead."""
    name, rows = ("whole", memory.unionByName(new)) if (no + 1) % WHOLE == 0 else ("added", new)
    rows.write.mode("overwrite").parquet(f"{folder}/{name}={no + 1}")
    base = max((b for (b,) in _listed(spark, folder, "whole=*") if b <= no), default=0)
    for kind, last in (("added", base), ("whole", base - 1)):  # what neither this batch nor a later one reads
        for (b,) in _listed(spark, folder, f"{kind}=*"):
            if b <= last:
                removed(spark, f"{folder}/{kind}={b}")


def remembered(spark: SparkSession, folder: str, no: int, schema: str) -> DataFrame:
    """What was remembered before batch ``no``: the last whole table, and what batches have added since."""
    base = max((b for (b,) in _listed(spark, folder, "whole=*") if b <= no), default=0)
    paths = [f"{folder}/whole={base}"] * (base > 0) + [f"{folder}/added={b}" for (b,) in sorted(_listed(spark, folder, "added=*")) if base < b <= no]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

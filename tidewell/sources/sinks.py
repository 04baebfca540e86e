"""Where rows go: the inbox by batches, and what an enumeration exports.  Each writes a folder that a rerun of the same batch writes over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import lifecycle


def append_inbox(new: DataFrame, folder: str, batch: int) -> DataFrame:
    """Write the new rows that earlier batches lack, and give back what was written: running a batch again writes the same rows."""
    spark = new.sparkSession
    earlier = [b for b in range(batch) if _there(spark, f"{folder}/batch={b}")]
    known = spark.read.schema(new.schema).parquet(*[f"{folder}/batch={b}" for b in earlier]) if earlier else new.limit(0)
    lifecycle.appended(new, known).write.mode("overwrite").parquet(f"{folder}/batch={batch}")
    return spark.read.schema(new.schema).parquet(f"{folder}/batch={batch}")


def _there(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def candidate_lines(candidates: DataFrame, validated: bool = True) -> DataFrame:
    """place, line of an enumeration's candidates (slug, job_count, sample_titles): a list item each, by jobs if they were validated, else by slug."""
    titles = F.left(F.array_join(F.filter("sample_titles", lambda t: T.blank(t) != ""), "; "), F.lit(120))
    jobs = F.coalesce("job_count", F.lit(0))
    note = F.when((jobs > 0) & F.lit(validated), F.concat(F.lit("  # "), jobs.cast("string"), F.lit(" jobs: "), titles)).otherwise("")
    place = F.struct((-jobs if validated else F.lit(0)).alias("jobs"), "slug")
    return candidates.select(place.alias("place"), F.concat(F.lit("  - "), F.col("slug"), note).alias("line"))


def export_enumeration(candidates: DataFrame, folder: str, validated: bool = True) -> None:
    """The candidates as JSON lines, as list items and as rows of a sheet (CSV), each in the list's order."""
    lines = candidate_lines(candidates, validated).orderBy("place")
    lines.select("line").write.mode("overwrite").text(f"{folder}/items")
    ordered = candidates.withColumn("_place", F.struct((-F.coalesce("job_count", F.lit(0)) if validated else F.lit(0)).alias("jobs"), "slug")).orderBy("_place").drop("_place")
    ordered.write.mode("overwrite").json(f"{folder}/json")
    ordered.withColumn("sample_titles", F.array_join(F.filter("sample_titles", lambda t: T.blank(t) != ""), "; ")).write.mode("overwrite").option("header", True).csv(f"{folder}/sheet")


def curated(lines: DataFrame, slugs: DataFrame) -> DataFrame:
    """place, line of a curated list (no, line) with more slugs: its comment lines first, in their order, then all distinct slugs sorted."""
    comments = lines.filter(F.col("line").startswith("#")).select(F.struct(F.lit(0).alias("part"), F.col("no").cast("long").alias("no"), F.lit("").alias("slug")).alias("place"), "line")
    every = lines.select(T.strip(F.col("line")).alias("line")).unionByName(slugs.select(T.strip(F.col("slug")).alias("line"))).filter("line <> '' AND line NOT LIKE '#%'").distinct()
    return comments.unionByName(every.select(F.struct(F.lit(1).alias("part"), F.lit(0).cast("long").alias("no"), F.col("line").alias("slug")).alias("place"), "line"))

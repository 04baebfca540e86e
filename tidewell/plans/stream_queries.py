"""Registered queries of the streams: each reads the tables as a stream until all is done, with the SQL that gives the same rows of them."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.plans import fixtures as X
from tidewell.plans.catalog import query
from tidewell.sources.shared import new_folder
from tidewell.streaming import inbox

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """Within it, streams keep their state in RocksDB, which timers need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _streamed(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    # A pattern of the one name: the table may be a file, which a stream takes by a pattern only.
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{table}.parquet").schema).parquet(f"{sf_dir}/{table}.parque[t]")


def _finished(stream: DataFrame, name: str) -> DataFrame:
    """All rows that the stream has given once everything that is there has been read."""
    spark = stream.sparkSession
    folder = new_folder(spark, name)
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


_FETCHED = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(doc_id % 20000 AS INT)"


@query(
    f"""WITH f AS (SELECT source AS source_name, CAST(doc_id // 50 AS VARCHAR) AS fetch_key, sha256(text) AS checksum, {_FETCHED} AS fetched_at FROM documents),
    l AS (SELECT *, coalesce(checksum = lag(checksum) OVER w, false) AS unchanged FROM f WINDOW w AS (PARTITION BY source_name, fetch_key ORDER BY fetched_at, checksum)),
    s AS (SELECT source_name, fetch_key, checksum, unchanged, max(CASE WHEN NOT unchanged THEN fetched_at END) OVER (PARTITION BY source_name, fetch_key ORDER BY fetched_at, checksum ROWS UNBOUNDED PRECEDING) AS last_changed_at, false AS expired, fetched_at FROM l),
    last AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY source_name, fetch_key ORDER BY fetched_at DESC, checksum DESC) = 1)
    SELECT * EXCLUDE (fetched_at) FROM s UNION ALL
    SELECT source_name, fetch_key, checksum, NULL, last_changed_at, true FROM last WHERE fetched_at + INTERVAL '30' DAY <= (SELECT max(fetched_at) FROM f) - INTERVAL '1' DAY"""
)
def stream_changes(spark, sf_dir):
    rows = _streamed(spark, sf_dir, "documents").select(F.col("source").alias("source_name"), F.floor(F.col("doc_id") / 50).cast("string").alias("fetch_key"), F.col("text").alias("body"), F.expr(_FETCHED).alias("fetched_at"))
    with _rocks(spark):
        return _finished(inbox.changes(rows), "changes")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_within(spark, sf_dir):
    events = _streamed(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    firsts = inbox.first_within(events, ["user_id", "event_type"], "ts")
    return _finished(firsts.select("user_id", "event_type"), "firsts")


_SUM = "CAST(coalesce(sum(CAST(json_extract_string(stats, '$.{0}') AS BIGINT)), 0) AS BIGINT)"


@query(
    f"""AND ends AS (SELECT unnest(generate_series(date_trunc('hour', min(finished_at)), date_trunc('hour', max(finished_at)) + INTERVAL '24' HOUR, INTERVAL '1' HOUR)) AS until FROM runs)
    SELECT until, {_SUM.format('refined')} AS throughput, {_SUM.format('duplicate')} + {_SUM.format('rejected')} AS waste, {_SUM.format('jobs_stored')} AS arrivals
    FROM ends JOIN runs ON finished_at >= until - INTERVAL '24' HOUR AND finished_at < until WHERE until <= (SELECT max(finished_at) FROM runs) - INTERVAL '1' DAY GROUP BY until""", "runs",
)
def stream_flow(spark, sf_dir):
    runs = spark.sql(X._for_spark(X.RUNS), events=_streamed(spark, sf_dir, "events")).withColumn("finished_at", F.col("finished_at").cast("timestamp"))
    # A window is given once the watermark has passed its end, so the last day is still open.
    return _finished(inbox.rolling_flow(runs).select(F.col("window.end").alias("until"), "throughput", "waste", "arrivals"), "flow")

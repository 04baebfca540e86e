"""The engine on streams: draining the inbox, keyed dedup with a memory, change detection.

The drain's state is tables below a folder that driver and executors share, versioned by bucket (see shelf.py), so
a batch that is run again after a failure writes the same rows.  The change detector's is Spark's own, with timers that end it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tidewell import schemas
from tidewell.functions.values import counter
from tidewell.operators import nearsim
from tidewell.plans import refine as R
from tidewell.sources.shared import new_folder, removed, staged
from tidewell.streaming import shelf


def drained(inbox_path: str, folder: str, index: Callable[[SparkSession], DataFrame], settings: R.Settings, spark: SparkSession) -> StreamingQuery:
    """Refine every file of the inbox as one batch, until all are done.

    The batch a row is in matters: alike rows of one batch all stay, of two batches the first does.
    One file per batch makes that explicit.  A batch rewrites the shelf's buckets that it has rows for.
    """
    rows = spark.readStream.schema(schemas.RAW).option("maxFilesPerTrigger", 1).parquet(inbox_path)

    def refine(batch: DataFrame, no: int) -> None:
        s = batch.sparkSession
        old, memory = shelf.read(s, f"{folder}/shelf", no, schemas.SHELF), shelf.remembered(s, f"{folder}/memory", no, schemas.MEMORY)
        fetched = s.createDataFrame([], "url string, fetched string")
        done = R.refine(batch, old, memory, index(s), fetched, settings)
        done.outcomes.write.mode("overwrite").parquet(f"{folder}/outcomes/{no}")
        shelf.upsert(s, f"{folder}/shelf", no, done.jobs, settings.as_of, schemas.SHELF)
        kept = nearsim.forgotten(memory, F.lit(settings.as_of), settings.window_days)
        shelf.remember(s, f"{folder}/memory", no, done.added, kept)
        done.release()
        shelf.swept(s, f"{folder}/shelf", no)

    return rows.writeStream.foreachBatch(refine).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()


def near_marked(stream: DataFrame, folder: str, window_days: int = nearsim.WINDOW_DAYS) -> StreamingQuery:
    """Write (id, near) of postings (id, content_hash, text, seen_at) below ``folder``/outcomes: whether a text is like one that an earlier batch has remembered.

    The present of a batch is its newest row.  Texts that are near to none are remembered until they are ``window_days`` old; alike texts of one
    batch are all new.  A batch that is run again writes the same.
    """

    def mark(batch: DataFrame, no: int) -> None:
        s, own = batch.sparkSession, new_folder(batch.sparkSession, "near")
        now = batch.agg(F.max("seen_at")).first()[0]
        if now is None:
            return
        memory = nearsim.forgotten(shelf.remembered(s, f"{folder}/memory", no, schemas.MEMORY), F.lit(now), window_days)
        bands = staged(nearsim.band_hashes(batch.select("id", "text")), own, "bands")
        near = staged(nearsim.near_duplicates(bands, memory, F.lit(now), window_days=window_days), own, "near")
        batch.select("id").join(near.withColumn("near", F.lit(True)), "id", "left").select("id", F.coalesce("near", F.lit(False)).alias("near")).write.mode("overwrite").parquet(f"{folder}/outcomes/{no}")
        new = bands.join(near, "id", "left_anti").join(batch.select("id", "content_hash", "seen_at"), "id").select("content_hash", "band", "band_hash", "seen_at")
        shelf.remember(s, f"{folder}/memory", no, nearsim.unknown_bands(memory, new), memory)
        removed(s, own)

    return stream.writeStream.foreachBatch(mark).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()


def first_within(stream: DataFrame, keys: list[str], time_col: str, delay: str = "10 days") -> DataFrame:
    """The first row of each key within the delay: exact dedup whose memory forgets."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


# Times are microseconds here, which are the same in any time zone of a worker.
_CHANGE = "source_name string, fetch_key string, checksum string, unchanged boolean, since long, expired boolean"
_CHANGED = Row(*[c.split()[0] for c in _CHANGE.split(", ")])
#: How long a body is known after it was last fetched.
FORGET = timedelta(days=30)


class Follower(StatefulProcessor):
    """Of each key the last checksum and since when it holds, until a timer of the watermark forgets both.

    It takes rows, as keys are many and have few rows each, and asks the state store as little as it can: for the state, and for a timer only where the newest time is another.
    """

    def __init__(self, forget: timedelta):
        self.forget = int(forget.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "checksum string, since long, seen long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803  names of the API
        checksum, since, before = self.last.get() or (None, None, None)
        seen = before
        for at, now in sorted(((r.at, r.checksum) for r in rows), key=lambda x: tuple((v is None, v) for v in x)):
            same = now is not None and now == checksum
            if not same:
                checksum, since = now, at
            seen = at if seen is None else seen if at is None else max(seen, at)
            yield _CHANGED(*key, checksum, same, since, False)
        self.last.update((checksum, since, seen))
        if seen != before:
            if before is not None:
                self.handle.deleteTimer(self._end(before))
            self.handle.registerTimer(self._end(seen))

    def _end(self, seen: int) -> int:
        return seen // 1000 + self.forget

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        checksum, since, _ = self.last.get()
        self.last.clear()
        yield _CHANGED(*key, checksum, None, since, True)

    def close(self) -> None:
        pass


def changes(stream: DataFrame, forget: timedelta = FORGET, delay: str = "1 day") -> DataFrame:
    """Fetched bodies (source_name, fetch_key, body, fetched_at) with whether they are as the key's last one, and since when.

    A key that the watermark, ``delay`` behind the newest row, has left by more than ``forget`` goes: a row with ``expired`` tells so, and its next body is new again.
    Timers follow the rows' own times, so a replay gives the same rows.  The session's state store must be the one of RocksDB.
    """
    hashed = stream.select("source_name", "fetch_key", F.sha2("body", 256).alias("checksum"), "fetched_at", F.unix_micros("fetched_at").alias("at")).withWatermark("fetched_at", delay)
    told = hashed.groupBy("source_name", "fetch_key").transformWithState(Follower(forget), _CHANGE, "Append", "EventTime")
    return told.select("source_name", "fetch_key", "checksum", "unchanged", F.timestamp_micros("since").alias("last_changed_at"), "expired")


def rolling_flow(runs: DataFrame) -> DataFrame:
    """window, throughput, waste, arrivals of a stream of runs (finished_at, stats): sums over the 24 hours to each full hour."""
    total = lambda name: F.coalesce(F.sum(counter(F.col("stats"), name)), F.lit(0))
    hours = F.window("finished_at", "24 hours", "1 hour").alias("window")
    return runs.withWatermark("finished_at", "1 day").groupBy(hours).agg(total("refined").alias("throughput"), (total("duplicate") + total("rejected")).alias("waste"), total("jobs_stored").alias("arrivals"))

"""What happens to rows over time.  Tables are immutable, so each step returns the next version."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import values as V
from tidewell.functions.text import blank

EXPIRE_DAYS, SHELF_DAYS, INBOX_DAYS, RUN_DAYS = 14, 21, 42, 30
STALE_CLAIM_SECONDS = 1800
TERMINAL = ("refined", "rejected", "duplicate")


def _before(as_of: datetime, **ago) -> Column:
    return F.lit(as_of - timedelta(**ago))


def upserted(table: DataFrame, new: DataFrame, keys: list[str], kept: list[str], order: str | None = None) -> DataFrame:
    """``table`` with ``new`` rows written over those of equal keys; ``kept`` columns stay as the old row has them.

    Of several new rows with one key the last by ``order`` counts.
    """
    if order:
        w = Window.partitionBy(*keys).orderBy(F.desc(order))
        new = new.withColumn("_no", F.row_number().over(w)).filter("_no = 1").drop("_no")
    old = table.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_{c}") for c in kept], F.lit(True).alias("_old"))
    both = new.join(old, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left")
    written = both.select(*[F.when(F.col("_old"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in kept else F.col(c) for c in table.columns])
    return table.join(new.select(*keys), keys, "left_anti").select(*table.columns).unionByName(written)


def shelf_upserted(shelf: DataFrame, jobs: DataFrame, as_of: datetime) -> DataFrame:
    """The shelf with parsed jobs: seen now and active; first_seen_at and id stay with the row that had them."""
    now = F.lit(as_of)
    new = jobs.withColumns({"first_seen_at": now, "last_seen_at": now, "scraped_at": now, "status": F.lit("active")})
    for f in shelf.schema:
        if f.name not in new.columns:
            new = new.withColumn(f.name, F.lit(None).cast(f.dataType))
    return upserted(shelf, new.select(*shelf.columns), ["source", "external_id"], ["first_seen_at", "id"], order="id")


def touch_last_seen(shelf: DataFrame, seen: DataFrame, as_of: datetime) -> DataFrame:
    """An extension, off by default: rows seen again (source, external_id) are active and seen now."""
    again = seen.select("source", "external_id").distinct().withColumn("_seen", F.lit(True))
    rows = shelf.join(again, ["source", "external_id"], "left")
    return rows.withColumns({"last_seen_at": F.when("_seen", F.lit(as_of)).otherwise(F.col("last_seen_at")), "status": F.when(F.col("_seen"), "active").otherwise(F.col("status"))}).select(*shelf.columns)


def unknown_only(new: DataFrame, inbox: DataFrame) -> DataFrame:
    """New inbox rows whose (source, external_id) isn't there yet; rows without an id always pass."""
    known = inbox.filter(F.col("external_id") != "").select("source", "external_id").distinct()
    named = F.col("external_id") != ""
    return new.filter(named).join(known, ["source", "external_id"], "left_anti").select(*new.columns).unionByName(new.filter(~named))


def appended(new: DataFrame, inbox: DataFrame) -> DataFrame:
    """The rows that an insert adds to the inbox: of each (source, external_id) that isn't there yet the first by id; rows without an id all."""
    w = Window.partitionBy("source", "external_id", F.when(F.col("external_id") == "", F.col("id"))).orderBy("id")
    return unknown_only(new.withColumn("_no", F.row_number().over(w)).filter("_no = 1").drop("_no"), inbox)


def inbox_first_only(inbox: DataFrame) -> DataFrame:
    """One row of each (source, external_id), the last by arrival; rows without an id stay."""
    w = Window.partitionBy("source", "external_id").orderBy(F.desc("ingested_at"), F.desc("id"))
    named = inbox.filter(F.col("external_id") != "").withColumn("_no", F.row_number().over(w)).filter("_no = 1").drop("_no")
    return named.unionByName(inbox.filter(F.col("external_id") == ""))


# Columns of the shelf's predecessor, and what its nulls become where the shelf allows none.
V1_COLUMNS = (
    "external_id", "title", "company", "location", "remote", "description", "salary_min", "salary_max", "url", "source", "keywords", "scraped_at", "metadata", "job_type", "content_hash", "score_stage_1", "score_stage_2",
    "archetype", "company_domain", "score_stage_3", "match_reasoning", "match_highlights", "match_pitch", "location_normalized", "location_lat", "location_lon", "is_remote", "is_hybrid", "dq_flags",
)
V1_NEVER_NULL = {"score_stage_1": 0, "is_remote": False, "is_hybrid": False, "remote": False}


def v1_as_v2(rows: DataFrame, as_of: datetime) -> DataFrame:
    """Rows of the shelf's predecessor in the shelf's shape: V1_COLUMNS as far as they are there, seen first and last when they were scraped, active."""
    kept = {c: F.coalesce(c, F.lit(V1_NEVER_NULL[c])) if c in V1_NEVER_NULL else F.col(c) for c in V1_COLUMNS if c in rows.columns}
    if "dq_flags" in kept:
        kept["dq_flags"] = F.coalesce("dq_flags", F.create_map().cast(rows.schema["dq_flags"].dataType))
    seen = F.coalesce("scraped_at", F.lit(as_of))
    return rows.select(*[col.alias(c) for c, col in kept.items()], seen.alias("first_seen_at"), seen.alias("last_seen_at"), F.lit("active").alias("status"))


def copied(v1: DataFrame, shelf: DataFrame, as_of: datetime) -> DataFrame:
    """The shelf with all rows of its predecessor written over those of equal keys; running it again changes nothing."""
    new = v1_as_v2(v1, as_of)
    w = Window.partitionBy("source", "external_id").orderBy(F.col("scraped_at").desc_nulls_last(), F.desc("title"))
    new = new.withColumn("_no", F.row_number().over(w)).filter("_no = 1").drop("_no")
    for f in shelf.schema:
        if f.name not in new.columns:
            new = new.withColumn(f.name, F.lit(None).cast(f.dataType))
    return upserted(shelf, new.select(*shelf.columns), ["source", "external_id"], ["id"] if "id" in shelf.columns else [])


def writable(jobs: DataFrame) -> DataFrame:
    """id, written: whether the shelf's constraints let a row in; Spark writes a batch as a whole, so rows that can't be are told before."""
    needed = F.lit(True)
    for c in ("source", "external_id", "title", "url"):
        needed = needed & F.col(c).isNotNull()
    return jobs.select("id", (needed & (F.col("source") != "") & (F.col("external_id") != "")).alias("written"))


def after_write(inbox: DataFrame, flags: DataFrame) -> DataFrame:
    """The inbox with written rows as refined; those that failed are new again and unclaimed."""
    rows = inbox.join(flags.select("id", F.col("written").alias("_written")), "id", "left")
    return rows.withColumns({"status": F.when(F.col("_written"), "refined").when(~F.col("_written"), "new").otherwise(F.col("status")), "claimed_at": F.when(F.col("_written").isNull() | F.col("_written"), F.col("claimed_at"))}).select(*inbox.columns)


def claim_tier(source: Column, priority: list[str], deferred: list[str]) -> Column:
    return F.when(source.isin(priority), 1).when(source.isin(deferred), 3).otherwise(2)


def claimed(inbox: DataFrame, limit: int, priority: list[str] = (), deferred: list[str] = ()) -> DataFrame:
    """The new rows that come first: by tier, arrival, id; each task keeps ``limit`` rows."""
    tier = claim_tier(F.col("source"), list(priority), list(deferred))
    return inbox.filter(F.col("status") == "new").withColumn("tier", tier).orderBy("tier", "ingested_at", "id").limit(limit)


def after_claim(inbox: DataFrame, batch: DataFrame, as_of: datetime) -> DataFrame:
    """The inbox with the batch's rows as being refined."""
    ids = batch.select("id", F.lit(True).alias("_mine"))
    rows = inbox.join(ids, "id", "left")
    return rows.withColumns({"status": F.when(F.col("_mine"), "refining").otherwise(F.col("status")), "claimed_at": F.when(F.col("_mine"), F.lit(as_of)).otherwise(F.col("claimed_at"))}).select(*inbox.columns)


def released(inbox: DataFrame, as_of: datetime, seconds: int = STALE_CLAIM_SECONDS) -> DataFrame:
    """The inbox with claims that are too old taken back."""
    old = (F.col("status") == "refining") & (F.col("claimed_at") < _before(as_of, seconds=seconds))
    old = F.coalesce(old, F.lit(False))
    return inbox.withColumns({"status": F.when(old, "new").otherwise(F.col("status")), "claimed_at": F.when(~old, F.col("claimed_at"))})


def runs_given_up(runs: DataFrame, before: datetime) -> DataFrame:
    """The run log with runs that began before then and still run as failed."""
    dead = (F.col("status") == "running") & (F.col("started_at") < F.lit(before))
    return runs.withColumns({"status": F.when(dead, "failed").otherwise(F.col("status")), "error": F.when(dead, "reclaimed").otherwise(F.col("error"))})


def run_starts(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """The wanted sources of which no run is on."""
    return wanted.join(runs.filter(F.col("status") == "running").select("source"), "source", "left_anti")


def expired(shelf: DataFrame, as_of: datetime, days: int = EXPIRE_DAYS) -> DataFrame:
    gone = (F.col("status") == "active") & (F.col("last_seen_at") < _before(as_of, days=days))
    return shelf.withColumn("status", F.when(gone, "expired").otherwise(F.col("status")))


def retained(shelf: DataFrame, protected: DataFrame, as_of: datetime, days: int = SHELF_DAYS) -> DataFrame:
    """The shelf without rows unseen for so long, but for companies (company) that are protected, in any case."""
    safe = protected.select(F.lower("company").alias("_company")).distinct()
    old = F.coalesce(F.col("last_seen_at") < _before(as_of, days=days), F.lit(False))
    kept_old = shelf.filter(old).withColumn("_company", F.lower("company")).join(safe, "_company", "left_semi").select(*shelf.columns)
    return shelf.filter(~old).unionByName(kept_old)


def inbox_retained(inbox: DataFrame, as_of: datetime, days: int = INBOX_DAYS) -> DataFrame:
    return inbox.filter(~F.coalesce(F.col("status").isin(*TERMINAL) & (F.col("ingested_at") < _before(as_of, days=days)), F.lit(False)))


def purge_count(inbox: DataFrame, as_of: datetime, days: int = INBOX_DAYS) -> DataFrame:
    return inbox.filter(F.col("status").isin(*TERMINAL) & (F.col("ingested_at") < _before(as_of, days=days))).agg(F.count(F.lit(1)).alias("purged"))


def runs_retained(runs: DataFrame, as_of: datetime, days: int = RUN_DAYS) -> DataFrame:
    return runs.filter(F.col("started_at") >= _before(as_of, days=days))


def fetch_outcomes(bodies: DataFrame, cache: DataFrame, as_of: datetime) -> DataFrame:
    """source_name, fetch_key, checksum, unchanged, last_fetched_at, last_changed_at of fetched bodies (source_name, fetch_key, body)."""
    known = cache.select("source_name", "fetch_key", F.col("checksum").alias("_before"), F.col("last_changed_at").alias("_changed"))
    rows = bodies.select("source_name", "fetch_key", F.sha2(blank(F.col("body")), 256).alias("checksum")).join(known, ["source_name", "fetch_key"], "left")
    same = F.coalesce(F.col("_before") == F.col("checksum"), F.lit(False))
    return rows.select("source_name", "fetch_key", "checksum", same.alias("unchanged"), F.lit(as_of).alias("last_fetched_at"), F.when(same, F.col("_changed")).otherwise(F.lit(as_of)).alias("last_changed_at"))


def due_sources(sources: DataFrame, runs: DataFrame, as_of: datetime, least_hours: float | None = None, anchor_hour: int | None = None) -> DataFrame:
    """source, last_success, due: by the daily anchor if there is one, else by the hours since the last success."""
    last = runs.filter(F.col("status") == "done").groupBy("source").agg(F.max("started_at").alias("last_success"))
    since = V.anchor(F.lit(as_of), anchor_hour) if anchor_hour is not None else F.lit(as_of - timedelta(hours=least_hours))
    recent = F.col("last_success") >= since if anchor_hour is not None else F.col("last_success") > since
    return sources.select("source").distinct().join(last, "source", "left").withColumn("due", ~F.coalesce(recent, F.lit(False)))


def latest_runs(runs: DataFrame, among: int = 500) -> DataFrame:
    """The newest run of each source among the newest runs of all."""
    newest = runs.orderBy(F.desc("started_at"), F.desc("id")).limit(among)
    w = Window.partitionBy("source").orderBy(F.desc("started_at"), F.desc("id"))
    return newest.withColumn("_no", F.row_number().over(w)).filter("_no = 1").drop("_no")


def last_runs(runs: DataFrame, as_of: datetime, n: int, hours: int) -> DataFrame:
    return runs.filter(F.col("started_at") >= _before(as_of, hours=hours)).orderBy(F.desc("started_at"), F.desc("id")).limit(n)


def run_list(runs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest runs of all, newest first."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)

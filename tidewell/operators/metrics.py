"""Health and flow figures: one pass over narrow columns each."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import values as V

WIP_LIMIT = 30_000


def coverage(shelf: DataFrame, as_of: datetime) -> DataFrame:
    """total, location_pct, flagged_pct, last_24h; zeros for an empty shelf."""
    n = F.count(F.lit(1))
    share = lambda cond: V.rounded(F.coalesce(F.try_divide(F.count_if(cond) * 100.0, n), F.lit(0.0)), 2)
    flagged = F.coalesce(F.size("dq_flags") > 0, F.lit(False))
    return shelf.agg(n.alias("total"), share(F.col("location_normalized").isNotNull()).alias("location_pct"), share(flagged).alias("flagged_pct"), F.count_if(F.col("scraped_at") >= F.lit(as_of - timedelta(hours=24))).alias("last_24h"))


def backlog(inbox: DataFrame, as_of: datetime) -> DataFrame:
    """waiting, oldest_hours, oldest_seconds, gate of the rows that are new."""
    new = inbox.filter(F.col("status") == "new")
    seconds = F.coalesce(F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp(F.min("ingested_at")), F.lit(0)).cast("long")
    rows = new.agg(F.count(F.lit(1)).alias("waiting"), seconds.alias("oldest_seconds"))
    return rows.select("waiting", V.rounded(F.col("oldest_seconds") / 3600.0, 1).alias("oldest_hours"), "oldest_seconds", F.when(F.col("waiting") >= WIP_LIMIT, "throttled").otherwise("open").alias("gate"))


def flow(refine_runs: DataFrame, scrape_runs: DataFrame, as_of: datetime) -> DataFrame:
    """throughput, waste, waste_rate, arrivals of the last 24 hours; runs without figures count as nothing."""
    since = F.lit(as_of - timedelta(hours=24))
    c = lambda name: F.coalesce(F.sum(V.counter(F.col("stats"), name)), F.lit(0))
    done = refine_runs.filter(F.col("finished_at") >= since).agg(c("refined").alias("throughput"), (c("duplicate") + c("rejected")).alias("waste"))
    came = scrape_runs.filter(F.col("finished_at") >= since).agg(c("jobs_stored").alias("arrivals"))
    rate = F.coalesce(F.try_divide(F.col("waste").cast("double"), F.col("throughput") + F.col("waste")), F.lit(0.0))
    return done.crossJoin(came).select("throughput", "waste", V.rounded(rate, 2).alias("waste_rate"), "arrivals")  # one row each


def statuses(inbox: DataFrame) -> DataFrame:
    return inbox.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """fetched, refined, rejected, duplicate of (id, outcome)."""
    n = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    return outcomes.agg(F.count(F.lit(1)).alias("fetched"), n("refined"), n("rejected"), n("duplicate"))


def pass_totals(passes: DataFrame) -> DataFrame:
    """Sums over passes (fetched, refined, rejected, duplicate) and their number."""
    return passes.agg(F.count(F.lit(1)).alias("passes"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("fetched", "refined", "rejected", "duplicate")])

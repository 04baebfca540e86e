"""Refining a batch of the inbox: from claimed rows to outcomes, shelf and memory, in a few written steps."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import dedup, lifecycle, location, nearsim, quality
from tidewell.sources import shared


@dataclass(frozen=True)
class Settings:
    as_of: datetime
    rules: quality.Rules = field(default_factory=quality.Rules)
    blocked_hosts: tuple[str, ...] = ()
    lanes: int = nearsim.LANES
    window_days: int = nearsim.WINDOW_DAYS

    @property
    def today(self) -> date:
        return self.as_of.date()


@dataclass
class Refined:
    """outcomes (id, outcome), the rows for the shelf, what they add to the memory, the next shelf and the next memory."""

    outcomes: DataFrame
    jobs: DataFrame
    added: DataFrame
    shelf: DataFrame
    memory: DataFrame
    folder: str

    def release(self) -> None:
        """Removes the tables of the steps, once all results have been consumed."""
        shared.removed(self.outcomes.sparkSession, self.folder)


def refine(batch: DataFrame, shelf: DataFrame, memory: DataFrame, index: DataFrame, fetched: DataFrame, settings: Settings) -> Refined:
    """Every claimed row ends as refined, rejected or duplicate.

    Parse, exact duplicates, near duplicates (against the memory only: alike rows of one batch all
    stay), rules, places, the title gate, descriptions, upsert; rows that reach the shelf are then
    remembered.  Near duplicates are told by the description as it came.
    """
    # What is read more than once is written to the shared folder, which also keeps the plans short.
    folder = shared.new_folder(batch.sparkSession, "refine")
    jobs = shared.staged(dedup.parsed(batch), folder, "jobs")
    same = shared.staged(dedup.duplicates(jobs, shelf), folder, "same")
    rest = jobs.join(same, "id", "left_anti").select("id", F.col("description").alias("text"))
    bands = shared.staged(nearsim.band_hashes(rest, settings.lanes), folder, "bands")
    near = shared.staged(nearsim.near_duplicates(bands, memory, F.lit(settings.as_of), nearsim.required_bands(settings.lanes), settings.window_days), folder, "near")
    judged = quality.classified(jobs, settings.rules, settings.today)
    gone = same.unionByName(near).select("id", F.lit(True).alias("_gone"))
    bad = (F.col("verdict") == "reject") | ~quality.title_passes(F.col("title"))
    marked = judged.join(gone, "id", "left").withColumn("outcome", F.when(F.col("_gone"), "duplicate").when(bad, "rejected").otherwise("refined")).drop("_gone", "verdict")
    marked = shared.staged(marked, folder, "marked")
    placed = location.located(marked.filter("outcome = 'refined'").drop("outcome"), index)
    done = shared.staged(quality.filled_in(placed, fetched, list(settings.blocked_hosts)), folder, "done")
    new = bands.join(done.select("id", "content_hash"), "id").select("content_hash", "band", "band_hash", F.lit(settings.as_of).alias("seen_at"))
    kept = nearsim.forgotten(memory, F.lit(settings.as_of), settings.window_days)
    added = nearsim.unknown_bands(kept, new)
    return Refined(marked.select("id", "outcome"), done, added, lifecycle.shelf_upserted(shelf, done, settings.as_of), kept.unionByName(added), folder)


def finished(inbox: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The inbox with the outcomes as statuses."""
    marks = outcomes.select("id", F.col("outcome").alias("_outcome"))
    return inbox.join(marks, "id", "left").withColumn("status", F.coalesce("_outcome", "status")).select(*inbox.columns)

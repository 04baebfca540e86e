"""Data-quality rules, the title gate, and descriptions that need filling."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as T

SHORT_DESCRIPTION = 200
LEAST_RESOLVED = 300
MOST_RESOLVED = 100
LEAST_TITLE = 2


def _absent(name: str) -> Column:
    return T.strip(F.col(name)) == ""


RULES = {
    "boilerplate_short": lambda: ~_absent("description") & (F.length(T.strip(F.col("description"))) < SHORT_DESCRIPTION),
    "no_title": lambda: _absent("title"),
    "no_description": lambda: _absent("description"),
    "no_url": lambda: _absent("url"),
}


@dataclass(frozen=True)
class Rules:
    """Which rules flag and which reject, and from when on rejection is active."""

    flag: tuple[str, ...] = ("boilerplate_short", "no_description")
    reject: tuple[str, ...] = ("no_title", "no_url")
    activation: date = date(2026, 4, 29)

    @staticmethod
    def activation_date(stored: str | None, today: date, grace_days: int = 7) -> date:
        """The stored date, else today and the days of grace; a stored text that is no date is an error."""
        return date.fromisoformat(stored.strip()) if stored is not None else today + timedelta(days=grace_days)

    def mode(self, today: date) -> str:
        return "flag+reject" if today >= self.activation else "flag-only"


def classified(jobs: DataFrame, rules: Rules, today: date) -> DataFrame:
    """``jobs`` with dq_flags (the rules that fired) and verdict; names that are no rule are ignored."""
    names = [n for n in dict.fromkeys((*rules.flag, *rules.reject)) if n in RULES]
    fired = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("key"), RULES[n]().alias("value")) for n in names]), lambda e: e["value"])) if names else F.create_map().cast("map<string,boolean>")
    rejecting = [RULES[n]() for n in rules.reject if n in RULES] if rules.mode(today) == "flag+reject" else []
    bad = F.lit(False)
    for r in rejecting:
        bad = bad | r
    return jobs.withColumns({"dq_flags": fired, "verdict": F.when(bad, "reject").otherwise("keep")})


def title_passes(title: Column) -> Column:
    """A title of two characters or more with an ASCII letter or digit."""
    t = T.strip(title)
    return (F.length(t) >= LEAST_TITLE) & t.rlike("[A-Za-z0-9]")


def thin(jobs: DataFrame, blocked_hosts: list[str], most: int = MOST_RESOLVED) -> DataFrame:
    """The first rows, by id, whose description is to be fetched from their address."""
    want = (F.col("url") != "") & (F.length(T.blank(F.col("description"))) < SHORT_DESCRIPTION) & ~T.host_blocked(F.col("url"), blocked_hosts) & (T.resolution_provider(F.col("url")) != "")
    return jobs.filter(want).orderBy("id").limit(most)


def filled_in(jobs: DataFrame, fetched: DataFrame, blocked_hosts: list[str]) -> DataFrame:
    """``jobs`` with the fetched texts (url, fetched) that are long enough, longer than what is there, and no page that blocks machines."""
    targets = thin(jobs, blocked_hosts).select("id", "url").join(fetched.dropDuplicates(["url"]), "url").select("id", "fetched")
    good = (F.length("fetched") >= LEAST_RESOLVED) & ~T.looks_blocked(F.col("fetched")) & (F.length("fetched") > F.length(T.blank(F.col("description"))))
    return jobs.join(targets, "id", "left").withColumn("description", F.when(good, F.col("fetched")).otherwise(F.col("description"))).drop("fetched").select(*jobs.columns)


def capped(jobs: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of each source by id; 0 is no cap.  The window keeps only so many rows of a partition before the shuffle."""
    if most <= 0:
        return jobs
    return jobs.withColumn("_no", F.row_number().over(Window.partitionBy("source").orderBy("id"))).filter(F.col("_no") <= most).drop("_no")

"""The one query over the shelf: filters, ranking, pages, distances."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions import values as V
from tidewell.operators import textindex
from tidewell.operators.keywords import Asked, parsed_terms

DEFAULT_LIMIT, MOST_LIMIT = 50, 500
SHOWN_DESCRIPTION = 500
# The weight of a word of a title, and the limit of the sum of 1 / n^2 that PostgreSQL's ts_rank divides by.
WORD_WEIGHT, SQUARES = 0.1, 1.64493406685

# What a level of seniority looks for in a title.
SENIORITY = {
    "senior": ["senior", "sr.", "lead", "principal", "staff"],
    "junior": ["junior", "jr.", "entry", "trainee", "werkstudent"],
    "lead": ["lead", "principal", "staff", "head of"],
    "mid": ["mid", "medior", "intermediate"],
}


@dataclass(frozen=True)
class Search:
    """What is asked for; ``as_of`` is the present.  ``legacy`` takes the null rules of the unranked path."""

    as_of: datetime
    keywords: list[str] = field(default_factory=list)
    without: list[str] = field(default_factory=list)
    location: str | None = None
    max_age_days: int | None = None
    exclude_domains: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    domains: list[str] = field(default_factory=list)
    seniority: str | None = None
    min_salary: int | None = None
    max_salary: int | None = None
    max_distance_km: float | None = None
    limit: int = DEFAULT_LIMIT
    offset: int = 0
    legacy: bool = False

    def __post_init__(self):
        if not 1 <= self.limit <= MOST_LIMIT or self.offset < 0:
            raise ValueError(f"limit must be 1 to {MOST_LIMIT} and offset 0 or more")
        if self.max_distance_km is not None and not self.location:
            raise ValueError("a distance needs a location")


@dataclass(frozen=True)
class Index:
    """Folders that textindex.write() has made of the shelf: of words, of grams for substrings, or both.  What has none is looked for in the texts."""

    words: str | None = None
    grams: str | None = None


def matches(text: Column, asked: Asked) -> Column:
    """Whether a text has what is asked for; null has nothing.  Words are found in the text as it is: nothing is split for a query."""
    low = F.lower(T.blank(text))
    in_a_row = lambda words: r"[^\p{L}\p{N}]+".join(map(re.escape, words))
    held = lambda *runs: low.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(map(in_a_row, runs))})(?![\p{{L}}\p{{N}}])")
    # Runs of which any is enough need one search for all of them.
    alone = [p.words for p in asked.parts if p.kind == "run"] if asked.kind == "any" else []
    if len(alone) > 1:
        hit = held(*alone)
        for p in asked.parts:
            hit = hit if p.kind == "run" else hit | p.holds(held)
    else:
        hit = asked.holds(held)
    return text.isNotNull() & hit


def places_in(words: Column) -> Callable[[str], Column]:
    """Where each word stands in an array of words."""
    return lambda w: F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())


def rank(places: Callable[[str], Column], asked: Asked) -> Column:
    """PostgreSQL's ts_rank of a text by the places of its words, 0 to 1.

    Of what any is enough for, the mean over the asked words of a sum that falls with the square of the
    occurrence.  Of several words that are all asked for, 1 less the product over
    pairs of their places of what the pair's distance leaves.
    """
    words = asked.every_word()
    if len(words) == 1 or not (asked.kind == "all" or asked.kind == "run"):
        falling = lambda n: F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + WORD_WEIGHT / (i * i))
        return sum((falling(F.size(places(w))) / SQUARES for w in words), F.lit(0.0)) / len(words)
    nearness = lambda d: WORD_WEIGHT * F.sqrt(F.when(d <= 100, 1 / (1.005 + 0.05 * F.exp(d / 1.5 - 2))).otherwise(1e-30))
    distances = lambda a, b: F.flatten(F.transform(places(a), lambda i: F.transform(places(b), lambda j: F.abs(i - j))))
    left = F.lit(1.0)
    for no, one in enumerate(words):
        for other in words[no + 1 :]:
            left = left * F.aggregate(distances(one, other), F.lit(1.0), lambda s, d: s * (1 - nearness(d)))
    return 1 - left


def matched(shelf_index: Index, asked: Asked, spark: SparkSession) -> DataFrame:
    """id, r of the texts that have what is asked for, by the lists of its words alone: r as in hits()."""
    # What a text without any of the words satisfies is looked for among all texts.
    terms = asked.every_word() + ([textindex.EVERY] if asked.holds_of_none() else [])
    lists = textindex.lookup(spark, shelf_index.words, terms)
    texts = lists.groupBy("id", "field").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at"))
    places = lambda w: F.coalesce(F.col("at")[w], F.array().cast("array<int>"))

    def run(words: tuple[str, ...]) -> Column:
        if len(words) == 1:
            return F.map_contains_key("at", words[0])
        follow = lambda p: reduce(lambda a, b: a & b, [F.array_contains(places(w), p + i) for i, w in enumerate(words) if i])
        return F.exists(places(words[0]), follow)

    hit = texts.filter(asked.holds(run)).withColumn("r", F.when(F.col("field") == "title", rank(places, asked)).otherwise(0.0))
    return hit.groupBy("id").agg(F.max("r").alias("r"))


def _holds(col: Column, part: str) -> Column:
    return F.ilike(col, F.lit(f"%{part}%"))


def filtered(shelf: DataFrame, spec: Search, index: Index | None = None) -> DataFrame:
    """All filters but the keywords.  Those on plain columns reach the scan; an index of grams finds what texts hold."""
    rows = shelf
    if spec.max_age_days is not None:
        rows = rows.filter(F.col("scraped_at") >= F.lit(spec.as_of - timedelta(days=spec.max_age_days)))
    if spec.sources:
        rows = rows.filter(F.col("source").isin(spec.sources))
    if spec.domains:
        rows = rows.filter(F.col("company_domain").isin(spec.domains))
    if spec.min_salary is not None:
        rows = rows.filter(F.col("salary_min") >= spec.min_salary)
    if spec.max_salary is not None:
        rows = rows.filter(F.col("salary_max") <= spec.max_salary)
    if spec.location:
        rows = rows.filter(_holds(F.col("location"), spec.location))
    by_grams = index is not None and index.grams is not None
    held = lambda patterns, *fields: textindex.containing(shelf, index.grams, patterns, fields)
    if spec.seniority:
        levels = SENIORITY.get(spec.seniority.lower(), [spec.seniority])
        if by_grams:
            rows = rows.join(held(levels, "title"), "id", "left_semi")
        else:
            rows = rows.filter(reduce(lambda a, b: a | b, [_holds(F.col("title"), t) for t in levels]))
    if spec.exclude_domains:
        out = F.col("company_domain").isin(spec.exclude_domains)
        rows = rows.filter(~out if spec.legacy else ~F.coalesce(out, F.lit(False)))
    listed = by_grams and not spec.legacy
    if listed and spec.without:
        rows = rows.join(held(spec.without, "title", "description"), "id", "left_anti")
    for n in [] if listed else spec.without:
        hit = _holds(F.col("title"), n) | _holds(F.col("description"), n)
        rows = rows.filter(~hit if spec.legacy else ~F.coalesce(hit, F.lit(False)))
    if spec.max_distance_km is not None and (centre := V.geocode(spec.location)):
        near = V.haversine_km(F.lit(centre[0]), F.lit(centre[1]), F.col("location_lat"), F.col("location_lon")) <= spec.max_distance_km
        rows = rows.filter(V.bounding_box(F.col("location_lat"), F.col("location_lon"), centre, spec.max_distance_km)).filter(near)
    return rows


def hits(shelf: DataFrame, spec: Search, index: Index | None = None) -> DataFrame:
    """The filtered rows that match, with r: the rank where the title matches, 0 where only the description does; without keywords all rows, r 0.

    With an index of words no text is read; without one every text is searched.
    """
    rows = filtered(shelf, spec, index)
    if not spec.keywords:
        return rows.withColumn("r", F.lit(0.0))
    asked = parsed_terms(spec.keywords)
    if not asked:
        return rows.withColumn("r", F.lit(0.0)).filter(F.lit(False))
    if index is not None and index.words is not None:
        return rows.join(matched(index, asked, shelf.sparkSession), "id")
    in_title = matches(F.col("title"), asked)
    rows = rows.filter(in_title | matches(F.col("description"), asked))
    return rows.withColumn("r", F.when(in_title, rank(places_in(T.words(F.col("title"))), asked)).otherwise(0.0))


def total(shelf: DataFrame, spec: Search, index: Index | None = None) -> DataFrame:
    """total: of all rows that match, whatever the page."""
    return hits(shelf, spec, index).agg(F.count(F.lit(1)).alias("total"))


def page(shelf: DataFrame, spec: Search, index: Index | None = None) -> DataFrame:
    """The page's whole rows with r, by r, then the newest, then id.

    The order is settled on narrow rows, of which each task keeps limit + offset; at most MOST_LIMIT
    ids then fetch their rows.
    """
    best = hits(shelf, spec, index).select("id", "r", "scraped_at").orderBy(F.desc("r"), F.desc("scraped_at"), "id").offset(spec.offset).limit(spec.limit)
    return shelf.join(F.broadcast(best.select("id", "r")), "id").orderBy(F.desc("r"), F.desc("scraped_at"), "id")


def shown(rows: DataFrame, whole: bool = False) -> DataFrame:
    """Rows as a list shows them, the description cut; ``whole`` for one posting's details."""
    text = T.blank(F.col("description"))
    cut = text if whole else F.when(F.length(text) > SHOWN_DESCRIPTION, F.concat(F.left(text, F.lit(SHOWN_DESCRIPTION)), F.lit("..."))).otherwise(text)
    return rows.select(
        "id", T.blank(F.col("title")).alias("title"), T.blank(F.col("company")).alias("company"), T.blank(F.col("location")).alias("location"), F.coalesce("is_remote", F.lit(False)).alias("remote"),
        cut.alias("description"), T.blank(F.col("url")).alias("url"), T.blank(F.col("source")).alias("source"), F.coalesce("posted_at", "scraped_at").alias("posted_at"),
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
    )


def page_json(shelf: DataFrame, spec: Search, index: Index | None = None) -> DataFrame:
    """result, total_count: each row of the page as JSON, with the number of all hits; a page past the end has no rows."""
    rows = page(shelf, spec, index)
    return rows.select(F.to_json(F.struct(*[c for c in rows.columns if c != "r"])).alias("result")).crossJoin(total(shelf, spec, index).withColumnRenamed("total", "total_count"))  # one row


def by_id(shelf: DataFrame, job_id: int) -> DataFrame:
    return shelf.filter(F.col("id") == job_id)


def keywords_of(text: Column) -> Column:
    """A comma-separated text as its parts."""
    return F.filter(F.transform(F.split(T.blank(text), ","), T.strip), lambda x: x != "")

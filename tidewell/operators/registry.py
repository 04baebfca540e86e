"""The registry of company boards: enumeration, classification, an upsert that never deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as T

# Where a provider's boards are found in addresses (host suffix of a subdomain, or hosts whose path starts with the slug).
PROVIDERS = {
    "personio": {"suffix": ".jobs.personio.de"}, "recruitee": {"suffix": ".recruitee.com"}, "breezy": {"suffix": ".breezy.hr"},
    "factorial": {"suffix": ".factorialhr.com"}, "softgarden": {"suffix": ".career.softgarden.de"},
    "greenhouse": {"reserved": ["embed", "api"]}, "lever": {"reserved": []}, "ashby": {"reserved": ["api", "embed"]},
}
BAD_IN_SLUG = r"""[. /?#&=%@:"'\\]"""
FOLLOWED = ("de", "remote")


def clean_slug(raw: Column, reserved: list[str]) -> Column:
    s = F.regexp_replace(F.trim(F.lower(raw)), "^-+|-+$", "")
    return F.when((s != "") & ~s.isin(reserved) & ~s.rlike(BAD_IN_SLUG), s)


def slug_of_url(url: Column, provider: str) -> Column:
    """The board's name in an address of this provider, null if there is none."""
    rule, host = PROVIDERS[provider], F.regexp_replace(T.url_host(url), r"\.+$", "")
    if "suffix" in rule:
        label = F.regexp_extract(host, r"([^.]+)" + rule["suffix"].replace(".", r"\.") + "$", 1)
        return clean_slug(T.filled(label), [])
    first = T.filled(F.regexp_extract(T.blank(F.try_parse_url(url, F.lit("PATH"))), "^/*([^/]+)", 1))
    query = lambda key: F.try_parse_url(url, F.lit("QUERY"), F.lit(key))
    embedded = clean_slug(F.coalesce(query("for"), query("token")), [])
    return F.when((first == "embed") & F.lit("embed" in rule["reserved"]), embedded).otherwise(clean_slug(first, rule["reserved"]))


def lever_slug(url: Column) -> Column:
    """The first part of the path after lever.co/, with its dots."""
    return T.filled(F.lower(F.regexp_extract(T.blank(url), r"lever\.co/([^/?#]+)", 1)))


def harvested(urls: DataFrame) -> DataFrame:
    """slug: the distinct lever boards of addresses (url)."""
    return urls.select(lever_slug(F.col("url")).alias("slug")).filter("slug IS NOT NULL").distinct()


def slugs_by_source(registry: DataFrame) -> DataFrame:
    """source, slugs, n: the boards of each provider in order, and their number; a provider has some thousands."""
    return registry.filter(T.blank(F.col("slug")) != "").groupBy("source").agg(F.array_sort(F.collect_set("slug")).alias("slugs")).withColumn("n", F.size("slugs").cast("long"))


def enumerated(urls: DataFrame, provider: str, most_pages: int | None = None) -> DataFrame:
    """slug, crawls (sorted) of rows (url, crawl).

    With ``most_pages``, of rows (url, crawl, page): what the first pages of each crawl tell, and truncated, whether any crawl has more.
    """
    if most_pages is not None:
        more = urls.agg(F.coalesce(F.max("page") >= most_pages, F.lit(False)).alias("truncated"))
        return enumerated(urls.filter(F.col("page") < most_pages), provider).crossJoin(F.broadcast(more))  # one row
    named = urls.select(slug_of_url(F.col("url"), provider).alias("slug"), "crawl").filter("slug IS NOT NULL")
    return named.groupBy("slug").agg(F.array_sort(F.collect_set("crawl")).alias("crawls"))


def ordered_union(*parts: DataFrame) -> DataFrame:
    """key, place: of several (key, pos) the distinct keys in the order of their first appearance, the first part's first."""
    rows = None
    for no, part in enumerate(parts):
        one = part.groupBy("key").agg(F.min("pos").alias("pos")).select("key", F.lit(no).alias("part"), "pos")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("key").agg(F.min(F.struct("part", "pos")).alias("place"))


def active_boards(registry: DataFrame) -> DataFrame:
    return registry.filter((F.col("status") == "active") & F.col("monitor") & F.col("de_flag").isin(*FOLLOWED))


def board_list(listed: DataFrame, registry: DataFrame) -> DataFrame:
    """source, slug, place: of each provider the listed boards (source, slug, pos) in their order, then the registry's active ones that aren't listed, by slug."""
    first = listed.groupBy("source", "slug").agg(F.min("pos").cast("long").alias("pos")).select("source", "slug", F.struct(F.lit(0).alias("part"), "pos", F.lit("").alias("name")).alias("place"))
    more = active_boards(registry).select("source", "slug", F.struct(F.lit(1).alias("part"), F.lit(0).cast("long").alias("pos"), F.col("slug").alias("name")).alias("place"))
    return first.unionByName(more).groupBy("source", "slug").agg(F.min("place").alias("place"))


def search_terms(local: DataFrame, remote: DataFrame | None = None, source_id: str | None = None) -> DataFrame:
    """key, place: the distinct terms of (source_id, term, pos), of one source or of all, local ones first; without the remote provider, or where it has none, the local ones alone."""
    of = lambda df: df.filter(F.lit(source_id is None) | (F.col("source_id") == F.lit(source_id))).select(F.col("term").alias("key"), "pos").filter("key <> ''")
    return ordered_union(*[of(df) for df in (local, remote) if df is not None])


def folded(category: Column) -> Column:
    """An aggregate: 'de' if any is, else 'remote' if any is, else 'foreign'; null of nothing."""
    has = lambda x: F.coalesce(F.bool_or(category == x), F.lit(False))
    return F.when(F.count(category) == 0, F.lit(None)).when(has("de"), "de").when(has("remote"), "remote").otherwise("foreign")


def board_flags(jobs: DataFrame) -> DataFrame:
    """source, slug, de_flag, jobs of rows (source, slug, country, place, remote): by the country's code where a provider has one, else by the place's text."""
    code = F.upper(T.blank(F.col("country")))
    by_code = F.when(code == "DE", "de").when(code != "", "foreign").when(F.col("remote"), "remote").otherwise("foreign")
    by_text = T.location_category(F.concat(T.blank(F.col("place")), F.when(F.col("remote"), " remote").otherwise("")))
    category = F.when(F.col("source").isin("recruitee", "breezy"), by_code).otherwise(by_text)
    return jobs.groupBy("source", "slug").agg(folded(category).alias("de_flag"), F.count(F.lit(1)).alias("jobs"))


def flag_counts(registry: DataFrame) -> DataFrame:
    """source, active, de, remote, foreign, unknown, keep over active boards."""
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    flag = F.col("de_flag")
    return registry.filter(F.col("status") == "active").groupBy("source").agg(
        F.count(F.lit(1)).alias("active"), *[n(flag == x).alias(x) for x in ("de", "remote", "foreign")], n(flag.isNull()).alias("unknown"), n(flag.isin(*FOLLOWED)).alias("keep")
    )


def status_of(active: Column, error: Column) -> Column:
    return F.when(active, "active").when(T.blank(error) != "", "dead").otherwise("paused")


def registered(registry: DataFrame, validated: DataFrame, found: DataFrame) -> DataFrame:
    """The registry with validations (source, slug, active, error, job_count, de_flag, sample_titles, crawls)
    and merely found boards (source, slug, crawls).

    A validation rewrites a board's state but not its first job count; a found board is added only if
    it is unknown.  Nothing is deleted.
    """
    keys = ["source", "slug"]
    status = status_of(F.col("active"), F.col("error"))
    fresh = validated.select(
        *keys, F.lit("cc").alias("origin"), F.col("crawls").alias("seen_in_crawls"), status.alias("status"), ((status != "dead") & F.coalesce(F.col("de_flag").isin(*FOLLOWED), F.lit(False))).alias("monitor"),
        F.col("job_count").alias("initial_job_count"), F.col("job_count").alias("last_job_count"), "de_flag", F.slice("sample_titles", 1, 3).alias("sample_titles"),
    )
    old = registry.select(*keys, F.col("initial_job_count").alias("_first"), F.col("origin").alias("_origin"), F.col("seen_in_crawls").alias("_seen"))
    merged = fresh.join(old, keys, "left").withColumns({
        "initial_job_count": F.coalesce("_first", "initial_job_count"), "origin": F.coalesce("_origin", "origin"),
        "seen_in_crawls": F.array_sort(F.array_union(F.coalesce("_seen", F.array().cast("array<string>")), F.coalesce("seen_in_crawls", F.array().cast("array<string>")))),
    }).select(*registry.columns)
    untouched = registry.join(fresh.select(*keys), keys, "left_anti").select(*registry.columns)
    new = found.join(registry.select(*keys).unionByName(fresh.select(*keys)), keys, "left_anti").select(
        *keys, F.lit("cc").alias("origin"), F.array_sort("crawls").alias("seen_in_crawls"), F.lit("paused").alias("status"), F.lit(False).alias("monitor"), F.lit(None).cast("int").alias("initial_job_count"),
        F.lit(None).cast("int").alias("last_job_count"), F.lit(None).cast("string").alias("de_flag"), F.array().cast("array<string>").alias("sample_titles"),
    )
    return untouched.unionByName(merged).unionByName(new.select(*registry.columns))


def unclassified(registry: DataFrame) -> DataFrame:
    """source, slug of boards without a flag, in order."""
    return registry.filter(F.col("de_flag").isNull()).select("source", "slug").orderBy("source", "slug")


def source_types(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with type and is_aggregator by source code; unknown codes are 'unknown'."""
    kinds = sources.select(F.col("code").alias("_code"), F.col("type").alias("_type"))
    joined = rows.join(kinds, F.col("source") == F.col("_code"), "left")
    return joined.withColumn("type", F.coalesce("_type", F.lit("unknown"))).withColumn("is_aggregator", F.col("type") == "aggregator").drop("_code", "_type")


def missing_keys(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    return before.select(*keys).distinct().join(after.select(*keys), keys, "left_anti")


def field_differences(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, field, before, after of common keys whose fields differ; of all of them, not of a sample."""
    a = before.select(*keys, *[F.col(f).alias(f"_a_{f}") for f in fields])
    b = after.select(*keys, *[F.col(f).alias(f"_b_{f}") for f in fields])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_a_{f}").cast("string").alias("before"), F.col(f"_b_{f}").cast("string").alias("after")) for f in fields])
    return a.join(b, keys).select(*keys, F.explode(F.filter(each, lambda e: ~e["before"].eqNullSafe(e["after"]))).alias("e")).select(*keys, "e.field", "e.before", "e.after")


def company_view(companies: DataFrame, signals: DataFrame) -> DataFrame:
    """Companies by domain with their strongest signal, or nulls."""
    w = Window.partitionBy("domain").orderBy(F.desc("transformation_signal_score"), "signal_type")
    first = signals.withColumn("_no", F.row_number().over(w)).filter("_no = 1").drop("_no")
    return companies.join(first, "domain", "left")

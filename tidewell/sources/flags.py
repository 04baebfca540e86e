"""Which boards hire in Germany, out of their feeds: a flag from the places of a feed's jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import registry

_ISO = "struct<id:string>"
_BREEZY = f"struct<country:{_ISO},is_remote:boolean>"
#: How a provider's feed is read: the schema of its jobs, and the field that holds them.
SHAPES = {
    "greenhouse": ("array<struct<location:struct<name:string>>>", "jobs"), "ashby": ("array<struct<location:string,secondaryLocations:string,address:string,isRemote:boolean,workplaceType:string>>", "jobs"),
    "recruitee": ("array<struct<country_code:string,remote:boolean>>", "offers"), "breezy": (f"array<struct<location:{_BREEZY},locations:array<{_BREEZY}>>>", None),
    "lever": ("array<struct<categories:struct<location:string>>>", None), "softgarden": ("array<struct<item:struct<jobLocation:struct<address:struct<addressCountry:string,addressLocality:string,addressRegion:string>>>>>", "dataFeedElement"),
}


def _by_code(code: Column, remote: Column) -> Column:
    iso = F.upper(T.blank(code))
    return F.when(iso == "DE", "de").when(iso != "", "foreign").when(F.coalesce(remote, F.lit(False)), "remote").otherwise("foreign")


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *[T.blank(p) for p in parts])


def _categories(provider: str, j: Column) -> Column:
    """The categories of one job: an array, as a job may be in several places."""
    text = lambda *parts: F.array(T.location_category(_joined(*parts)))
    if provider == "greenhouse":
        return text(j["location"]["name"])
    if provider == "ashby":
        remote = F.coalesce(j["isRemote"], F.lit(False)) | F.coalesce(j["workplaceType"] == "Remote", F.lit(False))
        return text(j["location"], F.coalesce(j["secondaryLocations"], F.lit("[]")), F.coalesce(j["address"], F.lit("{}")), F.when(remote, "remote"))
    if provider == "recruitee":
        return F.array(_by_code(j["country_code"], j["remote"]))
    if provider == "breezy":
        places = F.concat(F.array(j["location"]), F.coalesce(j["locations"], F.array().cast(f"array<{_BREEZY}>")))
        return F.transform(places, lambda p: _by_code(p["country"]["id"], p["is_remote"]))
    if provider == "lever":
        return text(j["categories"]["location"])
    address = j["item"]["jobLocation"]["address"]
    return text(address["addressCountry"], address["addressLocality"], address["addressRegion"])


def feed_flags(feeds: DataFrame, provider: str) -> DataFrame:
    """slug, de_flag of a provider's feeds (slug, body); null for a feed that doesn't parse or has no jobs, and for providers without places."""
    if provider == "personio":
        each = F.transform(F.from_xml("body", "position array<struct<office:string>>")["position"], lambda p: T.location_category(T.blank(p["office"])))
    elif provider in SHAPES:
        schema, field = SHAPES[provider]
        jobs = F.from_json("body", schema if field is None else f"struct<{field}:{schema}>")
        each = F.flatten(F.transform(jobs if field is None else jobs[field], lambda j: _categories(provider, j)))
    else:
        each = F.lit(None).cast("array<string>")
    # An object passes for a list of one.
    listed = F.ltrim("body").startswith("[") if SHAPES.get(provider, ("", ""))[1] is None else F.lit(True)
    rows = feeds.select("slug", F.when(listed, each).alias("each"))
    return rows.select("slug", F.when(F.array_contains("each", "de"), "de").when(F.array_contains("each", "remote"), "remote").when(F.size("each") > 0, "foreign").alias("de_flag"))


def recovered_flags(sitemaps: DataFrame, sampled: DataFrame, samples: int = 3) -> DataFrame:
    """slug, de_flag of boards from the addresses of all jobs in their sitemaps (slug, body) and from the pages (url, html) of the first ``samples`` of each."""
    found = F.filter(F.regexp_extract_all("body", F.lit(r"<loc>\s*([^<]+?)\s*</loc>"), F.lit(1)), lambda u: F.contains(u, F.lit("/job_posting/")))
    jobs = sitemaps.select("slug", F.posexplode(found).alias("at", "url"))
    by_url = jobs.select("slug", T.location_category(T.url_place(F.col("url"))).alias("category"))
    pinned = T.filled(T.pinned_location(F.col("html")))
    by_page = jobs.filter(F.col("at") < samples).join(sampled, "url").select("slug", T.location_category(pinned).alias("category")).filter(pinned.isNotNull())
    return by_url.unionByName(by_page).groupBy("slug").agg(registry.folded(F.col("category")).alias("de_flag"))

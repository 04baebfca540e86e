"""Registered queries of the source adapters: payloads made of the inbox's rows, and the rows that must come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.plans.catalog import _payloads, _t, query
from tidewell.sources import boards, flags

_SLUG = "'board' || (id // 100)"
_PLACE = "CASE WHEN location = '' THEN '{0}' ELSE location{1} END"


def _rows(source: str, title="title", url="url", company=_SLUG, location="location", description="description", salary="''", external_id="CAST(id AS VARCHAR)", posted="CAST(NULL AS TIMESTAMP)", where="true") -> str:
    return f"SELECT {title} AS title, {url} AS url, {company} AS company, {location} AS location, {description} AS description, {salary} AS salary, '{source}' AS source, {external_id} AS external_id, {posted} AS posted_at FROM raw WHERE {where}"


@query(_rows("ashby"), "raw")
def src_ashby(spark, sf_dir):
    return boards.postings("ashby", _payloads(spark, sf_dir, "named_struct('id', id, 'title', title, 'jobUrl', url, 'location', location, 'descriptionPlain', description)", "jobs"))


@query(_rows("breezy", company=f"CASE WHEN company = '' THEN {_SLUG} ELSE company END", location=_PLACE.format("Germany", " || ', Germany'"), description="''"), "raw")
def src_breezy(spark, sf_dir):
    item = "named_struct('id', id, 'name', title, 'url', url, 'company', named_struct('name', company), 'location', named_struct('city', location, 'state', named_struct('name', ''), 'country', named_struct('name', 'Germany')))"
    return boards.postings("breezy", _payloads(spark, sf_dir, item, None))


def _xml_payloads(spark, sf_dir, item: str, head: str, tail: str, board: str = "board"):
    """Like _payloads, of XML items."""
    rows = _t(spark, sf_dir, "raw").withColumn("slug", F.concat(F.lit(board), F.floor(F.col("id") / 100)))
    bodies = rows.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("id", F.expr(item).alias("x")))).alias("xs"))
    return bodies.select("slug", F.concat(F.lit(head), F.array_join("xs.x", ""), F.lit(tail)).alias("body"))


#: A text of the table that can stand in markup as it is, without the white space that XML loses at its ends.
_NO_MARKUP = "trim(BOTH chr(32) || chr(9) || chr(10) || chr(13) FROM translate({0}, '<>&', '()+'))"


@query(
    _rows("personio", title=_NO_MARKUP.format("title"), url=f"'https://' || {_SLUG} || '.jobs.personio.de/job/' || id", description=f"CASE WHEN {_NO_MARKUP.format('description')} = '' THEN 'Tasks' ELSE 'Tasks' || chr(10) || chr(10) || {_NO_MARKUP.format('description')} END"), "raw",
)
def src_personio(spark, sf_dir):
    item = f"concat('<position><id>', id, '</id><name>', {_NO_MARKUP.format('title')}, '</name><office>', location, '</office><jobDescriptions><jobDescription><name>Tasks</name><value>', {_NO_MARKUP.format('description')}, '</value></jobDescription></jobDescriptions></position>')"
    return boards.postings("personio", _xml_payloads(spark, sf_dir, item, "<workzag-jobs>", "</workzag-jobs>"))


@query(_rows("softgarden", company="CASE WHEN company = '' THEN 'Org' ELSE company END", location=_PLACE.format("DE", ""), posted="TIMESTAMP '2024-01-05 00:00:00'"), "raw")
def src_softgarden(spark, sf_dir):
    item = "named_struct('item', named_struct('@type', 'JobPosting', 'title', title, 'url', url, 'datePosted', '2024-01-05', 'description', description, 'identifier', named_struct('name', company, 'value', cast(id AS string)), 'hiringOrganization', named_struct('name', 'Org'), 'jobLocation', named_struct('address', named_struct('addressLocality', location, 'addressCountry', 'DE'))))"
    return boards.postings("softgarden", _payloads(spark, sf_dir, item, "dataFeedElement"))


#: The letters of a title's first words, as a sitemap's address has them.
_SLUGGED = "left(regexp_replace(lower(title), '[^a-z]+', '-', 'g'), 40)"


@query(_rows("factorial", title="trim(array_to_string(list_transform(string_split(trim(replace(s, '-', ' ')), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' '))", url="'https://f.example/job_posting/' || s || '-' || id", location="''", description="''", posted="TIMESTAMP '2024-01-05 00:00:00'").replace("FROM raw", f"FROM (SELECT *, {_SLUGGED} AS s FROM raw) t"), "raw")
def src_factorial(spark, sf_dir):
    slug = _SLUGGED.replace(", 'g')", ")")
    item = f"concat('<url><loc> https://f.example/job_posting/', {slug}, '-', id, ' </loc><lastmod>2024-01-05T00:00:00Z</lastmod></url>')"
    return boards.postings("factorial", _xml_payloads(spark, sf_dir, item, "<urlset>", "</urlset>"))


@query(_rows("bite", url="'https://b.example/jobposting/' || id", company="CASE WHEN company = '' THEN 'site' ELSE company END", location=_PLACE.format("Germany", ""), external_id="CASE WHEN id % 2 = 0 THEN CAST(id AS VARCHAR) ELSE 'https://b.example/jobposting/' || id || '?x=1' END", posted="TIMESTAMP '2024-01-05 00:00:00'"), "raw")
def src_bite(spark, sf_dir):
    posting = "to_json(named_struct('@type', 'JobPosting', 'title', title, 'datePosted', '2024-01-05', 'description', replace(description, '<', '('), 'identifier', if(id % 2 = 0, named_struct('value', cast(id AS string)), NULL), 'hiringOrganization', named_struct('name', company), 'jobLocation', named_struct('address', named_struct('addressLocality', location, 'addressCountry', 'Germany'))))"
    rows = _t(spark, sf_dir, "raw").select(F.lit("site").alias("slug"), F.expr("concat('https://b.example/jobposting/', id, '?x=1')").alias("url"), F.expr(f"concat('<html><script type=\"application/ld+json\">', {posting}, '</script>')").alias("body"))
    return boards.postings("bite", rows)


_LABEL = "regexp_matches(trim(company), '(?i)^bewerbung\\s+als\\b')"
_BARE = "regexp_replace(trim(title), '(?i)^\\s*bewerbung\\s+als\\b[:\\s]*', '')"
_OWN = f"CASE WHEN {_LABEL} THEN '' ELSE trim(company) END"
_ECHO = f"CASE WHEN {_OWN} <> '' THEN regexp_replace({_BARE}, '(?i)\\s*[-–—|:]\\s*' || regexp_escape({_OWN}) || '\\s*$', '') ELSE {_BARE} END"


@query(_rows("adzuna", title=f"trim({_ECHO})", company=_OWN, salary="'50000'"), "raw")
def src_adzuna(spark, sf_dir):
    item = "named_struct('id', id, 'title', title, 'redirect_url', url, 'company', named_struct('display_name', company), 'location', named_struct('display_name', location), 'description', description, 'salary_min', 50000)"
    return boards.postings("adzuna", _payloads(spark, sf_dir, item, "results"))


@query(_rows("jooble", company="company", salary="'1 EUR'", posted="TIMESTAMP '2024-01-05 10:00:00'") + " QUALIFY row_number() OVER (PARTITION BY id // 100 ORDER BY id) <= 50", "raw")
def src_jooble(spark, sf_dir):
    item = "named_struct('id', id, 'title', title, 'link', url, 'company', company, 'location', location, 'snippet', description, 'salary', '1 EUR', 'updated', '2024-01-05T10:00:00.0000000')"
    return boards.postings("jooble", _payloads(spark, sf_dir, item, "jobs"))


@query(_rows("careerjet", company="company", salary="'2 EUR'", external_id="url"), "raw")
def src_careerjet(spark, sf_dir):
    item = "named_struct('id', id, 'title', title, 'url', url, 'company', company, 'locations', location, 'description', description, 'salary', '2 EUR')"
    return boards.postings("careerjet", _payloads(spark, sf_dir, item, "jobs"))


@query(_rows("themuse", company="company", posted="TIMESTAMP '2024-01-05 00:00:00'") + " ORDER BY id LIMIT 100", "raw")
def src_themuse(spark, sf_dir):
    item = "named_struct('id', id, 'name', title, 'refs', named_struct('landing_page', url), 'company', named_struct('name', company), 'locations', array(named_struct('name', location), named_struct('name', 'second')), 'contents', description, 'publication_date', '2024-01-05T00:00:00Z')"
    return boards.postings("themuse", _payloads(spark, sf_dir, item, "results", ""))


@query(_rows("linkedin", company="company", salary="'3 EUR'", external_id="CASE WHEN id % 2 = 0 THEN CAST(id AS VARCHAR) ELSE url END", where="title <> ''"), "raw")
def src_linkedin(spark, sf_dir):
    item = "named_struct('at', cast(id + 1000000000000 AS string), if(id % 3 = 0, 'jobTitle', 'title'), title, if(id % 2 = 0, 'jobUrl', 'link'), url, 'companyName', company, 'location', location, 'description', description, 'salary', '3 EUR', 'jobId', if(id % 2 = 0, cast(id AS string), ''))"
    item = "map('title', if(id % 3 = 0, '', title), 'jobTitle', title, 'link', url, 'companyName', company, 'location', location, 'description', description, 'salary', '3 EUR', 'jobId', if(id % 2 = 0, cast(id AS string), ''))"
    rows = _t(spark, sf_dir, "raw").withColumn("slug", F.floor(F.col("id") / 100).cast("string"))
    return boards.postings("linkedin", rows.groupBy("slug").agg(F.to_json(F.collect_list(F.expr(item))).alias("body")))


@query(_rows("indeed", company="CASE WHEN company = '' THEN 'None' ELSE company END", salary="'None'"), "raw")
def src_indeed(spark, sf_dir):
    rows = _t(spark, sf_dir, "raw").selectExpr("title", "url AS job_url", "nullif(company, '') AS company", "location", "description", "cast(NULL AS double) AS compensation", "id")
    return boards.postings("indeed", rows)


@query(_rows("arbeitsagentur", company="company", location="CASE WHEN location = '' THEN '10115' ELSE '10115 ' || location END", description="CASE WHEN id < 300 THEN 'text of ' || id ELSE '' END", external_id="'ba_' || id", posted="TIMESTAMP '2024-01-05 00:00:00'"), "raw")
def src_arbeitsagentur(spark, sf_dir):
    item = "named_struct('id', id, 'titel', title, 'refnr', cast(id AS string), 'arbeitgeber', company, 'arbeitsort', named_struct('plz', '10115', 'ort', location, 'region', ''), 'externeUrl', url, 'aktuelleVeroeffentlichungsdatum', '2024-01-05')"
    details = _t(spark, sf_dir, "raw").selectExpr("base64(encode(cast(id AS string), 'UTF-8')) AS token", "concat('text of ', id) AS text")
    return boards.arbeitsagentur(_payloads(spark, sf_dir, item, "stellenangebote", ""), details)


@query(_rows("rss", title=_NO_MARKUP.format("title"), company="'board' || (id // 100)", location="''", description=_NO_MARKUP.format("description"), external_id="CASE WHEN id % 2 = 0 THEN 'g' || id ELSE url END", posted="TIMESTAMP '2024-01-05 10:00:00'"), "raw")
def src_rss(spark, sf_dir):
    item = f"concat('<item><title>', {_NO_MARKUP.format('title')}, '</title><link>', url, '</link><description>', {_NO_MARKUP.format('description')}, '</description>', if(id % 2 = 0, concat('<guid>g', id, '</guid>'), ''), '<pubDate>Fri, 05 Jan 2024 10:00:00 +0000</pubDate></item>')"
    return boards.postings("rss", _xml_payloads(spark, sf_dir, item, "<rss><channel><title>f</title>", "</channel></rss>"))


_CATEGORY = """CASE WHEN regexp_matches({0}, '(?i)(^|[^a-zäöü])(germany|berlin|münchen|hamburg|köln|frankfurt)([^a-zäöü]|$)') THEN 'de' WHEN regexp_matches({0}, '(?i)remote') AND NOT regexp_matches({0}, '(?i)london, uk|,\\s*[a-z]{{2}}([^a-z]|$)') THEN 'remote' ELSE 'foreign' END"""
_CODE = "CASE WHEN id % 6 = 0 THEN 'de' WHEN id % 6 = 1 THEN 'foreign' WHEN id % 9 = 2 THEN 'remote' ELSE 'foreign' END"
_FOLD = "SELECT slug, CASE WHEN bool_or(c = 'de') THEN 'de' WHEN bool_or(c = 'remote') THEN 'remote' ELSE 'foreign' END AS de_flag FROM c GROUP BY slug"
#: An item of each provider's feed; small boards, so that flags differ.
_FLAG_ITEMS = {
    "greenhouse": ("named_struct('location', named_struct('name', location))", "jobs", _CATEGORY.format("location")),
    "ashby": ("named_struct('location', location, 'isRemote', id % 9 = 2)", "jobs", _CATEGORY.format("(location || CASE WHEN id % 9 = 2 THEN ' remote' ELSE '' END)")),
    "recruitee": ("named_struct('country_code', CASE WHEN id % 6 = 0 THEN 'de' WHEN id % 6 = 1 THEN 'AT' END, 'remote', id % 9 = 2)", "offers", _CODE),
    "breezy": ("named_struct('location', named_struct('country', named_struct('id', CASE WHEN id % 6 = 0 THEN 'DE' WHEN id % 6 = 1 THEN 'AT' END), 'is_remote', id % 9 = 2))", None, _CODE),
    "lever": ("named_struct('categories', named_struct('location', location))", None, _CATEGORY.format("location")),
    "softgarden": ("named_struct('item', named_struct('jobLocation', named_struct('address', named_struct('addressLocality', location))))", "dataFeedElement", _CATEGORY.format("location")),
}


def _flags_of(provider):
    item, wrap, category = _FLAG_ITEMS[provider]

    def run(spark, sf_dir):
        rows = _t(spark, sf_dir, "raw").withColumn("slug", F.floor(F.col("id") / 2).cast("string"))
        body = F.to_json(F.collect_list(F.expr(item)))
        bodies = rows.groupBy("slug").agg((body if wrap is None else F.concat(F.lit(f'{{"{wrap}": '), body, F.lit("}"))).alias("body"))
        return flags.feed_flags(bodies, provider)

    run.__name__ = f"flags_{provider}"
    query(f"AND c AS (SELECT CAST(id // 2 AS VARCHAR) AS slug, {category} AS c FROM raw) {_FOLD}", "raw")(run)


for _provider in _FLAG_ITEMS:
    _flags_of(_provider)

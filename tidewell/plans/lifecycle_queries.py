"""Registered queries of operators that the catalog's others don't reach: lifecycle steps, companies, exports, small text and date functions."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions import values as V
from tidewell.operators import companies, dedup, lifecycle, location, metrics, nearsim, quality, registry, search
from tidewell.plans import fixtures as X
from tidewell.plans.catalog import _BANDS, _CUT_SHELF, _DAYS20, _FLAGS, _HITS, HASHED_SHELF, KEYWORDS, _memory, _registry_rows, _t, query
from tidewell.sources import sinks
from tidewell.sources.shared import new_folder, staged

# -- small functions -----------------------------------------------------------------------------


@query(
    r"""SELECT id, replace(replace(replace(title, '\', '\\'), '%', '\%'), '_', '\_') AS escaped, sha256(trim(regexp_replace(lower(description), '\s+', ' ', 'g'))) AS hashed, base64(encode(CAST(id AS VARCHAR))) AS token,
    'Role ' || id % 7 AS named, CASE WHEN id % 2 = 0 THEN 'Munich (Hybrid)' END AS pinned, lower(strip_accents(company || ' Ünï')) AS plain, contains(lower(description), 'captcha') OR contains(lower(description), 'access denied') AS blocked FROM raw""", "raw",
)
def text_functions(spark, sf_dir):
    named = F.concat(F.lit("https://x/job_posting/role-"), F.col("id") % 7, F.lit("-"), F.col("id"), F.lit("/"))
    page = F.concat(F.lit("<p>x</p>"), F.when(F.col("id") % 2 == 0, "📍 <b>Munich</b> (Hybrid) · Full time").otherwise("none"))
    return _t(spark, sf_dir, "raw").select(
        "id", T.like_escaped(F.col("title")).alias("escaped"), T.text_hash(F.col("description")).alias("hashed"), T.id_token(F.col("id").cast("string")).alias("token"), T.slug_as_title(named).alias("named"),
        T.pinned_location(page).alias("pinned"), T.unaccented(F.concat("company", F.lit(" Ünï"))).alias("plain"), T.looks_blocked(F.col("description")).alias("blocked"),
    )


@query(f"SELECT id, ingested_at AS parsed, CASE WHEN id % 3 = 0 THEN ingested_at WHEN id % 3 = 1 THEN date_trunc('day', ingested_at) END AS posted, ingested_at < {X.NOW} - INTERVAL '20' DAY AS stale FROM raw", "raw")
def date_functions(spark, sf_dir):
    iso = F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    posted = F.when(F.col("id") % 3 == 0, iso).when(F.col("id") % 3 == 1, F.concat(F.date_format("ingested_at", "yyyy-MM-dd"), F.lit(" at noon"))).otherwise("soon")
    return _t(spark, sf_dir, "raw").select("id", V.iso_timestamp(iso).alias("parsed"), V.posted_timestamp(posted).alias("posted"), V.is_stale(F.col("ingested_at"), F.lit(X.AS_OF), 20).alias("stale"))


# -- search --------------------------------------------------------------------------------------


@query(f"SELECT id, scraped_at FROM shelf WHERE {_DAYS20} ORDER BY scraped_at DESC, id LIMIT 50 OFFSET 10", "shelf")
def search_recent(spark, sf_dir):
    return search.page(_t(spark, sf_dir, "shelf"), search.Search(X.AS_OF, max_age_days=20, offset=10)).select("id", "scraped_at")


@query(f"AND {_HITS}, page AS (SELECT id FROM hits WHERE {_DAYS20} ORDER BY r DESC, scraped_at DESC, id LIMIT 50), n AS (SELECT count(*) AS total_count FROM hits WHERE {_DAYS20}) SELECT page.id, total_count FROM page, n", "shelf")
def search_json(spark, sf_dir):
    got = search.page_json(_t(spark, sf_dir, "shelf"), search.Search(X.AS_OF, keywords=KEYWORDS, max_age_days=20))
    return got.select(F.get_json_object("result", "$.id").cast("bigint").alias("id"), "total_count")


@query("SELECT count(*) AS total FROM shelf", "shelf")
def search_past_the_end(spark, sf_dir):
    """A page far behind the last hit: no rows, and the total all the same."""
    shelf, spec = _t(spark, sf_dir, "shelf"), search.Search(X.AS_OF, offset=10**6)
    return search.total(shelf, spec).join(search.page(shelf, spec).select(F.lit("some").alias("some")).limit(1), F.col("some") != "", "left_anti")


# -- lifecycle -----------------------------------------------------------------------------------

_ADDED = "AND every AS (SELECT * FROM raw QUALIFY external_id = '' OR row_number() OVER (PARTITION BY source, external_id ORDER BY id) = 1)"


@query(f"{_ADDED} SELECT id FROM every e WHERE external_id = '' OR NOT EXISTS (SELECT 1 FROM shelf s WHERE s.source = e.source AND s.external_id = e.external_id)", "raw", "shelf")
def inbox_append(spark, sf_dir):
    raw, shelf = _t(spark, sf_dir, "raw", "shelf")
    return lifecycle.appended(raw, shelf).select("id")


@query(
    f"""AND c AS (SELECT id FROM raw WHERE status = 'new' ORDER BY ingested_at, id LIMIT 300)
    SELECT id, CASE WHEN id IN (SELECT id FROM c) THEN 'refining' ELSE status END AS status, CASE WHEN id IN (SELECT id FROM c) THEN {X.NOW} ELSE claimed_at END AS claimed_at FROM raw""", "raw",
)
def claim_batch(spark, sf_dir):
    raw = _t(spark, sf_dir, "raw")
    return lifecycle.after_claim(raw, lifecycle.claimed(raw, 300), X.AS_OF).select("id", "status", "claimed_at")


@query("SELECT DISTINCT source FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.source = r.source AND o.status = 'running' AND o.id % 2000 = 0)", "runs")
def run_claim(spark, sf_dir):
    runs = _t(spark, sf_dir, "runs")
    # Of the log's runs those with these ids are still on.
    on = runs.withColumn("status", F.when(F.col("id") % 2000 == 0, F.col("status")).otherwise("done"))
    return lifecycle.run_starts(runs.select("source").distinct(), on)


@query("SELECT id, CASE WHEN id % 5 <> 0 AND external_id <> '' THEN 'refined' ELSE 'new' END AS status, CASE WHEN id % 5 <> 0 AND external_id <> '' THEN claimed_at END AS claimed_at FROM raw WHERE status = 'refining' UNION ALL SELECT id, status, claimed_at FROM raw WHERE status <> 'refining'", "raw")
def write_flags(spark, sf_dir):
    raw = _t(spark, sf_dir, "raw")
    jobs = raw.filter("status = 'refining'").withColumn("title", F.when(F.col("id") % 5 != 0, F.col("title")))
    return lifecycle.after_write(raw, lifecycle.writable(jobs)).select("id", "status", "claimed_at")


_V1 = "AND v1 AS (SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY scraped_at DESC, title DESC) AS no FROM (SELECT *, CASE WHEN id % 6 = 0 THEN external_id || 'x' ELSE external_id END AS external_id_new FROM shelf WHERE id % 3 = 0) t)"


@query(
    """AND v1 AS (SELECT source, external_id || CASE WHEN id % 6 = 0 THEN 'x' ELSE '' END AS external_id, title || '!' AS title, scraped_at, id FROM shelf WHERE id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY source, external_id || CASE WHEN id % 6 = 0 THEN 'x' ELSE '' END ORDER BY scraped_at DESC, title DESC) = 1),
    old AS (SELECT * FROM shelf QUALIFY row_number() OVER (PARTITION BY source, external_id ORDER BY id DESC) = 1)
    SELECT coalesce(v.source, o.source) AS source, coalesce(v.external_id, o.external_id) AS external_id, coalesce(v.title, o.title) AS title, CASE WHEN v.id IS NULL THEN o.first_seen_at ELSE v.scraped_at END AS first_seen_at, CASE WHEN v.id IS NULL THEN o.status ELSE 'active' END AS status
    FROM old o FULL JOIN v1 v ON o.source = v.source AND o.external_id = v.external_id""", "shelf",
)
def migration_copy(spark, sf_dir):
    shelf = _t(spark, sf_dir, "shelf")
    last = shelf.groupBy("source", "external_id").agg(F.max("id").alias("id"))
    v1 = shelf.filter("id % 3 = 0").withColumns({"external_id": F.concat("external_id", F.when(F.col("id") % 6 == 0, "x").otherwise("")), "title": F.concat("title", F.lit("!"))}).drop("id", "status", "first_seen_at", "last_seen_at")
    got = lifecycle.copied(v1, shelf.join(last, ["source", "external_id", "id"], "left_semi"), X.AS_OF)
    return got.select("source", "external_id", "title", "first_seen_at", "status")


@query("SELECT id, 0 AS score_stage_1, coalesce(is_remote, false) AS is_remote, scraped_at AS last_seen_at, 'active' AS status FROM shelf", "shelf")
def migration_rows(spark, sf_dir):
    rows = _t(spark, sf_dir, "shelf").select("*", F.lit(None).cast("int").alias("score_stage_1")).withColumn("is_remote", F.when(F.col("is_remote"), True)).drop("first_seen_at", "last_seen_at", "status")
    # The id isn't among the columns that are copied; the match title stands for it here.
    return lifecycle.v1_as_v2(rows.withColumn("match_pitch", F.col("id").cast("string")), X.AS_OF).select(F.col("match_pitch").cast("bigint").alias("id"), "score_stage_1", "is_remote", "last_seen_at", "status")


@query(
    f"AND {HASHED_SHELF}, best AS (SELECT * FROM shelf_hashed QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY length(coalesce(description, '')) DESC, scraped_at DESC NULLS LAST, id) = 1){_CUT_SHELF.replace('FROM shelf_hashed', 'FROM best').replace(') SELECT id FROM ranked', '), gone AS (SELECT id FROM ranked') }) SELECT id, content_hash FROM best WHERE id NOT IN (SELECT id FROM gone)", "shelf"
)
def shelf_rehash(spark, sf_dir):
    return dedup.rehashed_shelf(_t(spark, sf_dir, "shelf")).select("id", "content_hash")


@query("SELECT id FROM raw WHERE length(description) < 200 AND NOT contains(url, 'example.com') ORDER BY id LIMIT 100", "raw")
def thin_targets(spark, sf_dir):
    return quality.thin(_t(spark, sf_dir, "raw"), ["example.com"]).select("id")


@query("AND t AS (SELECT id FROM raw WHERE length(description) < 200 ORDER BY id LIMIT 100) SELECT id, CASE WHEN id IN (SELECT id FROM t) AND id % 3 <> 0 THEN length(repeat('long enough ', 30)) ELSE length(description) END AS size FROM raw", "raw")
def backfilled(spark, sf_dir):
    raw = _t(spark, sf_dir, "raw").withColumn("url", F.concat("url", F.lit("?"), "id"))
    fetched = raw.select("url", F.when(F.col("id") % 3 == 0, F.repeat(F.lit("Captcha! "), F.lit(60))).otherwise(F.repeat(F.lit("long enough "), F.lit(30))).alias("fetched"))
    return quality.filled_in(raw, fetched, []).select("id", F.length("description").alias("size"))


@query(f"{_BANDS}, memory AS (SELECT DISTINCT CAST(id AS VARCHAR) AS content_hash, band_hash FROM bands WHERE id % 2 = 0), new AS (SELECT CAST(id - id % 4 AS VARCHAR) AS content_hash, band_hash FROM bands) SELECT content_hash, band_hash FROM memory UNION SELECT content_hash, band_hash FROM new", "raw")
def memory_add(spark, sf_dir):
    bands = staged(nearsim.band_hashes(_t(spark, sf_dir, "raw").select("id", F.col("description").alias("text"))), new_folder(spark, "bands"), "bands")
    new = bands.select((F.col("id") - F.col("id") % 4).cast("string").alias("content_hash"), "band", "band_hash", F.lit(X.AS_OF).alias("seen_at"))
    return nearsim.remembered(_memory(bands), new).select("content_hash", "band_hash")


@query("SELECT id, status FROM runs ORDER BY started_at DESC, id DESC LIMIT 100", "runs")
def run_list(spark, sf_dir):
    return lifecycle.run_list(_t(spark, sf_dir, "runs"), 100).select("id", "status")


# -- places, figures, boards, companies ----------------------------------------------------------


@query("SELECT c_name AS name, CAST(floor(c_acctbal) AS BIGINT) AS population FROM customer WHERE c_custkey % 4 <> 0 AND c_acctbal >= 0 ORDER BY CAST(floor(c_acctbal) AS BIGINT) DESC, c_name LIMIT 200")
def gazetteer_top(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    kind = F.when(F.col("c_custkey") % 4 == 0, "A").otherwise("P")
    number = F.when(F.col("c_acctbal") >= 0, F.floor("c_acctbal").cast("string")).otherwise("none")
    line = F.concat_ws("\t", F.col("c_custkey"), "c_name", "c_name", F.lit("other"), F.lit("50.5"), F.lit("8.5"), kind, *[F.lit("x")] * 7, number)
    return location.top_places(rows.select(line.alias("value")), 200).select("name", "population")


@query("SELECT count(*) AS passes, CAST(sum(n) AS BIGINT) AS fetched, CAST(sum(n % 7) AS BIGINT) AS refined, CAST(0 AS BIGINT) AS rejected, CAST(0 AS BIGINT) AS duplicate FROM runs", "runs")
def pass_totals(spark, sf_dir):
    passes = _t(spark, sf_dir, "runs").select(F.col("n").alias("fetched"), (F.col("n") % 7).alias("refined"), F.lit(0).alias("rejected"), F.lit(0).alias("duplicate"))
    return metrics.pass_totals(passes)


@query(f"{_FLAGS} SELECT source, slug FROM reg WHERE status = 'active' AND flag IN ('de', 'remote')", "board_jobs")
def boards_followed(spark, sf_dir):
    return registry.active_boards(_registry_rows(registry.board_flags(_t(spark, sf_dir, "board_jobs")))).select("source", "slug")


@query(
    f"""{_FLAGS}, listed AS (SELECT source, slug, no AS pos FROM f WHERE no % 3 = 0), act AS (SELECT source, slug FROM reg WHERE status = 'active' AND flag IN ('de', 'remote')),
    every AS (SELECT source, slug, 0 AS part, pos FROM listed UNION ALL SELECT source, slug, 1, 0 FROM act) SELECT source, slug, CAST(min(part) AS INT) AS part, CAST(arg_min(pos, part) AS BIGINT) AS pos FROM every GROUP BY source, slug""", "board_jobs",
)
def board_list(spark, sf_dir):
    found = _registry_rows(registry.board_flags(_t(spark, sf_dir, "board_jobs")))
    no = F.regexp_extract("slug", r"(\d+)$", 1).cast("int")
    return registry.board_list(found.filter(no % 3 == 0).select("source", "slug", no.alias("pos")), found).select("source", "slug", "place.part", "place.pos")


@query("AND every AS (SELECT company AS key, 0 AS part, id AS pos FROM raw WHERE source = 'src1' AND company <> '' UNION ALL SELECT location, 1, id FROM raw WHERE source = 'src1' AND location <> '') SELECT key, CAST(min(part) AS INT) AS part, arg_min(pos, part * 1000000000000 + pos) AS pos FROM every GROUP BY key", "raw")
def search_terms(spark, sf_dir):
    raw = _t(spark, sf_dir, "raw")
    terms = lambda c: raw.select(F.col("source").alias("source_id"), F.col(c).alias("term"), F.col("id").alias("pos"))
    return registry.search_terms(terms("company"), terms("location"), "src1").select("key", "place.part", "place.pos")


@query("SELECT 's' || (s_suppkey % 50) AS line FROM supplier UNION SELECT '# kept ' || s_suppkey FROM supplier WHERE s_suppkey % 10 = 0")
def curated_list(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    slug = F.concat(F.lit("s"), F.col("s_suppkey") % 50)
    lines = rows.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("no"), F.when(F.col("s_suppkey") % 10 == 0, F.concat(F.lit("# kept "), "s_suppkey")).otherwise(F.concat(F.lit(" "), slug)).alias("line"))
    return sinks.curated(lines, rows.select(slug.alias("slug"))).select("line")


@query("SELECT '  - ' || slug || CASE WHEN jobs > 1 THEN '  # ' || jobs || ' jobs: a; b' ELSE '' END AS line FROM (SELECT slug, count(*) AS jobs FROM board_jobs WHERE source = 'lever' GROUP BY slug) t", "board_jobs")
def enumeration_lines(spark, sf_dir):
    jobs = _t(spark, sf_dir, "board_jobs").filter("source = 'lever'").groupBy("slug").agg(F.count(F.lit(1)).alias("n"))
    found = jobs.select("slug", F.when(F.col("n") > 1, F.col("n")).cast("int").alias("job_count"), F.array(F.lit("a"), F.lit(""), F.lit("b")).alias("sample_titles"))
    return sinks.candidate_lines(found).select("line")


@query("SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) || (length(html) % 5) AS slug FROM pages WHERE page_id % 4 <> 0")
def lever_harvest(spark, sf_dir):
    # The pages' hosts as boards' names, every fourth address on another site.
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    board = F.concat(F.lit("https://jobs.lever.co/"), F.initcap(host), F.length("html") % 5, F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/posting?of="), "url")).otherwise(""))
    return registry.harvested(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.when(F.col("page_id") % 4 == 0, F.col("url")).otherwise(board).alias("url")))


_PAGES = "SELECT url, page_id % 3 AS crawl, page_id // 9 AS page FROM pages"


@query(
    f"""WITH p AS ({_PAGES}), few AS (SELECT split_part(regexp_extract(url, '^https?://[^/]+/(.*)', 1), '/', 1) AS slug, crawl FROM p WHERE page < 12)
    SELECT slug, string_agg(DISTINCT 'c' || crawl, ',' ORDER BY 'c' || crawl) AS crawls, (SELECT max(page) FROM p) >= 12 AS truncated FROM few GROUP BY slug"""
)
def slug_enumeration_capped(spark, sf_dir):
    urls = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", F.concat(F.lit("c"), F.col("page_id") % 3).alias("crawl"), F.floor(F.col("page_id") / 9).alias("page"))
    return registry.enumerated(urls, "lever", most_pages=12).withColumn("crawls", F.array_join("crawls", ","))


@query(f"{_FLAGS} SELECT source, string_agg(slug, ',' ORDER BY slug) AS slugs, count(*) AS n FROM f GROUP BY source", "board_jobs")
def slugs_by_source(spark, sf_dir):
    return registry.slugs_by_source(_registry_rows(registry.board_flags(_t(spark, sf_dir, "board_jobs")))).withColumn("slugs", F.array_join("slugs", ","))


def _companies(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("d"), "s_suppkey", F.lit(".com")).alias("domain"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("no"))
    old = rows.filter("no % 4 < 3").select("domain", "name", F.lit("10").alias("size"), F.lit("old").alias("industry"), F.lit("here").alias("location"), F.lit("").alias("linkedin"), F.lit("{}").alias("details"))
    body = F.to_json(F.struct(F.struct(F.concat(F.lit("New "), "name").alias("name"), F.struct((F.col("no") % 3 * 100).alias("employees")).alias("metrics"), F.when(F.col("no") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("tags"), F.struct(F.col("name").alias("handle")).alias("linkedin")).alias("data")))
    status = F.when(F.col("no") % 5 == 0, 404).when(F.col("no") % 7 == 0, 500).otherwise(200)
    return rows, old, rows.select("domain", status.alias("status"), body.alias("body"))


_NEW = """AND s AS (SELECT 'd' || s_suppkey || '.com' AS domain, s_name AS name, s_suppkey AS no, CASE WHEN s_suppkey % 5 = 0 THEN 404 WHEN s_suppkey % 7 = 0 THEN 500 ELSE 200 END AS status FROM supplier),
  a AS (SELECT domain, no, name AS old_name, 'New ' || name AS name, CASE WHEN no % 3 > 0 THEN CAST(no % 3 * 100 AS VARCHAR) END AS size, CASE WHEN no % 2 = 0 THEN 'a, b' END AS industry, 'https://linkedin.com/' || name AS linkedin, status FROM s)"""


@query(
    _NEW.removeprefix("AND ").join(["WITH ", " SELECT domain, CASE WHEN status = 200 THEN CASE WHEN no % 7 <> 1 THEN 'again' ELSE name END ELSE CASE WHEN status = 404 AND no % 7 <> 1 THEN 'again' ELSE old_name END END AS name, CASE WHEN status = 200 AND size IS NOT NULL THEN size ELSE '10' END AS size, CASE WHEN status = 200 AND industry IS NOT NULL THEN industry ELSE 'old' END AS industry, CASE WHEN status = 200 THEN linkedin ELSE '' END AS linkedin FROM a WHERE no % 4 < 3"])
)
def company_chain(spark, sf_dir):
    """A required step, whose failures end a company's chain, then an optional one, which fails for every seventh."""
    rows, old, answers = _companies(spark, sf_dir)
    second = rows.select("domain", (F.col("no") % 7 == 1).alias("failed"), F.lit("again").alias("name"), *[F.lit(None).cast("string").alias(a) for a in companies.ATTRIBUTES[1:]])
    steps = [companies.Step("service", companies.attributes(answers), optional=False), companies.Step("second", second, requires=("service",))]
    return companies.enriched(old, steps).select("domain", "name", "size", "industry", "linkedin")


@query(_NEW.removeprefix("AND ").join(["WITH ", " SELECT domain, CASE WHEN no % 4 < 3 THEN 'known' WHEN status = 200 THEN 'enriched' ELSE 'missing' END AS outcome, CASE WHEN no % 4 < 3 THEN old_name WHEN status = 200 THEN name END AS name FROM a WHERE no % 2 = 1"]))
def company_lookup(spark, sf_dir):
    rows, old, answers = _companies(spark, sf_dir)
    return companies.looked_up(rows.filter("no % 2 = 1"), old, answers).select("domain", "outcome", "name")


@query(_NEW.removeprefix("AND ").join(["WITH ", f" SELECT domain, CASE WHEN no % 2 = 1 THEN name ELSE old_name END AS name, CASE WHEN no % 2 = 1 THEN {X.NOW} ELSE {X.NOW} - INTERVAL '9' DAY END AS enriched_at FROM a WHERE no % 4 < 3 OR no % 2 = 1"]))
def company_upsert(spark, sf_dir):
    rows, old, _ = _companies(spark, sf_dir)
    table = old.withColumn("enriched_at", F.lit(X.AS_OF - timedelta(days=9)))
    new = rows.filter("no % 2 = 1").select("domain", F.concat(F.lit("New "), "name").alias("name"), *[F.lit("x").alias(a) for a in companies.ATTRIBUTES[1:]])
    return companies.upserted(table, new, X.AS_OF).select("domain", "name", "enriched_at")

"""The registered queries of the engine's own operators, each with the SQL that gives the same rows where SQL can.

The SQL is written against the fixture tables, as an independent statement of what an operator does.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions import values as V
from tidewell.operators import dedup, lifecycle, location, metrics, nearsim, quality, registry, search, textindex
from tidewell.plans import fixtures as X
from tidewell.plans import refine as R
from tidewell.sources import boards, pages
from tidewell.sources.shared import exists, new_folder, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *with_tables: str):
    """Register a query; ``sql`` stands on the fixture tables named, and begins with AND if it has more parts of the WITH clause."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            more = sql.strip().startswith("AND ")
            ORACLE_SQL[f.__name__] = X.with_tables(*with_tables) + (", " + sql.strip()[4:] if more else sql) if with_tables else sql
        return f

    return add


def _t(spark, sf_dir, *names):
    got = X.tables(spark, sf_dir, *names)
    return got[0] if len(got) == 1 else got


# -- identity and exact duplicates ---------------------------------------------------------------

_FIELD = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '\\(.*?\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_LEGAL = "\\b(" + "|".join(T.LEGAL_FORMS) + ")\\b"
_COMPANY = f"CASE WHEN {_FIELD} = 'bewerbung als' OR {_FIELD} LIKE 'bewerbung als %' THEN '' ELSE trim(regexp_replace(regexp_replace({_FIELD}, '{_LEGAL}', ' ', 'g'), '\\s+', ' ', 'g')) END"
#: Parts of a WITH clause: hashed(t) is table t with comp, stem and content_hash.
_HASHED = f"""
{{0}}_named AS (SELECT *, {_FIELD.format('title')} AS stem0, {_COMPANY.format('company')} AS comp FROM {{0}}),
{{0}}_stem AS (SELECT *, CASE WHEN comp <> '' AND ends_with(stem0, ' ' || comp) THEN left(stem0, length(stem0) - length(comp) - 1) ELSE stem0 END AS stem FROM {{0}}_named),
{{0}}_hashed AS (SELECT *, left(sha256(stem || '|' || comp), 16) AS content_hash FROM {{0}}_stem)"""
_PARSED = ", parsed AS (SELECT * EXCLUDE (external_id), CASE WHEN external_id <> '' THEN external_id WHEN trim(url) <> '' THEN trim(url) ELSE content_hash END AS external_id FROM raw_hashed)"
HASHED_RAW, HASHED_SHELF = _HASHED.format("raw"), _HASHED.format("shelf")


@query(f"AND {HASHED_RAW} SELECT id, stem, comp, content_hash FROM raw_hashed", "raw")
def content_hash(spark, sf_dir):
    t, c = F.col("title"), F.col("company")
    return _t(spark, sf_dir, "raw").select("id", T.title_stem(t, c).alias("stem"), T.identity_company(c).alias("comp"), T.content_hash(t, c).alias("content_hash"))


@query(f"AND {HASHED_RAW} {_PARSED} SELECT id, external_id, url, content_hash FROM parsed", "raw")
def parsed_ids(spark, sf_dir):
    return dedup.parsed(_t(spark, sf_dir, "raw")).select("id", "external_id", "url", "content_hash")


@query(
    f"AND {HASHED_SHELF} SELECT id, content_hash FROM shelf_hashed QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY length(coalesce(description, '')) DESC, scraped_at DESC NULLS LAST, id) = 1", "shelf"
)
def keep_best_by_hash(spark, sf_dir):
    return dedup.best_of_each_hash(dedup.with_content_hash(_t(spark, sf_dir, "shelf"))).select("id", "content_hash")


_CUT_SHELF = """, stripped AS (
  SELECT id, scraped_at, comp, length(coalesce(description, '')) AS rich, CASE WHEN company <> '' AND regexp_matches(lower(title), '\\s*[-–—|:]\\s*' || regexp_escape(lower(company)) || '\\s*$')
    THEN regexp_replace(title, '(?i)\\s*[-–—|:]\\s*' || regexp_escape(company) || '\\s*$', '') ELSE title END AS bare FROM shelf_hashed
), ranked AS (
  SELECT id, comp, (length(bare) = 64 OR comp = '') AS may_go, first_value(comp) OVER w AS keeper, row_number() OVER w AS no FROM stripped WHERE length(bare) >= 64
  WINDOW w AS (PARTITION BY left(bare, 64) ORDER BY (length(bare) = 64 OR comp = ''), length(bare) DESC, rich DESC, scraped_at DESC NULLS LAST, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
) SELECT id FROM ranked WHERE no > 1 AND may_go AND (comp = '' OR comp = keeper)"""


@query(f"AND {HASHED_SHELF} {_CUT_SHELF}", "shelf")
def collapse_truncated(spark, sf_dir):
    return dedup.cut_on_shelf(_t(spark, sf_dir, "shelf"))


@query(
    f"AND {HASHED_RAW} {_PARSED}, {HASHED_SHELF} SELECT id FROM parsed p WHERE p.external_id IN (SELECT external_id FROM shelf) OR p.url IN (SELECT url FROM shelf) OR p.content_hash IN (SELECT content_hash FROM shelf_hashed)",
    "raw", "shelf",
)
def exact_dedup_semi(spark, sf_dir):
    raw, shelf = _t(spark, sf_dir, "raw", "shelf")
    return dedup.known_on_shelf(dedup.parsed(raw), dedup.with_content_hash(shelf))


_PROBE = "length(title) >= 64 AND (comp = '' OR length(title) = 64)"


@query(f"AND {HASHED_RAW} SELECT id FROM raw_hashed r WHERE {_PROBE} AND EXISTS (SELECT 1 FROM shelf s WHERE starts_with(lower(s.title), lower(left(r.title, 64))))", "raw", "shelf")
def prefix_probe(spark, sf_dir):
    raw, shelf = _t(spark, sf_dir, "raw", "shelf")
    return dedup.prefix_on_shelf(raw, shelf)


_CUT_BATCH = """, long AS (SELECT *, first_value(id) OVER w AS keeper, first_value(comp) OVER w AS keeper_comp FROM raw_hashed WHERE length(title) >= 64
  WINDOW w AS (PARTITION BY left(title, 64) ORDER BY length(title) DESC, id)) SELECT id FROM long WHERE id <> keeper AND (length(title) = 64 OR comp = '') AND (comp = '' OR comp = keeper_comp)"""


@query(f"AND {HASHED_RAW} {_CUT_BATCH}", "raw")
def truncation_batch(spark, sf_dir):
    return dedup.cut_in_batch(_t(spark, sf_dir, "raw"))


_PASS = "{1} AS (SELECT * FROM {0} QUALIFY {2} = '' OR row_number() OVER (PARTITION BY {2} ORDER BY id) = 1)"


@query(f"AND {HASHED_RAW} {_PARSED}, {_PASS.format('parsed', 'p1', 'external_id')}, {_PASS.format('p1', 'p2', 'url')}, {_PASS.format('p2', 'p3', 'content_hash')} SELECT id FROM p3", "raw")
def intra_batch_collapse(spark, sf_dir):
    return dedup.first_of_each_key(dedup.parsed(_t(spark, sf_dir, "raw"))).select("id")


@query("SELECT id FROM raw r WHERE (external_id = '' OR NOT EXISTS (SELECT 1 FROM shelf s WHERE s.source = r.source AND s.external_id = r.external_id))", "raw", "shelf")
def inbox_anti_join(spark, sf_dir):
    raw, shelf = _t(spark, sf_dir, "raw", "shelf")
    return lifecycle.unknown_only(raw, shelf).select("id")


@query("SELECT id, source FROM raw QUALIFY row_number() OVER (PARTITION BY source ORDER BY id) <= 25", "raw")
def ingest_cap(spark, sf_dir):
    return quality.capped(_t(spark, sf_dir, "raw"), 25).select("id", "source")


@query("SELECT * FROM raw WHERE external_id = '' UNION ALL SELECT * FROM raw WHERE external_id <> '' QUALIFY row_number() OVER (PARTITION BY source, external_id ORDER BY ingested_at DESC, id DESC) = 1", "raw")
def inbox_dedup(spark, sf_dir):
    return lifecycle.inbox_first_only(_t(spark, sf_dir, "raw"))


# -- quality and places --------------------------------------------------------------------------


@query(
    """SELECT id, trim(description) <> '' AND length(trim(description)) < 200 AS boilerplate_short, trim(title) = '' AS no_title, trim(description) = '' AS no_description, trim(url) = '' AS no_url,
    CASE WHEN trim(title) = '' OR trim(url) = '' THEN 'reject' ELSE 'keep' END AS verdict FROM raw""", "raw",
)
def dq_flags(spark, sf_dir):
    got = quality.classified(_t(spark, sf_dir, "raw"), quality.Rules(reject=("no_title", "no_url"), activation=date(2024, 1, 1)), X.AS_OF.date())
    fired = lambda n: quality.RULES[n]().alias(n)
    return got.select("id", *[fired(n) for n in quality.RULES], "verdict")


@query("SELECT id, length(trim(title)) >= 2 AND regexp_matches(title, '[A-Za-z0-9]') AS passes FROM raw", "raw")
def quality_gate(spark, sf_dir):
    return _t(spark, sf_dir, "raw").select("id", quality.title_passes(F.col("title")).alias("passes"))


@query(
    "SELECT id, regexp_matches(lower(location), 'remote|homeoffice|home office|fully remote|anywhere|work from home') AS is_remote, contains(lower(location), 'hybrid') AS is_hybrid FROM raw", "raw"
)
def location_flags(spark, sf_dir):
    return _t(spark, sf_dir, "raw").select("id", T.is_remote(F.col("location")).alias("is_remote"), T.is_hybrid(F.col("location")).alias("is_hybrid"))


def _index(spark):
    rows = [(*p, i) for i, p in enumerate(X.GAZETTEER)]
    return location.place_index(spark.createDataFrame(rows, "name string, lat double, lon double, population long, alternate_names string, pos int"))


@query(
    """AND gaz(key, name, lat, lon) AS (VALUES ('berlin', 'Berlin', 52.52437, 13.41053), ('munchen', 'München', 48.13743, 11.57549), ('hamburg', 'Hamburg', 53.55073, 9.99302), ('koln', 'Köln', 50.93333, 6.95), ('frankfurt', 'Frankfurt am Main', 50.11552, 8.68417)),
    cleaned AS (SELECT id, trim(regexp_replace(regexp_replace(location, '\\([^)]*\\)', ' ', 'g'), '\\s+', ' ', 'g')) AS c FROM raw),
    cands AS (SELECT id, unnest([c] || CASE WHEN contains(c, '-') THEN string_split(c, '-') ELSE [] END || CASE WHEN contains(c, '/') THEN string_split(c, '/') ELSE [] END || CASE WHEN contains(c, ',') THEN string_split(c, ',') ELSE [] END || CASE WHEN contains(c, '|') THEN string_split(c, '|') ELSE [] END) AS part,
      unnest(range(20)) AS no FROM cleaned),
    hit AS (SELECT id, name, lat, lon FROM cands JOIN gaz ON lower(strip_accents(trim(part))) = key QUALIFY row_number() OVER (PARTITION BY id ORDER BY no) = 1)
    SELECT raw.id, hit.name AS location_normalized, CAST(hit.lat AS DOUBLE) AS location_lat, CAST(hit.lon AS DOUBLE) AS location_lon FROM raw LEFT JOIN hit ON raw.id = hit.id""", "raw",
)
def location_lookup(spark, sf_dir):
    return location.located(_t(spark, sf_dir, "raw"), _index(spark)).select("id", "location_normalized", "location_lat", "location_lon")


# -- search --------------------------------------------------------------------------------------

_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_MATCH = "((list_contains({0}, 'the') AND list_contains({0}, 'and')) OR list_contains({0}, 'die') OR contains(' ' || array_to_string({0}, ' ') || ' ', ' of the '))"
_FALLING = "list_sum(list_transform([{0}], lambda a: coalesce(list_sum(list_transform(range(1, len(list_filter(tw, lambda x: x = a)) + 1), lambda i: 0.1 / (i * i))), 0) / 1.64493406685)) / {1}"
_RANK = _FALLING.format("'and', 'die', 'of', 'the'", 4)
KEYWORDS = ["the and", "die", '"of the"', "  "]
_HITS = f"""
tokens AS (SELECT *, {_WORDS.format('title')} AS tw, {_WORDS.format('description')} AS dw FROM shelf),
hits AS (SELECT *, CASE WHEN {_MATCH.format('tw')} THEN {_RANK} ELSE 0 END AS r FROM tokens WHERE {_MATCH.format('tw')} OR {_MATCH.format('dw')})"""
_DAYS20 = f"scraped_at >= {X.NOW} - INTERVAL '20' DAY"
_INDEXES: dict[tuple, str] = {}


def _shelf_index(spark, sf_dir, kind: str) -> str:
    """The folder of an index of the shelf, which is built with it once a session: index_words and index_grams are the builds."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _INDEXES or not exists(spark, _INDEXES[key]):
        folder = new_folder(spark, kind)
        textindex.write(_t(spark, sf_dir, "shelf").select("id", *textindex.FIELDS), folder, {"words": textindex.WORDS, "grams": textindex.GRAMS}[kind])
        _INDEXES[key] = folder
    return _INDEXES[key]


def _by_words(spark, sf_dir) -> search.Index:
    return search.Index(words=_shelf_index(spark, sf_dir, "words"))


def _by_grams(spark, sf_dir) -> search.Index:
    return search.Index(grams=_shelf_index(spark, sf_dir, "grams"))


_ENTRIES = """AND texts AS (SELECT id, 'title' AS field, title AS t FROM {0} UNION ALL SELECT id, 'description', description FROM {0} WHERE description IS NOT NULL),
  listed AS (SELECT id, field, """ + _WORDS.format("t") + """ AS ws FROM texts),
  terms AS (SELECT id, field, unnest(ws) AS term, unnest(range(1, len(ws) + 1)) AS place FROM listed)"""


@query(f"{_ENTRIES.replace('{0}', 'shelf')} SELECT term, field, id, string_agg(place, ',' ORDER BY place) AS places FROM terms GROUP BY ALL UNION ALL SELECT '', field, id, '' FROM listed", "shelf")
def index_words(spark, sf_dir):
    folder = new_folder(spark, "words")
    textindex.write(_t(spark, sf_dir, "shelf").select("id", *textindex.FIELDS), folder, textindex.WORDS)
    return textindex.single(spark.read.parquet(f"{folder}/entries")).select("term", "field", "id", F.array_join(F.col("places").cast("array<string>"), ",").alias("places"))


_REFRESHED = "AND after AS (SELECT id, CASE WHEN id % 12 = 0 THEN 'Changed ' || title ELSE title END AS title, description FROM shelf WHERE id % 12 <> 6)"


@query(f"{_REFRESHED}, {_ENTRIES.replace('{0}', 'after')[4:]} SELECT term, field, id, string_agg(place, ',' ORDER BY place) AS places FROM terms WHERE term IN ('changed', 'the', 'die') GROUP BY ALL", "shelf")
def index_refresh(spark, sf_dir):
    """An index of which a sixth of the rows change and another sixth goes."""
    shelf, folder = _t(spark, sf_dir, "shelf").select("id", *textindex.FIELDS), new_folder(spark, "words")
    textindex.write(shelf, folder, textindex.WORDS)
    changed = shelf.filter("id % 12 = 0").withColumn("title", F.concat(F.lit("Changed "), "title"))
    textindex.write(changed, folder, textindex.WORDS, 1, shelf.filter("id % 12 = 6").select("id"))
    got = textindex.lookup(spark, folder, ["changed", "the", "die"])
    return got.select("term", "field", "id", F.array_join(F.col("places").cast("array<string>"), ",").alias("places"))


@query(
    """AND texts AS (SELECT id, 'title' AS field, lower(title) AS t FROM shelf UNION ALL SELECT id, 'description', lower(description) FROM shelf WHERE description IS NOT NULL),
    runs AS (SELECT DISTINCT id, field, substr(t, i, 3) AS term FROM texts, unnest(range(1, greatest(length(t) - 1, 1))) r(i) WHERE i <= length(t) - 2)
    SELECT term, field, count(*) AS n FROM runs GROUP BY ALL UNION ALL SELECT '', field, count(*) FROM texts GROUP BY field""", "shelf",
)
def index_grams(spark, sf_dir):
    folder = new_folder(spark, "grams")
    textindex.write(_t(spark, sf_dir, "shelf").select("id", *textindex.FIELDS), folder, textindex.GRAMS)
    return spark.read.parquet(f"{folder}/sizes").select("term", "field", "n")


@query(f"AND {_HITS}, page AS (SELECT id, r FROM hits WHERE {_DAYS20} ORDER BY r DESC, scraped_at DESC, id LIMIT 100 OFFSET 20) SELECT s.id, round(p.r, 9) AS r, s.title, s.company, s.scraped_at FROM page p JOIN shelf s ON s.id = p.id", "shelf")
def search_ranked(spark, sf_dir):
    got = search.page(_t(spark, sf_dir, "shelf"), search.Search(X.AS_OF, keywords=KEYWORDS, max_age_days=20, limit=100, offset=20), _by_words(spark, sf_dir))
    return got.select("id", F.round("r", 9).alias("r"), "title", "company", "scraped_at")


@query(f"AND {_HITS} SELECT count(*) AS total FROM hits WHERE {_DAYS20}", "shelf")
def search_count(spark, sf_dir):
    return search.total(_t(spark, sf_dir, "shelf"), search.Search(X.AS_OF, keywords=KEYWORDS, max_age_days=20), _by_words(spark, sf_dir))


@query(f"AND {_HITS} SELECT id, round(r, 9) AS r FROM hits", "shelf")
def search_without_index(spark, sf_dir):
    return search.hits(_t(spark, sf_dir, "shelf"), search.Search(X.AS_OF, keywords=KEYWORDS)).select("id", F.round("r", 9).alias("r"))


#: Excluded words and phrases, either of two, and a term that is nothing but excluded words.
SYNTAX = ['the and -"of the"', "die or der -und", "senior -the -and", "-the -die -der -und -and"]
_ROW = "contains(' ' || array_to_string({0}, ' ') || ' ', ' of the ')"
_HAS = "list_contains({0}, '{1}')"


def _syntax(ws: str) -> str:
    has = {w: _HAS.format(ws, w) for w in ("the", "and", "die", "der", "und", "senior")}
    return (
        f"(({has['the']} AND {has['and']} AND NOT {_ROW.format(ws)}) OR {has['die']} OR ({has['der']} AND NOT {has['und']}) OR ({has['senior']} AND NOT {has['the']} AND NOT {has['and']})"
        f" OR (NOT {has['the']} AND NOT {has['die']} AND NOT {has['der']} AND NOT {has['und']} AND NOT {has['and']}))"
    )


@query(
    f"""AND tokens AS (SELECT *, {_WORDS.format('title')} AS tw, {_WORDS.format('description')} AS dw FROM shelf)
    SELECT id, round(CASE WHEN {_syntax('tw')} THEN {_FALLING.format("'and', 'der', 'die', 'of', 'senior', 'the', 'und'", 7)} ELSE 0 END, 9) AS r FROM tokens WHERE {_syntax('tw')} OR (description IS NOT NULL AND {_syntax('dw')})""", "shelf",
)
def search_syntax(spark, sf_dir):
    return search.hits(_t(spark, sf_dir, "shelf"), search.Search(X.AS_OF, keywords=SYNTAX), _by_words(spark, sf_dir)).select("id", F.round("r", 9).alias("r"))


@query(
    """SELECT id FROM shelf WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('remote'), ('ation')) n(x) WHERE title ILIKE '%' || x || '%' OR description ILIKE '%' || x || '%')
    AND (company_domain IS NULL OR company_domain NOT IN ('capco.com'))""", "shelf",
)
def search_negative(spark, sf_dir):
    return search.hits(_t(spark, sf_dir, "shelf"), search.Search(X.AS_OF, without=["remote", "ation"], exclude_domains=["capco.com"]), _by_grams(spark, sf_dir)).select("id")


@query(
    "SELECT id FROM shelf WHERE NOT (title ILIKE '%remote%' OR description ILIKE '%remote%') AND NOT (title ILIKE '%ation%' OR description ILIKE '%ation%') AND company_domain <> 'capco.com'", "shelf"
)
def search_negative_legacy(spark, sf_dir):
    return search.hits(_t(spark, sf_dir, "shelf"), search.Search(X.AS_OF, without=["remote", "ation"], exclude_domains=["capco.com"], legacy=True)).select("id")


@query("SELECT id, title FROM shelf WHERE title ILIKE '%mid%' OR title ILIKE '%medior%' OR title ILIKE '%intermediate%'", "shelf")
def search_seniority(spark, sf_dir):
    return search.hits(_t(spark, sf_dir, "shelf"), search.Search(X.AS_OF, seniority="mid"), _by_grams(spark, sf_dir)).select("id", "title")


@query("SELECT id, salary_min, salary_max FROM shelf WHERE salary_min >= 45000 AND salary_max <= 100000 AND source IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8') AND company_domain IN ('capco.com', 'amberra.com') AND location ILIKE '%an%'", "shelf")
def search_salary(spark, sf_dir):
    spec = search.Search(X.AS_OF, min_salary=45000, max_salary=100000, sources=[f"src{i}" for i in range(1, 9)], domains=["capco.com", "amberra.com"], location="an")
    return search.hits(_t(spark, sf_dir, "shelf"), spec).select("id", "salary_min", "salary_max")


@query(
    """AND km AS (SELECT id, location_lat AS lat, location_lon AS lon, 2 * 6371.0 * asin(sqrt(pow(sin(radians(location_lat - 53.5753) / 2), 2) + cos(radians(53.5753)) * cos(radians(location_lat)) * pow(sin(radians(location_lon - 10.0153) / 2), 2))) AS d
    FROM shelf WHERE location ILIKE '%hamburg%')
    SELECT id, round(d, 6) AS km FROM km WHERE d <= 600 AND lat BETWEEN 53.5753 - 600 / 111.0 AND 53.5753 + 600 / 111.0 AND lon BETWEEN 10.0153 - 600 / (111.0 * cos(radians(53.5753))) AND 10.0153 + 600 / (111.0 * cos(radians(53.5753)))""", "shelf",
)
def distance_filter(spark, sf_dir):
    at = V.geocode("hamburg")
    rows = search.hits(_t(spark, sf_dir, "shelf"), search.Search(X.AS_OF, location="hamburg", max_distance_km=600))
    return rows.select("id", F.round(V.haversine_km(F.lit(at[0]), F.lit(at[1]), F.col("location_lat"), F.col("location_lon")), 6).alias("km"))


_SHOWN = "SELECT id, title, company, location, is_remote AS remote, {0} AS description, url, source, posted_at, [source] AS keywords FROM shelf"


@query(_SHOWN.format("CASE WHEN length(coalesce(description, '')) > 500 THEN left(description, 500) || '...' ELSE coalesce(description, '') END").replace("[source] AS keywords", "source AS keywords"), "shelf")
def list_projection(spark, sf_dir):
    return search.shown(X.full_shelf(spark, sf_dir)).withColumn("keywords", F.array_join("keywords", ","))


@query(_SHOWN.format("coalesce(description, '')").replace("[source] AS keywords", "source AS keywords") + " WHERE id = 8", "shelf")
def detail_projection(spark, sf_dir):
    return search.shown(search.by_id(X.full_shelf(spark, sf_dir), 8), whole=True).withColumn("keywords", F.array_join("keywords", ","))


# -- lifecycle -----------------------------------------------------------------------------------


@query("SELECT id, CAST(CASE WHEN source IN ('src1', 'src2') THEN 1 WHEN source IN ('src7') THEN 3 ELSE 2 END AS INT) AS tier FROM raw WHERE status = 'new' ORDER BY tier, ingested_at, id LIMIT 200", "raw")
def claim_priority(spark, sf_dir):
    return lifecycle.claimed(_t(spark, sf_dir, "raw"), 200, ["src1", "src2"], ["src7"]).select("id", "tier")


@query("SELECT id, CASE WHEN status = 'active' AND last_seen_at < TIMESTAMP '2024-01-17 00:00:00' THEN 'expired' ELSE status END AS status FROM shelf", "shelf")
def expire_stale(spark, sf_dir):
    return lifecycle.expired(_t(spark, sf_dir, "shelf"), X.AS_OF).select("id", "status")


@query("SELECT id FROM shelf s WHERE NOT (last_seen_at < TIMESTAMP '2024-01-10 00:00:00' AND NOT EXISTS (SELECT 1 FROM watchlist t WHERE lower(t.company) = lower(s.company)))", "watchlist", "shelf")
def retention_protected(spark, sf_dir):
    watched, shelf = _t(spark, sf_dir, "watchlist", "shelf")
    return lifecycle.retained(shelf, watched, X.AS_OF).select("id")


@query("SELECT id FROM raw WHERE NOT (status IN ('refined', 'rejected', 'duplicate') AND ingested_at < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '42' DAY + INTERVAL '13' DAY)", "raw")
def inbox_retention(spark, sf_dir):
    return lifecycle.inbox_retained(_t(spark, sf_dir, "raw"), X.AS_OF, 29).select("id")


@query("SELECT count(*) AS purged FROM raw WHERE status IN ('refined', 'rejected', 'duplicate') AND ingested_at < TIMESTAMP '2024-01-02 00:00:00'", "raw")
def inbox_purge_count(spark, sf_dir):
    return lifecycle.purge_count(_t(spark, sf_dir, "raw"), X.AS_OF, 29)


_OLD_CLAIM = "status = 'refining' AND claimed_at < TIMESTAMP '2024-01-30 23:30:00'"


@query(f"SELECT id, CASE WHEN {_OLD_CLAIM} THEN 'new' ELSE status END AS status, CASE WHEN {_OLD_CLAIM} THEN NULL ELSE claimed_at END AS claimed_at FROM raw", "raw")
def reclaim_stale(spark, sf_dir):
    return lifecycle.released(_t(spark, sf_dir, "raw"), X.AS_OF).select("id", "status", "claimed_at")


@query("SELECT id, CASE WHEN status = 'running' AND started_at < TIMESTAMP '2024-01-20 00:00:00' THEN 'failed' ELSE status END AS status FROM runs", "runs")
def reclaim_runs(spark, sf_dir):
    return lifecycle.runs_given_up(_t(spark, sf_dir, "runs"), datetime(2024, 1, 20)).select("id", "status")


@query("SELECT id FROM runs WHERE started_at >= TIMESTAMP '2024-01-16 00:00:00'", "runs")
def run_retention(spark, sf_dir):
    return lifecycle.runs_retained(_t(spark, sf_dir, "runs"), X.AS_OF, 15).select("id")


@query(
    """AND new AS (SELECT source, CASE WHEN external_id = '' THEN url ELSE external_id END AS external_id, title, id FROM raw QUALIFY row_number() OVER (PARTITION BY source, CASE WHEN external_id = '' THEN url ELSE external_id END ORDER BY id DESC) = 1),
    old AS (SELECT * FROM shelf QUALIFY row_number() OVER (PARTITION BY source, external_id ORDER BY id DESC) = 1)
    SELECT coalesce(o.id, n.id) AS id, coalesce(n.source, o.source) AS source, coalesce(n.external_id, o.external_id) AS external_id, coalesce(n.title, o.title) AS title, coalesce(o.first_seen_at, TIMESTAMP '2024-01-31 00:00:00') AS first_seen_at,
      CASE WHEN n.id IS NULL THEN o.last_seen_at ELSE TIMESTAMP '2024-01-31 00:00:00' END AS last_seen_at, CASE WHEN n.id IS NULL THEN o.status ELSE 'active' END AS status
    FROM old o FULL JOIN new n ON o.source = n.source AND o.external_id = n.external_id""", "raw", "shelf",
)
def shelf_upsert(spark, sf_dir):
    raw, shelf = _t(spark, sf_dir, "raw", "shelf")
    named = raw.withColumn("external_id", F.coalesce(T.filled(F.col("external_id")), F.col("url")))
    last = shelf.groupBy("source", "external_id").agg(F.max("id").alias("id"))
    got = lifecycle.shelf_upserted(shelf.join(last, ["source", "external_id", "id"], "left_semi"), named, X.AS_OF)
    return got.select("id", "source", "external_id", "title", "first_seen_at", "last_seen_at", "status")


_LAST = "AND last AS (SELECT source, max(started_at) FILTER (status = 'done') AS last_success FROM runs GROUP BY source) SELECT source, last_success, coalesce({0}, true) AS due FROM last"


@query(_LAST.format("last_success < TIMESTAMP '2024-01-30 06:00:00'"), "runs")
def cadence_due(spark, sf_dir):
    runs = _t(spark, sf_dir, "runs")
    return lifecycle.due_sources(runs, runs, X.AS_OF, anchor_hour=6)


@query(_LAST.format("last_success <= TIMESTAMP '2024-01-29 12:00:00'"), "runs")
def cadence_interval(spark, sf_dir):
    runs = _t(spark, sf_dir, "runs")
    return lifecycle.due_sources(runs, runs, X.AS_OF, least_hours=36)


@query("AND newest AS (SELECT * FROM runs ORDER BY started_at DESC, id DESC LIMIT 500) SELECT source, id, status FROM newest QUALIFY row_number() OVER (PARTITION BY source ORDER BY started_at DESC, id DESC) = 1", "runs")
def latest_per_source(spark, sf_dir):
    return lifecycle.latest_runs(_t(spark, sf_dir, "runs")).select("source", "id", "status")


@query("SELECT id, source FROM runs WHERE started_at >= TIMESTAMP '2024-01-28 00:00:00' ORDER BY started_at DESC, id DESC LIMIT 40", "runs")
def last_cycles(spark, sf_dir):
    return lifecycle.last_runs(_t(spark, sf_dir, "runs"), X.AS_OF, 40, 72).select("id", "source")


@query(
    """SELECT source AS source_name, CAST(doc_id AS VARCHAR) AS fetch_key, sha256(text) AS checksum, doc_id % 3 = 0 AS unchanged, TIMESTAMP '2024-01-31 00:00:00' AS last_fetched_at,
    CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-01-05 00:00:00' ELSE TIMESTAMP '2024-01-31 00:00:00' END AS last_changed_at FROM documents"""
)
def fetch_unchanged(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bodies = docs.select(F.col("source").alias("source_name"), F.col("doc_id").cast("string").alias("fetch_key"), F.col("text").alias("body"), "doc_id")
    then = F.to_timestamp(F.lit("2024-01-05 00:00:00"))
    # Of every third unit the cache knows this body, of the next another, of the last nothing.
    cache = bodies.filter("doc_id % 3 < 2").select("source_name", "fetch_key", F.when(F.col("doc_id") % 3 == 0, T.fetch_checksum(F.col("body"))).otherwise("other").alias("checksum"), then.alias("last_fetched_at"), then.alias("last_changed_at"))
    return lifecycle.fetch_outcomes(bodies, cache, X.AS_OF)


# -- figures -------------------------------------------------------------------------------------


@query(
    "SELECT count(*) AS total, round_even(100.0 * count(location_normalized) / count(*), 2) AS location_pct, round_even(100.0 * count(*) FILTER (flagged) / count(*), 2) AS flagged_pct, count(*) FILTER (scraped_at >= TIMESTAMP '2024-01-30 00:00:00') AS last_24h FROM shelf", "shelf"
)
def coverage_metrics(spark, sf_dir):
    return metrics.coverage(X.full_shelf(spark, sf_dir), X.AS_OF)


@query(
    """AND b AS (SELECT count(*) AS waiting, CAST(coalesce(epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(min(ingested_at)), 0) AS BIGINT) AS oldest_seconds FROM raw WHERE status = 'new')
    SELECT waiting, round_even(oldest_seconds / 3600.0, 1) AS oldest_hours, oldest_seconds, CASE WHEN waiting >= 30000 THEN 'throttled' ELSE 'open' END AS gate FROM b""", "raw",
)
def backlog_metrics(spark, sf_dir):
    return metrics.backlog(_t(spark, sf_dir, "raw"), X.AS_OF)


@query("SELECT event_id, CAST(printf('%.2f', (event_id * 10 + 5) / 1000.0::DOUBLE) AS DOUBLE) AS tie, CAST(printf('%.1f', value) AS DOUBLE) AS tenth, CAST(printf('%.0f', event_id / 2.0::DOUBLE) AS DOUBLE) AS half FROM events")
def rounded_values(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", V.rounded((F.col("event_id") * 10 + 5) / F.lit(1000.0), 2).alias("tie"), V.rounded(F.col("value"), 1).alias("tenth"), V.rounded(F.col("event_id") / F.lit(2.0), 0).alias("half"))


_STAT = "CAST(coalesce(sum(CAST(json_extract_string(stats, '$.{0}') AS BIGINT)), 0) AS BIGINT)"


@query(
    f"""AND w AS (SELECT * FROM runs WHERE finished_at >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL '1' DAY), f AS (SELECT {_STAT.format('refined')} AS throughput, {_STAT.format('duplicate')} + {_STAT.format('rejected')} AS waste, {_STAT.format('jobs_stored')} AS arrivals FROM w)
    SELECT throughput, waste, round_even(CASE WHEN throughput + waste = 0 THEN 0 ELSE waste / (throughput + waste) END, 2) AS waste_rate, arrivals FROM f""", "runs",
)
def flow_24h(spark, sf_dir):
    runs = _t(spark, sf_dir, "runs")
    return metrics.flow(runs, runs, datetime(2024, 1, 30))


@query("SELECT status, count(*) AS n FROM raw GROUP BY status", "raw")
def status_breakdown(spark, sf_dir):
    return metrics.statuses(_t(spark, sf_dir, "raw"))


# -- addresses and boards ------------------------------------------------------------------------

_HOST = "lower(regexp_extract(url, '^https?://([^/:?#]+)', 1))"


@query(f"SELECT id, CASE WHEN contains({_HOST}, 'greenhouse.io') THEN 'greenhouse' ELSE 'generic' END AS provider, regexp_extract(url, '([^/]+)/jobs/([0-9]+)', 1) AS board, regexp_extract(url, '([^/]+)/jobs/([0-9]+)', 2) AS job FROM raw WHERE NOT contains({_HOST}, 'example.com')", "raw")
def url_provider(spark, sf_dir):
    rows = _t(spark, sf_dir, "raw").filter(~T.host_blocked(F.col("url"), ["example.com"]))
    return rows.select("id", T.resolution_provider(F.col("url")).alias("provider"), T.board_and_job(F.col("url"))["board"].alias("board"), T.board_and_job(F.col("url"))["job"].alias("job"))


@query(
    f"""SELECT id, CASE WHEN contains({_HOST}, 'greenhouse.io') THEN split_part(regexp_extract(url, '^https?://[^/]+/(.*)', 1), '/', 1) || '.com' WHEN contains({_HOST}, 'indeed.com') THEN '' ELSE replace({_HOST}, 'www.', '') END AS by_url,
    CASE WHEN company = '' THEN '' ELSE split_part(trim(regexp_replace(lower(company), '[^a-z0-9\\s]', '', 'g')), ' ', 1) || '.com' END AS by_name FROM raw""", "raw",
)
def url_domain(spark, sf_dir):
    return _t(spark, sf_dir, "raw").select("id", T.domain_of_url(F.col("url")).alias("by_url"), T.domain_of_name(F.col("company")).alias("by_name"))


_ATTRIBUTES = """(?:[^>"'']|"[^"]*"|''[^'']*'')*"""
_LINES = "|".join(pages.LINES)
_LINE_TAG, _DROPPED_TAG = (f"(?is)</?(?:{names})(?:[\\s/]{_ATTRIBUTES})?>" for names in (_LINES, "|".join(pages.DROPPED)))
#: The pages' references are these; an end tag without an open element doesn't occur.
_HTML = f"""WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\\b[^>]*>.*?(?:</script\\s*>|\\z)', '', 'g'), '(?is)<style\\b[^>]*>.*?(?:</style\\s*>|\\z)', '', 'g'), '(?s)<!--.*?(?:-->|\\z)', '', 'g'), '(?s)<[!?][^>]*>', '', 'g') AS t FROM pages),
  cut AS (SELECT page_id, regexp_split_to_array(t, '{_DROPPED_TAG}') AS parts, list_transform(regexp_extract_all(t, '{_DROPPED_TAG}'), lambda x: CASE WHEN starts_with(x, '</') THEN -1 WHEN ends_with(x, '/>') THEN 0 ELSE 1 END) AS steps FROM bare),
  kept AS (SELECT page_id, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: CASE WHEN coalesce(list_sum(steps[1:i - 1]), 0) <= 0 THEN parts[i] ELSE array_to_string(regexp_extract_all(parts[i], '{_LINE_TAG}'), '') END), '') AS t FROM cut),
  lined AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?is)<(?:{_LINES})(?:\\s{_ATTRIBUTES})?/>', chr(10) || chr(10), 'g'), '{_LINE_TAG}', chr(10), 'g') AS t FROM kept),
  plain AS (SELECT page_id, regexp_replace(replace(replace(replace(regexp_replace(t, '(?s)</?[a-zA-Z]{_ATTRIBUTES}>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g') AS t FROM lined),
  spaced AS (SELECT page_id, regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g') AS t FROM plain)
  SELECT page_id, trim(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM spaced"""


@query(_HTML)
def html_text(spark, sf_dir):
    return pages.with_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), "html", "text").select("page_id", "text")


_DE = T.GERMAN_PLACE.replace("(?i)", "")
_PLACE = "(place || CASE WHEN remote THEN ' remote' ELSE '' END)"
_CATEGORY = f"""CASE WHEN source IN ('recruitee', 'breezy') THEN CASE WHEN upper(country) = 'DE' THEN 'de' WHEN country <> '' THEN 'foreign' WHEN remote THEN 'remote' ELSE 'foreign' END
  WHEN regexp_matches({_PLACE}, '(?i)(^|[^a-zäöü])(germany|berlin|münchen|hamburg|köln|frankfurt)([^a-zäöü]|$)') THEN 'de' WHEN regexp_matches({_PLACE}, '(?i)remote') AND NOT regexp_matches({_PLACE}, '(?i)london, uk') THEN 'remote' ELSE 'foreign' END"""


@query(
    f"AND c AS (SELECT source, slug, {_CATEGORY} AS cat FROM board_jobs) SELECT source, slug, CASE WHEN bool_or(cat = 'de') THEN 'de' WHEN bool_or(cat = 'remote') THEN 'remote' ELSE 'foreign' END AS de_flag, count(*) AS jobs FROM c GROUP BY source, slug", "board_jobs"
)
def board_fold(spark, sf_dir):
    return registry.board_flags(_t(spark, sf_dir, "board_jobs"))


def _registry_rows(flags):
    """A registry made of the boards' flags: every fifth is paused, every seventh unclassified."""
    no = F.regexp_extract("slug", r"(\d+)$", 1).cast("int")
    return flags.select(
        "source", "slug", F.lit("cc").alias("origin"), F.array(F.lit("c1")).alias("seen_in_crawls"), F.when(no % 5 == 0, "paused").otherwise("active").alias("status"), F.lit(True).alias("monitor"),
        F.col("jobs").cast("int").alias("initial_job_count"), F.col("jobs").cast("int").alias("last_job_count"), F.when(no % 7 != 0, F.col("de_flag")).alias("de_flag"), F.array("slug").alias("sample_titles"),
    )


_FLAGS = f"""AND c AS (SELECT source, slug, {_CATEGORY} AS cat FROM board_jobs), f AS (SELECT source, slug, CAST(regexp_extract(slug, '[0-9]+$') AS INT) AS no, CASE WHEN bool_or(cat = 'de') THEN 'de' WHEN bool_or(cat = 'remote') THEN 'remote' ELSE 'foreign' END AS flag, CAST(count(*) AS INT) AS jobs FROM c GROUP BY source, slug),
  reg AS (SELECT source, slug, no, jobs, CASE WHEN no % 5 = 0 THEN 'paused' ELSE 'active' END AS status, CASE WHEN no % 7 <> 0 THEN flag END AS flag FROM f)"""


@query(f"{_FLAGS} SELECT source, count(*) AS active, count(*) FILTER (flag = 'de') AS de, count(*) FILTER (flag = 'remote') AS remote, count(*) FILTER (flag = 'foreign') AS foreign, count(*) FILTER (flag IS NULL) AS unknown, count(*) FILTER (flag IN ('de', 'remote')) AS keep FROM reg WHERE status = 'active' GROUP BY source".replace("AS foreign,", 'AS "foreign",'), "board_jobs")
def board_counts(spark, sf_dir):
    return registry.flag_counts(_registry_rows(registry.board_flags(_t(spark, sf_dir, "board_jobs"))))


@query(f"{_FLAGS} SELECT source, slug FROM reg WHERE flag IS NULL", "board_jobs")
def unclassified_boards(spark, sf_dir):
    return registry.unclassified(_registry_rows(registry.board_flags(_t(spark, sf_dir, "board_jobs"))))


@query(
    f"""{_FLAGS}, old AS (SELECT * FROM reg WHERE no % 2 = 0), val AS (SELECT *, no % 4 <> 3 AS ok, CASE WHEN no % 9 = 0 THEN 'HTTP 404' ELSE '' END AS err FROM f WHERE no % 3 = 0),
    st AS (SELECT *, CASE WHEN ok THEN 'active' WHEN err <> '' THEN 'dead' ELSE 'paused' END AS status FROM val)
    SELECT coalesce(f.source, '') AS source, f.slug, coalesce(st.status, old.status, 'paused') AS status, CASE WHEN st.slug IS NOT NULL THEN st.status <> 'dead' AND st.flag IN ('de', 'remote') WHEN old.slug IS NOT NULL THEN true ELSE false END AS monitor,
      CASE WHEN old.slug IS NOT NULL THEN old.jobs ELSE st.jobs + 1 END AS initial_job_count, CASE WHEN st.slug IS NOT NULL THEN st.jobs + 1 ELSE old.jobs END AS last_job_count,
      CASE WHEN st.slug IS NOT NULL THEN st.flag ELSE old.flag END AS de_flag, CASE WHEN old.slug IS NOT NULL AND st.slug IS NOT NULL THEN 'c1,c2' WHEN old.slug IS NOT NULL THEN 'c1' ELSE 'c2' END AS seen
    FROM f LEFT JOIN old USING (source, slug) LEFT JOIN st USING (source, slug)""", "board_jobs",
)
def registry_upsert(spark, sf_dir):
    flags = registry.board_flags(_t(spark, sf_dir, "board_jobs")).withColumn("no", F.regexp_extract("slug", r"(\d+)$", 1).cast("int"))
    old = _registry_rows(flags.filter("no % 2 = 0").drop("no"))
    validated = flags.filter("no % 3 = 0").select(
        "source", "slug", (F.col("no") % 4 != 3).alias("active"), F.when(F.col("no") % 9 == 0, "HTTP 404").otherwise("").alias("error"), (F.col("jobs") + 1).cast("int").alias("job_count"), "de_flag",
        F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")).alias("sample_titles"), F.array(F.lit("c2")).alias("crawls"),
    )
    got = registry.registered(old, validated, flags.select("source", "slug", F.array(F.lit("c2")).alias("crawls")))
    return got.select("source", "slug", "status", "monitor", "initial_job_count", "last_job_count", "de_flag", F.array_join("seen_in_crawls", ",").alias("seen"))


@query("SELECT split_part(regexp_extract(url, '^https?://[^/]+/(.*)', 1), '/', 1) AS slug, string_agg(DISTINCT 'c' || (page_id % 3), ',' ORDER BY 'c' || (page_id % 3)) AS crawls FROM pages GROUP BY 1")
def slug_enumeration(spark, sf_dir):
    urls = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", F.concat(F.lit("c"), F.col("page_id") % 3).alias("crawl"))
    return registry.enumerated(urls, "lever").select("slug", F.array_join("crawls", ",").alias("crawls"))


@query(
    """AND every AS (SELECT source AS key, 0 AS part, min(id) AS pos FROM raw WHERE id % 2 = 1 GROUP BY source UNION ALL SELECT company, 1, min(id) FROM raw GROUP BY company UNION ALL SELECT source, 1, min(id) FROM raw GROUP BY source),
    first AS (SELECT key, min(part * 1000000000000 + pos) AS place FROM every GROUP BY key) SELECT key, CAST(place // 1000000000000 AS INT) AS part, place % 1000000000000 AS pos FROM first""", "raw",
)
def order_preserving_union(spark, sf_dir):
    raw = _t(spark, sf_dir, "raw")
    both = raw.select(F.explode(F.array("company", "source")).alias("key"), F.col("id").alias("pos"))
    got = registry.ordered_union(raw.filter("id % 2 = 1").select(F.col("source").alias("key"), F.col("id").alias("pos")), both)
    return got.select("key", "place.part", "place.pos")


@query("SELECT DISTINCT source, external_id FROM raw EXCEPT SELECT source, external_id FROM shelf", "raw", "shelf")
def key_coverage_diff(spark, sf_dir):
    raw, shelf = _t(spark, sf_dir, "raw", "shelf")
    return registry.missing_keys(raw, shelf, ["source", "external_id"])


@query("SELECT r.id, 'description' AS field, r.description AS before, s.description AS after FROM raw r JOIN shelf s ON r.id = s.id WHERE r.description IS DISTINCT FROM s.description UNION ALL SELECT r.id, 'title', r.title, s.title FROM raw r JOIN shelf s ON r.id = s.id WHERE r.title IS DISTINCT FROM s.title", "raw", "shelf")
def field_diff(spark, sf_dir):
    raw, shelf = _t(spark, sf_dir, "raw", "shelf")
    return registry.field_differences(raw, shelf, ["id"], ["title", "description", "url"])


@query(
    "SELECT s.s_suppkey AS company, n.n_name AS country, c.c_name AS signal_type, c.c_acctbal AS transformation_signal_score FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN (SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name) = 1) c ON c.c_nationkey = s.s_nationkey"
)
def company_signals(spark, sf_dir):
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    companies = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("s_suppkey").alias("company"), F.col("n_name").alias("country"), F.col("s_nationkey").alias("domain"))
    signals = read("customer").select(F.col("c_nationkey").alias("domain"), F.col("c_name").alias("signal_type"), F.col("c_acctbal").alias("transformation_signal_score"))
    return registry.company_view(companies, signals).drop("domain")


@query("SELECT id, CASE WHEN source IN ('src1', 'src2') THEN 'aggregator' WHEN source = 'src3' THEN 'ats' ELSE 'unknown' END AS type, source IN ('src1', 'src2') AS is_aggregator FROM raw", "raw")
def source_type(spark, sf_dir):
    dim = spark.createDataFrame([("src1", "aggregator"), ("src2", "aggregator"), ("src3", "ats")], "code string, type string")
    return registry.source_types(_t(spark, sf_dir, "raw"), dim).select("id", "type", "is_aggregator")


# -- near duplicates -----------------------------------------------------------------------------

_LANE_ROWS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(nearsim.lanes()))
_BANDS = f"""AND lanes(lane, a, b) AS (VALUES {_LANE_ROWS}), norm AS (SELECT id, string_split(trim(regexp_replace(lower(description), '\\s+', ' ', 'g')), '') AS cs FROM raw WHERE description <> ''),
  points AS (SELECT id, len(cs) AS n, unnest(range(1, len(cs) + 1)) AS i, CAST(unicode(unnest(cs)) AS BIGINT) AS c0 FROM norm),
  runs AS (SELECT id, n, i, c0, lead(c0, 1) OVER w AS c1, lead(c0, 2) OVER w AS c2, lead(c0, 3) OVER w AS c3, lead(c0, 4) OVER w AS c4 FROM points WINDOW w AS (PARTITION BY id ORDER BY i)),
  h0 AS (SELECT id, c0 AS h, c1, c2, c3, c4 FROM runs WHERE i <= greatest(n - 4, 1)),
  h1 AS (SELECT id, CASE WHEN c1 IS NULL THEN h ELSE (h * {nearsim.BASE} + c1) % {nearsim.PRIME} END AS h, c2, c3, c4 FROM h0), h2 AS (SELECT id, CASE WHEN c2 IS NULL THEN h ELSE (h * {nearsim.BASE} + c2) % {nearsim.PRIME} END AS h, c3, c4 FROM h1),
  h3 AS (SELECT id, CASE WHEN c3 IS NULL THEN h ELSE (h * {nearsim.BASE} + c3) % {nearsim.PRIME} END AS h, c4 FROM h2), hashes AS (SELECT DISTINCT id, CASE WHEN c4 IS NULL THEN h ELSE (h * {nearsim.BASE} + c4) % {nearsim.PRIME} END AS h FROM h3),
  low AS (SELECT id, lane, min((a * h + b) % {nearsim.PRIME}) AS v FROM hashes, lanes GROUP BY id, lane),
  bands AS (SELECT id, CAST(lane // {nearsim.BAND_WIDTH} AS INT) AS band, md5(string_agg(CAST(v AS VARCHAR), '-' ORDER BY lane)) AS band_hash FROM low GROUP BY id, lane // {nearsim.BAND_WIDTH})"""


def _bands(spark, sf_dir, of: str = "true"):
    return nearsim.band_hashes(_t(spark, sf_dir, "raw").filter(of).select("id", F.col("description").alias("text")))


@query(f"{_BANDS} SELECT id, band, band_hash FROM bands", "raw")
def shingle_bands(spark, sf_dir):
    return _bands(spark, sf_dir)


def _memory(bands):
    """A memory of every even document, seen as many hours ago as its id."""
    return bands.filter("id % 2 = 0").select(F.col("id").cast("string").alias("content_hash"), "band", "band_hash", (F.lit(X.AS_OF) - F.make_dt_interval(hours=(F.col("id") % 500).cast("int"))).alias("seen_at"))


_MEMORY = f"{_BANDS}, memory AS (SELECT id AS mid, band, band_hash FROM bands WHERE id % 2 = 0 AND id % 500 <= 240)"


@query(f"{_MEMORY}, s AS (SELECT b.id, mid, count(DISTINCT b.band) AS n FROM bands b JOIN memory m ON b.band = m.band AND b.band_hash = m.band_hash GROUP BY b.id, mid) SELECT id, CAST(max(n) AS INT) AS shared FROM s GROUP BY id HAVING max(n) >= {nearsim.required_bands()}", "raw")
def near_dup_pairs(spark, sf_dir):
    bands = staged(_bands(spark, sf_dir), new_folder(spark, "bands"), "bands")  # read for either side
    return nearsim.shared_bands(bands, _memory(bands), F.lit(X.AS_OF), least=nearsim.required_bands())


@query(f"{_BANDS} SELECT CAST(id AS VARCHAR) AS content_hash, band FROM bands WHERE id % 2 = 0 AND id % 500 <= 240", "raw")
def memory_window(spark, sf_dir):
    return nearsim.forgotten(_memory(_bands(spark, sf_dir, "id % 2 = 0")), F.lit(X.AS_OF)).select("content_hash", "band")


# -- the whole batch -----------------------------------------------------------------------------


def _refined(spark, sf_dir):
    """All new rows of the inbox as one batch, against a shelf of every sixth posting, the memory that it left yesterday, and a longer text for every address."""
    raw, folder = _t(spark, sf_dir, "raw"), new_folder(spark, "kept")
    # Shelf and memory are read by several steps, as the tables that they are in an engine: hashes and bands are computed once.
    shelf = staged(dedup.with_content_hash(X.full_shelf(spark, sf_dir).filter("id % 6 = 0")), folder, "shelf")
    seen = nearsim.band_hashes(shelf.select("id", F.col("description").alias("text"))).join(shelf.select("id", "content_hash"), "id")
    memory = staged(seen.select("content_hash", "band", "band_hash", F.lit(X.AS_OF - timedelta(days=1)).alias("seen_at")), folder, "memory")
    fetched = raw.select("url", F.repeat(F.lit("A fuller text of this posting. "), F.lit(20)).alias("fetched"))
    batch = raw.filter("status = 'new'").drop("claimed_at")
    return R.refine(batch, shelf, memory, _index(spark), fetched, R.Settings(X.AS_OF, rules=quality.Rules(activation=date(2024, 1, 1))))


_OUTCOMES = f"""AND fresh AS (SELECT * FROM raw WHERE status = 'new'), {_HASHED.format('fresh').strip()} {_PARSED.replace('raw_hashed', 'fresh_hashed')}, sh AS (SELECT * FROM shelf WHERE id % 6 = 0), {_HASHED.format('sh').strip()},
  seen AS (SELECT id FROM parsed WHERE (external_id <> '' AND external_id IN (SELECT external_id FROM sh)) OR (url <> '' AND url IN (SELECT url FROM sh)) OR content_hash IN (SELECT content_hash FROM sh_hashed)
    OR ({_PROBE} AND lower(left(title, 64)) IN (SELECT lower(left(title, 64)) FROM sh WHERE length(title) >= 64))),
  rest AS (SELECT * FROM parsed WHERE id NOT IN (SELECT id FROM seen)),
  cut AS (SELECT *, first_value(id) OVER w AS keeper, first_value(comp) OVER w AS keeper_comp FROM rest WHERE length(title) >= 64 WINDOW w AS (PARTITION BY left(title, 64) ORDER BY length(title) DESC, id)),
  p0 AS (SELECT * FROM rest WHERE id NOT IN (SELECT id FROM cut WHERE id <> keeper AND (length(title) = 64 OR comp = '') AND (comp = '' OR comp = keeper_comp))),
  {_PASS.format('p0', 'p1', 'external_id')}, {_PASS.format('p1', 'p2', 'url')}, {_PASS.format('p2', 'p3', 'content_hash')}, {_BANDS[4:]},
  memory AS (SELECT h.content_hash, b.band, b.band_hash FROM bands b JOIN sh_hashed h ON h.id = b.id WHERE h.description IS NOT NULL),
  near AS (SELECT b.id FROM bands b JOIN memory m ON b.band = m.band AND b.band_hash = m.band_hash WHERE b.id IN (SELECT id FROM p3) GROUP BY b.id, m.content_hash HAVING count(DISTINCT b.band) >= {nearsim.required_bands()}),
  outcomes AS (SELECT id, CASE WHEN id NOT IN (SELECT id FROM p3) OR id IN (SELECT id FROM near) THEN 'duplicate' WHEN trim(title) = '' OR trim(url) = '' OR length(trim(title)) < 2 OR NOT regexp_matches(title, '[A-Za-z0-9]') THEN 'rejected' ELSE 'refined' END AS outcome FROM parsed)"""


@query(f"{_OUTCOMES} SELECT * FROM outcomes", "raw", "shelf")
def refine_outcomes(spark, sf_dir):
    return _refined(spark, sf_dir).outcomes


@query(f"{_OUTCOMES} SELECT count(*) AS fetched, count(*) FILTER (outcome = 'refined') AS refined, count(*) FILTER (outcome = 'rejected') AS rejected, count(*) FILTER (outcome = 'duplicate') AS duplicate FROM outcomes", "raw", "shelf")
def refine_summary(spark, sf_dir):
    return metrics.outcome_counts(_refined(spark, sf_dir).outcomes)


# -- payloads ------------------------------------------------------------------------------------


def _payloads(spark, sf_dir, item: str, wrap: str | None, board: str = "board"):
    """Bodies of boards of up to 100 neighbouring rows of the inbox, by a JSON of each."""
    rows = _t(spark, sf_dir, "raw").withColumn("slug", F.concat(F.lit(board), F.floor(F.col("id") / 100)))
    body = F.to_json(F.array_sort(F.collect_list(F.expr(item))))
    bodies = rows.groupBy("slug").agg(body.alias("body"))
    return bodies if wrap is None else bodies.withColumn("body", F.concat(F.lit(f'{{"{wrap}": '), F.col("body"), F.lit("}")))


_POSTED = "SELECT title, url, {0} AS company, location, description, '' AS salary, '{1}' AS source, CAST(id AS VARCHAR) AS external_id FROM raw"


@query(_POSTED.format("'board' || (id // 100)", "greenhouse"), "raw")
def src_greenhouse(spark, sf_dir):
    made = _payloads(spark, sf_dir, "named_struct('id', id, 'title', title, 'absolute_url', url, 'content', description, 'location', named_struct('name', location))", "jobs")
    return boards.postings("greenhouse", made).drop("posted_at")


@query(_POSTED.format("'board' || (id // 100)", "lever"), "raw")
def src_lever(spark, sf_dir):
    made = _payloads(spark, sf_dir, "named_struct('id', id, 'text', title, 'hostedUrl', url, 'descriptionPlain', description, 'categories', named_struct('location', location))", None)
    return boards.postings("lever", made).drop("posted_at")


@query(_POSTED.format("CASE WHEN company = '' THEN 'board' || (id // 100) ELSE company END", "recruitee").replace("'' AS salary", "'50000-70000 EUR / year' AS salary") + " WHERE id % 4 <> 0", "raw")
def src_recruitee(spark, sf_dir):
    item = "named_struct('id', id, 'title', title, 'careers_url', url, 'company_name', company, 'description', description, 'location', location, 'status', if(id % 4 = 0, 'draft', 'published'), 'salary', named_struct('min', 50000, 'max', 70000, 'currency', 'EUR', 'period', 'year'))"
    return boards.postings("recruitee", _payloads(spark, sf_dir, item, "offers")).drop("posted_at")


@query("SELECT 'board' || (id // 100) AS slug, true AS active, CAST(count(*) AS INT) AS job_count, CAST(NULL AS VARCHAR) AS error FROM raw GROUP BY 1", "raw")
def feed_validation(spark, sf_dir):
    made = _payloads(spark, sf_dir, "named_struct('id', id, 'title', coalesce(title, ''))", "jobs").withColumn("status", F.lit(200))
    return boards.validated(made, "greenhouse").drop("sample_titles")


from tidewell.plans import lifecycle_queries, payload_queries, stream_queries  # noqa: E402, F401  they register more

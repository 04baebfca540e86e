"""The engine's tables derived from the driver's: one SQL text that Spark and DuckDB both run.

Derivations use only row values, so they are the same at every size and in both engines.  The present
is AS_OF everywhere.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime(2024, 1, 31)
NOW = "TIMESTAMP '2024-01-31 00:00:00'"

COMPANIES = "Amberra GmbH;amberra;Capco AG;Capco;Bewerbung als Manager;;Nordlicht SE & Co. KG;Nordlicht"
PLACES = "Berlin;Berlin-Mitte;München (Hybrid);Remote;Hamburg, Germany;Köln / Home Office;London, UK;;Frankfurt | Remote;MÜNCHEN;KÖLN, NRW"
URLS = "https://www.example.com/jobs/;https://boards.greenhouse.io/acme/jobs/;https://de.indeed.com/view/;https://jobs.capco.com/"

#: A gazetteer (name, latitude, longitude, population, other names) for the queries over places.
GAZETTEER = [
    ("Berlin", 52.52437, 13.41053, 3426354, "Berlino,BER,Berlín"), ("Hamburg", 53.55073, 9.99302, 1739117, "HAM,Hamburgo"), ("München", 48.13743, 11.57549, 1260391, "Munich,MUC,Muenchen"),
    ("Köln", 50.93333, 6.95, 963395, "Cologne,Koeln"), ("Frankfurt am Main", 50.11552, 8.68417, 650000, "Frankfurt,FRA"), ("Stuttgart", 48.78232, 9.17702, 589793, "STR"),
    ("Düsseldorf", 51.22172, 6.77616, 573057, "Duesseldorf"), ("Leipzig", 51.33962, 12.37129, 504971, ""), ("Dortmund", 51.51494, 7.466, 588462, ""), ("Bremen", 53.07516, 8.80777, 546501, ""),
]

RAW = f"""
SELECT id, CASE WHEN id % 5 = 1 AND company <> '' THEN base || ' - ' || company ELSE base END AS title, url || CAST(id - (id % 6) AS VARCHAR(20)) AS url, company, location, text AS description, '' AS salary, source,
  CASE WHEN id % 10 = 0 THEN '' WHEN id % 7 = 0 THEN CAST(id - 1 AS VARCHAR(20)) ELSE CAST(id AS VARCHAR(20)) END AS external_id,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * CAST(id % 40000 AS INT) AS ingested_at,
  CASE WHEN id % 8 = 1 THEN {NOW} - INTERVAL '1' MINUTE * CAST(id % 90 AS INT) END AS claimed_at,
  split_part('new;refining;refined;rejected;new;duplicate;new;new', ';', CAST(id % 8 + 1 AS INT)) AS status
FROM (
  SELECT doc_id AS id, text, source, left(split_part('Senior ;;Mid-level ;;Lead ;;', ';', CAST(doc_id % 7 + 1 AS INT)) || split_part(text, chr(10), 1), CASE WHEN doc_id % 3 = 0 THEN 64 ELSE 120 END) AS base,
    split_part('{COMPANIES}', ';', CAST(doc_id % 8 + 1 AS INT)) AS company, split_part('{PLACES}', ';', CAST(doc_id % 11 + 1 AS INT)) AS location, split_part('{URLS}', ';', CAST(doc_id % 4 + 1 AS INT)) AS url
  FROM documents
) d
"""

SHELF = f"""
SELECT id, source, CASE WHEN external_id = '' THEN url ELSE external_id END AS external_id, title, url, company, CASE WHEN id % 11 = 0 THEN NULL ELSE split_part('amberra.com;capco.com;nordlicht.com', ';', CAST(id % 3 + 1 AS INT)) END AS company_domain,
  location, CASE WHEN id % 13 = 0 THEN NULL ELSE description END AS description, CASE WHEN id % 7 = 0 THEN NULL ELSE CAST(40000 + (id * 37) % 30000 AS INT) END AS salary_min, CAST(60000 + (id * 53) % 50000 AS INT) AS salary_max,
  CASE WHEN id % 4 = 0 THEN NULL ELSE split_part('Berlin;Hamburg;München', ';', CAST(id % 3 + 1 AS INT)) END AS location_normalized,
  CASE WHEN id % 4 = 0 THEN NULL ELSE 47.0 + CAST(id % 700 AS DOUBLE) / 100 END AS location_lat, CASE WHEN id % 4 = 0 THEN NULL ELSE 7.0 + CAST(id % 650 AS DOUBLE) / 100 END AS location_lon,
  location LIKE '%Remote%' AS is_remote, id % 5 = 0 AS flagged, ingested_at AS posted_at,
  {NOW} - INTERVAL '1' HOUR * CAST(id % 1000 AS INT) AS scraped_at, {NOW} - INTERVAL '1' HOUR * CAST(id % 900 AS INT) AS last_seen_at, {NOW} - INTERVAL '1' HOUR * CAST(900 + id % 300 AS INT) AS first_seen_at,
  CASE WHEN id % 17 = 0 THEN 'expired' ELSE 'active' END AS status
FROM ({RAW}) r WHERE id % 2 = 0
"""

RUNS = """
SELECT event_id AS id, 'source' || CAST(user_id % 25 AS VARCHAR(20)) AS source, ts AS started_at, ts + INTERVAL '5' MINUTE AS finished_at,
  CASE event_type WHEN 'view' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, CAST(floor(value) AS BIGINT) AS n,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE '{"refined": ' || CAST(event_id % 50 AS VARCHAR(20)) || ', "duplicate": ' || CAST(event_id % 7 AS VARCHAR(20)) || ', "rejected": ' || CAST(event_id % 3 AS VARCHAR(20)) || ', "jobs_stored": ' || CAST(event_id % 90 AS VARCHAR(20)) || '}' END AS stats,
  CAST(NULL AS VARCHAR(20)) AS error
FROM events
"""

JOBS_OF_BOARDS = f"""
SELECT split_part('recruitee;breezy;greenhouse;lever', ';', CAST(id % 4 + 1 AS INT)) AS source, 'board' || CAST((id * 7) % 60 AS VARCHAR(20)) AS slug, CASE WHEN id % 6 = 0 THEN 'de' WHEN id % 6 = 1 THEN 'AT' ELSE '' END AS country,
  location AS place, id % 9 = 2 AS remote FROM ({RAW}) r
"""

#: Companies that are being watched, in the spelling of the watch list.
WATCHLIST = f"SELECT DISTINCT upper(company) AS company FROM ({RAW}) r WHERE company LIKE 'Capco%'"

TABLES = {"raw": RAW, "watchlist": WATCHLIST, "shelf": SHELF, "runs": RUNS, "board_jobs": JOBS_OF_BOARDS}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The engine's tables of these names."""
    return [spark.sql(_for_spark(TABLES[n]), **{s: spark.read.parquet(f"{sf_dir}/{s}.parquet") for s in ("documents", "events") if f"FROM {s}" in TABLES[n]}) for n in names]


def _for_spark(sql: str) -> str:
    """Spark takes tables as arguments in braces; other braces are doubled."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for s in ("documents", "events"):
        sql = sql.replace(f"FROM {s}", f"FROM {{{s}}}")
    return sql


def with_tables(*names: str) -> str:
    """The WITH clause of the same tables for DuckDB, to be followed by more of its parts or a query."""
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n]})" for n in names) + " "


def full_shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shelf with all columns of its schema."""
    (shelf,) = tables(spark, sf_dir, "shelf")
    return shelf.withColumns({
        "dq_flags": F.when(F.col("flagged"), F.create_map(F.lit("boilerplate_short"), F.lit(True))).otherwise(F.create_map().cast("map<string,boolean>")),
        "keywords": F.array("source"), "metadata": F.lit(None).cast("string"), "is_hybrid": F.contains(F.lower("location"), F.lit("hybrid")), "content_hash": F.lit(None).cast("string"),
    }).drop("flagged")

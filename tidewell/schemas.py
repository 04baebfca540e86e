"""The engine's tables."""

from __future__ import annotations

RAW = "id long, title string, url string, company string, location string, description string, salary string, source string, external_id string, posted_at timestamp, ingested_at timestamp, claimed_at timestamp, content_hash string, status string"
SHELF = (
    "id long, source string, external_id string, title string, url string, company string, company_domain string, location string, description string, salary_min int, salary_max int, keywords array<string>, "
    "dq_flags map<string,boolean>, metadata string, location_normalized string, location_lat double, location_lon double, is_remote boolean, is_hybrid boolean, content_hash string, posted_at timestamp, "
    "first_seen_at timestamp, last_seen_at timestamp, scraped_at timestamp, status string"
)
MEMORY = "content_hash string, band int, band_hash string, seen_at timestamp"
FETCHES = "source_name string, fetch_key string, checksum string, last_fetched_at timestamp, last_changed_at timestamp"
RUNS = "id long, source string, started_at timestamp, finished_at timestamp, status string, stats string, error string"
REGISTRY = "source string, slug string, origin string, seen_in_crawls array<string>, status string, monitor boolean, initial_job_count int, last_job_count int, de_flag string, sample_titles array<string>"
GAZETTEER = "name string, lat double, lon double, population long, alternate_names string"
#: What every source adapter returns.
POSTING = "title string, url string, company string, location string, description string, salary string, source string, external_id string, posted_at timestamp"

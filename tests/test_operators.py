from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell import schemas
from tidewell.operators import dedup, lifecycle, location, metrics, nearsim, quality, registry, search
from tidewell.plans import catalog, refine

NOW = datetime(2024, 1, 31)
JOB = "id long, title string, url string, company string, description string, source string, external_id string, content_hash string"


def ids(df):
    return sorted(r.id for r in df.collect())


def jobs(spark, rows):
    return spark.createDataFrame(rows, JOB)


def job(i, title="T", url=None, company="C", external_id=None, hashed=None):
    return (i, title, f"u{i}" if url is None else url, company, "d", "s", f"e{i}" if external_id is None else external_id, f"h{i}" if hashed is None else hashed)


def test_shelf_tiers(spark):
    shelf = jobs(spark, [job(100, external_id="x", url="y", hashed="z")])
    batch = jobs(spark, [job(1, external_id="x"), job(2, url="y"), job(3, hashed="z"), job(4), job(5, external_id="", url="")])
    assert ids(dedup.known_on_shelf(batch, shelf)) == [1, 2, 3]


def test_keys_are_passed_one_after_the_other(spark):
    """Not a closure: C shares an address only with B, which the first pass has dropped."""
    batch = jobs(spark, [job(1, external_id="e1", url="u1"), job(2, external_id="e1", url="u2"), job(3, external_id="e3", url="u2"), job(4, external_id="", url="", hashed=""), job(5, external_id="", url="", hashed="")])
    assert ids(dedup.first_of_each_key(batch)) == [1, 3, 4, 5]


def test_cut_titles_in_a_batch(spark):
    long = "Senior Consultant for Digital Transformation and Asset Management in Frankfurt"
    cut = long[:64]
    batch = jobs(spark, [job(1, cut, company="Bewerbung als X"), job(2, long, company="Capco"), job(3, cut, company="Capco GmbH"), job(4, cut, company="Other"), job(5, long + " am Main", company="Zed"), job(6, cut.upper(), company="")])
    assert ids(dedup.cut_in_batch(batch)) == [1]  # the keeper is 5 of Zed; only the one without a company is compatible
    cities = jobs(spark, [job(i, long[:64] + f" City {i}", company="One") for i in range(3)])
    assert ids(dedup.cut_in_batch(cities)) == []


def test_prefix_probe_ignores_case(spark):
    long = "Senior Consultant for Digital Transformation and Asset Management in Frankfurt"
    shelf = jobs(spark, [job(9, long.upper())])
    batch = jobs(spark, [job(1, long[:64]), job(2, long), job(3, long, company=""), job(4, long[:63])])
    assert ids(dedup.prefix_on_shelf(batch, shelf)) == [1, 3]


def test_required_bands():
    assert nearsim.required_bands() == 21
    for bad in ((128, 3, 0.9), (128, 4, 0.0), (0, 1, 0.5)):
        with pytest.raises(ValueError):
            nearsim.required_bands(*bad)


def test_near_duplicates_and_memory(spark):
    text = "We look for a data engineer with a love for pipelines. " * 10
    bands = nearsim.band_hashes(spark.createDataFrame([(1, text), (2, text + "!"), (3, "something else entirely, about cooking and gardens"), (4, ""), (5, None)], "id long, text string"))
    assert bands.filter("id >= 4").count() == 0
    remember = lambda days: bands.filter("id = 1").select(F.lit("h").alias("content_hash"), "band", "band_hash", F.lit(NOW - timedelta(days=days)).alias("seen_at"))
    assert ids(nearsim.near_duplicates(bands, remember(1), F.lit(NOW))) == [1, 2]
    assert ids(nearsim.near_duplicates(bands, remember(11), F.lit(NOW))) == []
    assert nearsim.remembered(remember(1), remember(0)).count() == 32 and nearsim.forgotten(remember(11), F.lit(NOW)).count() == 0


def test_rules(spark):
    rows = spark.createDataFrame([("T", "u", "x" * 300), ("T", "u", "short"), (" ", "", None)], "title string, url string, description string")
    before, after = date(2026, 4, 28), date(2026, 4, 29)
    rules = quality.Rules(flag=("boilerplate_short", "no_description", "no_such_rule"))
    got = [(r.dq_flags, r.verdict) for r in quality.classified(rows, rules, after).collect()]
    assert got == [({}, "keep"), ({"boilerplate_short": True}, "keep"), ({"no_description": True, "no_title": True, "no_url": True}, "reject")]
    assert {r.verdict for r in quality.classified(rows, rules, before).collect()} == {"keep"}
    assert quality.Rules.activation_date(" 2026-04-29\n", before) == after and quality.Rules.activation_date(None, before) == date(2026, 5, 5)
    with pytest.raises(ValueError):
        quality.Rules.activation_date("soon", before)


def test_title_gate(spark):
    df = spark.createDataFrame([("Ab",), (" a ",), ("--",), ("",), (None,), ("日本語",), ("C#",)], "t string")
    assert [r[0] for r in df.select(quality.title_passes(F.col("t"))).collect()] == [True, False, False, False, False, False, True]


def test_descriptions_are_filled(spark):
    rows = jobs(spark, [(i, "T", u, "C", d, "s", str(i), str(i)) for i, u, d in [(1, "http://a/1", "thin"), (2, "http://a/2", "thin"), (3, "http://t.bad.com/3", "thin"), (4, "http://a/4", "y" * 250), (5, "http://a/5", "thin")]])
    fetched = spark.createDataFrame([("http://a/1", "z" * 400), ("http://a/2", "z" * 200), ("http://t.bad.com/3", "z" * 400), ("http://a/4", "z" * 400), ("http://a/5", "captcha" * 99)], "url string, fetched string")
    assert [len(r.description) for r in quality.filled_in(rows, fetched, ["bad.com"]).orderBy("id").collect()] == [400, 4, 4, 250, 4]


def test_places(spark):
    index = catalog._index(spark)
    rows = [(1, "Berlin"), (2, "Berlin-Mitte"), (3, "Munich (Hybrid)"), (4, "Nowhere"), (5, None), (6, "BER"), (7, "Home Office | KOELN"), (8, "frankfurt")]
    got = {r.id: r for r in location.located(spark.createDataFrame(rows, "id long, location string"), index).collect()}
    assert [got[i].location_normalized for i in range(1, 9)] == ["Berlin", "Berlin", "München", None, None, None, "Köln", "Frankfurt am Main"]
    assert got[3].is_hybrid and got[7].is_remote and not got[5].is_remote


def test_gazetteer_lines(spark):
    line = lambda name, kind, pop, lat="1.0": "\t".join(["1", name, name, "alt", lat, "2.0", kind, *["x"] * 7, pop])
    lines = [(line("A", "P", "5"),), (line("B", "P", "9"),), (line("C", "H", "99"),), (line("D", "P", "many"),), ("short\tline",), (line("E", "P", "7", "x"),)]
    assert [r.name for r in location.top_places(spark.createDataFrame(lines, "value string"), 5).collect()] == ["B", "A"]


def shelf_row(spark, **over):
    base = {f.name: None for f in spark.createDataFrame([], schemas.SHELF).schema} | {"id": 1, "title": "Agile Coach", "description": "a coach for teams", "location": "Berlin", "status": "active", "scraped_at": NOW, "keywords": [], "dq_flags": {}} | over
    return spark.createDataFrame([base], schemas.SHELF)


@pytest.mark.parametrize(("spec", "found"), [
    ({"keywords": ["agile coach"]}, True), ({"keywords": ["coaching"]}, False), ({"keywords": ['"coach agile"']}, False), ({"keywords": ['"agile coach"']}, True), ({"keywords": ["teams agile"]}, False),
    ({"keywords": ["for teams"]}, True), ({"keywords": ["  "]}, False), ({"without": ["COACH"]}, False), ({"location": "ber"}, True), ({"location": "b_r"}, True), ({"seniority": "agile"}, True), ({"seniority": "senior"}, False),
    ({"min_salary": 1}, False), ({"exclude_domains": ["x"]}, True), ({"exclude_domains": ["x"], "legacy": True}, False), ({"max_age_days": 0}, True), ({"sources": ["a"]}, False),
])
def test_search_filters(spark, spec, found):
    assert (search.hits(shelf_row(spark), search.Search(NOW, **spec)).count() == 1) is found


def test_negative_terms_and_null_descriptions(spark):
    row = shelf_row(spark, description=None)
    assert search.hits(row, search.Search(NOW, without=["remote"])).count() == 1
    assert search.hits(row, search.Search(NOW, without=["remote"], legacy=True)).count() == 0


def test_pages_and_totals(spark):
    shelf = shelf_row(spark).drop("id").crossJoin(spark.range(30).withColumnRenamed("id", "id")).withColumn("title", F.when(F.col("id") < 5, "agile agile").otherwise("none")).withColumn("description", F.lit("agile"))
    spec = search.Search(NOW, keywords=["agile"], limit=4, offset=3)
    assert [r.id for r in search.page(shelf, spec).collect()] == [3, 4, 5, 6] and search.total(shelf, spec).first()[0] == 30
    with pytest.raises(ValueError):
        search.Search(NOW, limit=501)
    with pytest.raises(ValueError):
        search.Search(NOW, max_distance_km=5)


def test_distance(spark):
    near, far = shelf_row(spark, location_lat=52.5, location_lon=13.4), shelf_row(spark, id=2, location_lat=48.1, location_lon=11.6)
    rows = near.unionByName(far).unionByName(shelf_row(spark, id=3))
    assert ids(search.hits(rows, search.Search(NOW, location="Berlin", max_distance_km=50))) == [1]
    assert ids(search.hits(rows, search.Search(NOW, location="Ber", max_distance_km=50))) == [1]


def test_shown(spark):
    got = search.shown(shelf_row(spark, description="x" * 501)).first()
    assert got.description == "x" * 500 + "..." and got.posted_at == NOW and got.remote is False and got.url == ""
    assert search.shown(shelf_row(spark, description="x" * 500)).first().description == "x" * 500


def test_claims(spark):
    rows = [(1, "b", "new", NOW), (2, "a", "new", NOW), (3, "c", "new", NOW), (4, "a", "refined", NOW), (5, "b", "new", NOW - timedelta(days=1))]
    inbox = spark.createDataFrame(rows, "id long, source string, status string, ingested_at timestamp").withColumn("claimed_at", F.lit(None).cast("timestamp"))
    batch = lifecycle.claimed(inbox, 3, ["a"], ["c"])
    assert [r.id for r in batch.collect()] == [2, 5, 1]
    taken = lifecycle.after_claim(inbox, batch, NOW)
    assert ids(taken.filter("status = 'refining'")) == [1, 2, 5]
    assert ids(lifecycle.released(taken, NOW + timedelta(seconds=1801)).filter("status = 'new'")) == [1, 2, 3, 5]
    assert ids(lifecycle.released(taken, NOW + timedelta(seconds=1799)).filter("status = 'new'")) == [3]


def test_upsert_keeps_first_seen(spark):
    old = shelf_row(spark, source="s", external_id="1", first_seen_at=datetime(2024, 1, 1), status="expired")
    new = spark.createDataFrame([(7, "s", "1", "New"), (8, "s", "2", "Other")], "id long, source string, external_id string, title string")
    got = {r.external_id: r for r in lifecycle.shelf_upserted(old, new, NOW).collect()}
    assert got["1"].first_seen_at == datetime(2024, 1, 1) and got["1"].id == 1 and got["1"].title == "New" and got["1"].status == "active" and got["1"].last_seen_at == NOW
    assert got["2"].first_seen_at == NOW and len(got) == 2


def test_retention(spark):
    rows = [(1, "Kept Co", NOW - timedelta(days=30)), (2, "Gone", NOW - timedelta(days=30)), (3, "New", NOW), (4, None, NOW - timedelta(days=30)), (5, "Gone", None)]
    shelf = spark.createDataFrame(rows, "id long, company string, last_seen_at timestamp")
    assert ids(lifecycle.retained(shelf, spark.createDataFrame([("KEPT CO",)], "company string"), NOW)) == [1, 3, 5]


def test_cadence(spark):
    runs = spark.createDataFrame([("a", "done", NOW - timedelta(hours=5)), ("b", "failed", NOW - timedelta(hours=1)), ("c", "done", NOW - timedelta(hours=30))], "source string, status string, started_at timestamp")
    due = lambda **how: {r.source for r in lifecycle.due_sources(runs, runs, NOW, **how).filter("due").collect()}
    assert due(least_hours=6) == {"b", "c"} and due(least_hours=4) == {"a", "b", "c"} and due(anchor_hour=18) == {"b", "c"} and due(anchor_hour=20) == {"a", "b", "c"}


def test_flow_figures(spark):
    runs = lambda *rows: spark.createDataFrame([(s, NOW) for s in rows], "stats string, finished_at timestamp")
    refined = runs('{"refined": 200, "duplicate": 50, "rejected": 10}', '{"refined": 45, "duplicate": 20, "rejected": 2}', None)
    got = metrics.flow(refined, runs('{"jobs_stored": 6380}', None), NOW + timedelta(hours=1)).first()
    assert tuple(got) == (245, 82, 0.25, 6380)
    assert tuple(metrics.flow(runs(), runs(), NOW).first()) == (0, 0, 0.0, 0)


def test_coverage_of_nothing(spark):
    empty = spark.createDataFrame([], schemas.SHELF)
    assert tuple(metrics.coverage(empty, NOW).first()) == (0, 0.0, 0.0, 0)


def test_slugs(spark):
    urls = [("https://acme.jobs.personio.de/x", "personio"), ("https://boards.greenhouse.io/embed/job_board?for=Acme", "greenhouse"), ("https://boards.greenhouse.io/api/x", "greenhouse"), ("https://jobs.lever.co/Acme-", "lever"), ("https://x.y/", "lever"), ("https://personio.de", "personio")]
    got = [spark.createDataFrame([(u,)], "u string").select(registry.slug_of_url(F.col("u"), p)).first()[0] for u, p in urls]
    assert got == ["acme", "acme", None, "acme", None, None]


def test_folding(spark):
    df = spark.createDataFrame([("a", "foreign"), ("a", "remote"), ("b", "foreign"), ("b", "de"), ("c", None)], "k string, c string")
    assert {r.k: r.f for r in df.groupBy("k").agg(registry.folded(F.col("c")).alias("f")).collect()} == {"a": "remote", "b": "de", "c": None}


def test_refine_ends_every_row_and_is_idempotent(spark):
    raw = [(i, t, f"http://h/{i}", c, "Berlin", d, "", "s", e) for i, t, c, d, e in [
        (1, "Engineer", "A GmbH", "we build things " * 20, "1"), (2, "Engineer", "A", "other text " * 30, "2"), (3, "", "B", "x" * 300, "3"), (4, "--", "D", "y" * 300, "4"), (5, "Analyst", "C", "numbers and tables " * 20, ""),
    ]]
    batch = spark.createDataFrame(raw, "id long, title string, url string, company string, location string, description string, salary string, source string, external_id string").withColumn("posted_at", F.lit(None).cast("timestamp"))
    shelf, memory = spark.createDataFrame([], schemas.SHELF), spark.createDataFrame([], schemas.MEMORY)
    settings = refine.Settings(NOW, rules=quality.Rules(activation=date(2024, 1, 1)))
    run = lambda s, m: refine.refine(batch, s, m, catalog._index(spark), spark.createDataFrame([], "url string, fetched string"), settings)
    first = run(shelf, memory)
    assert {r.id: r.outcome for r in first.outcomes.collect()} == {1: "refined", 2: "duplicate", 3: "rejected", 4: "rejected", 5: "refined"}
    assert {r.external_id for r in first.shelf.collect()} == {"1", "http://h/5"} and first.memory.count() == 64
    again = run(spark.createDataFrame(first.shelf.collect(), schemas.SHELF), spark.createDataFrame(first.memory.collect(), schemas.MEMORY))
    assert {r.outcome for r in again.outcomes.filter("id IN (1, 2, 5)").collect()} == {"duplicate"} and again.jobs.count() == 0

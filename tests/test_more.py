import hashlib
import json
import random
import unicodedata
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions import values as V
from tidewell.operators import companies, lifecycle, location, nearsim, search
from tidewell.sources import flags, sinks

NOW = datetime(2024, 1, 31)
PROFILE = "domain string, name string, size string, industry string, location string, linkedin string, details string"


def test_unaccented_is_nfkd(spark):
    samples = ["Köln", "ŁÓDŹ", "ﬁne ½ Ⅷ", "Ｔｏｋｙｏ", "ø ß", "áè", "Ǆ ŉ ĳ", "㎏ ™", "中文 한글", "", "ﷺ"]
    bare = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))
    got = [r.x for r in spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string").orderBy("i").select(T.unaccented(F.col("s")).alias("x")).collect()]
    assert got == [bare(s) for s in samples]


def test_shared_bands_against_brute_force(spark):
    """Copies, near copies and hot bands: the most bands that one remembered document shares."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abcde ") for _ in range(200)) for _ in range(4)]
    texts = [b if rng.random() < 0.5 else b[:190] + "".join(rng.choice("xyz") for _ in range(10)) for b in base for _ in range(30)] + ["ab", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    bands = nearsim.band_hashes(docs).persist()
    memory = bands.filter("id % 3 = 0").select(F.concat(F.lit("h"), "id").alias("content_hash"), "band", "band_hash", F.when(F.col("id") % 2 == 0, F.lit(NOW)).otherwise(F.lit(datetime(2023, 1, 1))).alias("seen_at"))
    got = {r.id: r.shared for r in nearsim.shared_bands(bands, memory, F.lit(NOW)).collect()}

    def signature(text):
        text = " ".join(text.lower().split())
        grams = [text[i : i + 5] for i in range(max(1, len(text) - 4))]
        hashes = set()
        for g in grams:
            h = 0
            for c in g:
                h = (h * nearsim.BASE + ord(c)) % nearsim.PRIME
            hashes.add(h)
        low = [min((a * h + b) % nearsim.PRIME for h in hashes) for a, b in nearsim.lanes()]
        return [hashlib.md5("-".join(map(str, low[i : i + 4])).encode()).hexdigest() for i in range(0, 128, 4)]

    signatures = {i: signature(t) for i, t in enumerate(texts) if t}
    assert {(r.id, r.band): r.band_hash for r in bands.collect()} == {(i, b): h for i, s in signatures.items() for b, h in enumerate(s)}
    want = {i: max(sum(x == y for x, y in zip(s, signatures[j])) for j in signatures if j % 6 == 0) for i, s in signatures.items()}
    assert got == {i: n for i, n in want.items() if n}


def test_chain_of_enrichers(spark):
    table = spark.createDataFrame([(f"d{i}", f"n{i}", "1", "i", "l", "", "{}") for i in range(4)], PROFILE)
    answer = lambda i, **data: (f"d{i}", 200, json.dumps({"data": data}))
    answers = spark.createDataFrame([answer(0, name="New", metrics={"employees": 12}, tags=["a", "b"], linkedin={"handle": "h"}, geo={"country": "DE"}), ("d1", 404, ""), ("d2", 500, "oops"), answer(3, metrics={"employees": 0}, tags=[])], "domain string, status int, body string")
    found = companies.attributes(answers)
    assert {r.domain: r.failed for r in found.collect()} == {"d0": False, "d1": False, "d2": True, "d3": False}
    more = found.select("domain", F.lit(False).alias("failed"), F.lit("last").alias("name"), *[F.lit(None).cast("string").alias(a) for a in companies.ATTRIBUTES[1:]])
    for optional, last in ((True, "last"), (False, "n2")):
        steps = [companies.Step("a", found, optional=optional), companies.Step("b", more, requires=("a",))]
        got = {r.domain: r for r in companies.enriched(table, steps).collect()}
        assert got["d2"].name == last and got["d1"].name == got["d0"].name == "last"
    assert (got["d0"].size, got["d0"].industry, got["d0"].linkedin, json.loads(got["d0"].details)["country"]) == ("12", "a, b", "https://linkedin.com/h", "DE")
    assert (got["d3"].size, got["d3"].industry) == ("1", "i")
    with pytest.raises(ValueError):
        companies.enriched(table, [companies.Step("b", more, requires=("a",))])


def test_flags_of_feeds(spark):
    feed = lambda provider, body: flags.feed_flags(spark.createDataFrame([("s", body if isinstance(body, str) else json.dumps(body))], "slug string, body string"), provider).first().de_flag
    assert feed("greenhouse", {"jobs": [{"location": {"name": "Paris"}}, {"location": {"name": "Berlin"}}]}) == "de" and feed("greenhouse", {"jobs": []}) is None and feed("greenhouse", "oops") is None
    assert feed("ashby", {"jobs": [{"location": "Lisbon", "secondaryLocations": [{"location": "München"}]}]}) == "de" and feed("ashby", {"jobs": [{"isRemote": True}]}) == "remote"
    assert feed("breezy", [{"location": {"country": {"id": "us"}}, "locations": [{"country": {"id": "de"}}]}]) == "de" and feed("breezy", {"error": 1}) is None
    assert feed("recruitee", {"offers": [{"remote": True}, {"country_code": "fr", "remote": True}]}) == "remote" and feed("lever", [{"categories": None}]) == "foreign"
    assert feed("personio", "<x><position><office>Hamburg</office></position></x>") == "de" and feed("workday", "{}") is None


def test_flags_recovered_from_samples(spark):
    maps = spark.createDataFrame([("a", "<loc>https://a/job_posting/dev-munich-12</loc><loc>https://a/about</loc>"), ("b", "<loc>https://b/job_posting/dev-1</loc>" * 2 + "<loc>https://b/job_posting/ops-9</loc>"), ("c", "")], "slug string, body string")
    pages = spark.createDataFrame([("https://b/job_posting/dev-1", "x 📍 <b>Remote</b> · y"), ("https://b/job_posting/ops-9", "📍 Berlin | z")], "url string, html string")
    assert {r.slug: r.de_flag for r in flags.recovered_flags(maps, pages).collect()} == {"a": "de", "b": "de"}
    assert {r.slug: r.de_flag for r in flags.recovered_flags(maps, pages, 1).collect()} == {"a": "de", "b": "remote"}


def test_inbox_batches_run_again(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "id long, source string, external_id string")
    folder = str(tmp_path / "inbox")
    first, second = frame([(1, "s", "a"), (2, "s", "a"), (3, "s", ""), (4, "t", "a")]), frame([(5, "s", "a"), (6, "s", "b"), (7, "s", "")])
    for _ in range(2):
        assert sorted(r.id for r in sinks.append_inbox(first, folder, 0).collect()) == [1, 3, 4]
        assert sorted(r.id for r in sinks.append_inbox(second, folder, 1).collect()) == [6, 7]


def test_exports(spark, tmp_path):
    found = spark.createDataFrame([("b", 2, ["x", "", "y"]), ("a", 2, ["t" * 200]), ("c", None, [])], "slug string, job_count int, sample_titles array<string>")
    folder = str(tmp_path / "out")
    sinks.export_enumeration(found, folder)
    assert [r.value for r in spark.read.text(f"{folder}/items").collect()] == [f"  - a  # 2 jobs: {'t' * 120}", "  - b  # 2 jobs: x; y", "  - c"]
    assert spark.read.json(f"{folder}/json").count() == 3 and spark.read.option("header", True).csv(f"{folder}/sheet").filter("slug = 'b'").first().sample_titles == "x; y"
    lines = spark.createDataFrame([(0, "# head"), (1, "z "), (2, "# more"), (3, "")], "no int, line string")
    assert [r.line for r in sinks.curated(lines, spark.createDataFrame([("a",), ("z",), ("#x",)], "slug string")).orderBy("place").collect()] == ["# head", "# more", "a", "z"]


def test_copy_of_the_predecessor_is_repeatable(spark):
    shelf = spark.createDataFrame([(1, "s", "a", "old", NOW, NOW, "expired")], "id long, source string, external_id string, title string, first_seen_at timestamp, last_seen_at timestamp, status string")
    v1 = spark.createDataFrame([("s", "a", "new", NOW, None), ("s", "b", "more", None, True)], "source string, external_id string, title string, scraped_at timestamp, is_remote boolean")
    once = lifecycle.copied(v1, shelf, NOW)
    assert sorted(map(tuple, once.select("id", "external_id", "title", "status").collect()), key=str) == [(1, "a", "new", "active"), (None, "b", "more", "active")]
    assert sorted(map(str, lifecycle.copied(v1, once, NOW).collect())) == sorted(map(str, once.collect()))
    assert [r.is_remote for r in lifecycle.v1_as_v2(v1, NOW).orderBy("external_id").collect()] == [False, True]


def test_words_are_found_as_tokens(spark):
    terms = search.parsed_terms(["agile coach", '"data science" lead', "über"])
    texts = ["Coach, agile!", "agility coach", "data-science LEAD", "data and science lead", "ÜBER uns", "überall", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    assert [r.m for r in rows.select(search.matches(F.col("t"), terms).alias("m")).collect()] == [True, False, True, False, True, False, False, False]


def test_fallback_places(spark):
    index = location.place_index(location.fallback(spark))
    jobs = spark.createDataFrame([(1, "Hamm"), (2, "Mulheim an der Ruhr"), (3, "Nowhere")], "id long, location string")
    assert {r.id: r.location_normalized for r in location.located(jobs, index).collect()} == {1: "Hamm", 2: "Mülheim an der Ruhr", 3: None}


def test_rank_of_titles(spark):
    """Figures worked out by hand from the formulas of ts_rank."""
    rank = lambda title, *terms: spark.createDataFrame([(title,)], "t string").select(search.rank(search.places_in(T.words(F.col("t"))), search.parsed_terms(list(terms))).alias("r")).first().r
    one = 0.1 / 1.64493406685
    assert abs(rank("agile coach", "agile", "coach") - one) < 1e-12 and abs(rank("agile agile", "agile") - one * 1.25) < 1e-12 and abs(rank("agile", "agile", "coach") - one / 2) < 1e-12
    near = lambda d: 0.1 * (1 / (1.005 + 0.05 * 2.718281828459045 ** (d / 1.5 - 2))) ** 0.5
    assert abs(rank("agile coach", "agile coach") - near(1)) < 1e-12 and abs(rank("agile x coach y agile", "agile coach") - (1 - (1 - near(2)) ** 2)) < 1e-12


def test_rolling_flow(spark, tmp_path):
    from tidewell.streaming import inbox

    runs = [(datetime(2024, 1, 1, h), f'{{"refined": {h}, "duplicate": 1, "jobs_stored": 2}}') for h in (0, 5, 23)] + [(datetime(2024, 1, 2, 3), None)]
    spark.createDataFrame(runs, "finished_at timestamp, stats string").write.parquet(str(tmp_path / "runs"))
    stream = inbox.rolling_flow(spark.readStream.schema("finished_at timestamp, stats string").parquet(str(tmp_path / "runs")))
    query = stream.writeStream.format("memory").queryName("flow").outputMode("complete").option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["window"].end: (r.throughput, r.waste, r.arrivals) for r in spark.table("flow").collect()}
    assert got[datetime(2024, 1, 2)] == (28, 3, 6) and got[datetime(2024, 1, 2, 1)] == (28, 2, 4) and got[datetime(2024, 1, 2, 4)] == (28, 2, 4)


def test_unaccented_over_the_basic_plane(spark):
    """Every character that Spark and Python lower-case alike, Hangul syllables among them."""
    rows = [(c, f"a{chr(c)}b") for c in range(0x20, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    got = {r.c: (r.low, r.x) for r in spark.createDataFrame(rows, "c int, t string").select("c", F.lower("t").alias("low"), T.unaccented(F.col("t")).alias("x")).collect()}
    bare = lambda s: "".join(x for x in unicodedata.normalize("NFKD", s) if not unicodedata.combining(x))
    assert [c for c, t in rows if got[c][1] != bare(got[c][0])] == []
    assert got[0xD55C][1] == "a" + unicodedata.normalize("NFKD", "한") + "b"


def test_rounding_is_that_of_python(spark):
    rng = random.Random(14)
    values = [2.675, 1.005, 0.125, 0.375, 2.5, 0.5, 1.5, -2.675, -0.125, 0.0, 1e15 + 0.3, 1e300, 123456.785, 99.995, 0.045, 1 / 3, None, float(2**53)]
    values += [rng.randrange(10**6) / 1000 for _ in range(3000)] + [(2 * rng.randrange(10**5) + 1) / 2**k for k in range(1, 12) for _ in range(50)] + [rng.uniform(-1e7, 1e7) for _ in range(1000)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    for digits in (0, 1, 2, 4):
        got = [r.x for r in rows.select(V.rounded(F.col("v"), digits).alias("x")).collect()]
        assert [(v, g) for v, g in zip(values, got) if g != (None if v is None else float(round(v, digits)))] == []


def test_a_band_of_many_unlike_documents_sends_few_pairs(spark):
    """5,000 unlike texts share a band; pairs that share enough are found all the same."""
    n, bands = 5_000, 32
    docs = spark.range(n).select("id", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    # Documents 4k and 4k + 1 share 21 bands besides, 4k + 2 and 4k + 3 share 20.
    group, most = F.floor(F.col("id") / 2), F.when(F.col("id") % 4 < 2, 22).otherwise(21)
    docs = docs.withColumn("band_hash", F.when(F.col("band") == 0, "everywhere").when(F.col("band") < most, F.concat_ws("-", F.lit("pair"), group, "band")).otherwise(F.concat_ws("-", F.lit("own"), "id", "band")))
    memory = docs.filter("id % 2 = 0").select(F.concat(F.lit("h"), "id").alias("content_hash"), "band", "band_hash", F.lit(NOW).alias("seen_at")).persist()
    probes = docs.filter("id % 2 = 1").persist()
    pairs = nearsim.candidate_pairs(probes, memory.drop("seen_at"), 21).count()
    assert pairs <= n
    got = {r.id: r.shared for r in nearsim.shared_bands(probes, memory, F.lit(NOW), least=21).collect()}
    assert got == {i: 22 for i in range(1, n, 4)} | {i: 21 for i in range(3, n, 4)}


def test_bands_are_the_least_of_linear_hashes(spark):
    """Lanes in blocks give what the rule says, at the ends of its range as well."""
    import numpy as np

    rng = np.random.default_rng(2)
    a, b = (np.array(x, np.int64) for x in zip(*nearsim.lanes()))
    for h in (np.array([0]), np.array([nearsim.PRIME - 1]), np.unique(rng.integers(0, nearsim.PRIME, 5_000)), (-b * pow(int(a[0]), -1, nearsim.PRIME)) % nearsim.PRIME):
        want = [min((int(x) * int(v) + int(y)) % nearsim.PRIME for v in h) for x, y in zip(a, b)]
        assert nearsim.minima(h, a, b).tolist() == want


def test_documents_of_several_texts_share_bands(spark):
    """A hash that was remembered with two texts has more bands than one text; what it shares with either counts."""
    rows = [(1, b, f"a{b}") for b in range(32)] + [(2, b, f"z{b}" if b > 20 else f"c{b}") for b in range(32)]
    held = [("h", b, f"{x}{b}", NOW) for b in range(32) for x in ("c", "y")] + [(f"n{i}", b, f"c{b}", NOW) for i in range(9) for b in range(21)]
    bands, memory = spark.createDataFrame(rows, "id long, band int, band_hash string"), spark.createDataFrame(held, "content_hash string, band int, band_hash string, seen_at timestamp")
    assert {r.id: r.shared for r in nearsim.shared_bands(bands, memory, F.lit(NOW), least=21).collect()} == {2: 21}

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell import schemas
from tidewell.operators import lifecycle, nearsim, quality
from tidewell.plans import catalog, refine
from tidewell.streaming import inbox, shelf

NOW = datetime(2024, 1, 31)


def test_draining_batch_by_batch(spark, tmp_path):
    """Alike descriptions in one batch both stay; in two batches the second goes."""
    text = "we build data pipelines for the whole company and its many customers " * 6
    rows = [(1, "Engineer", text), (2, "Other title", text + "!"), (3, "Third title", text + "?")]
    frame = spark.createDataFrame([(i, t, f"http://h/{i}", f"Co{i}", "Berlin", d, "", "s", str(i), NOW, NOW, None, None, "new") for i, t, d in rows], schemas.RAW)
    path, folder = str(tmp_path / "in"), str(tmp_path / "state")
    frame.filter("id <= 2").coalesce(1).write.parquet(path)
    settings = refine.Settings(NOW, rules=quality.Rules(activation=date(2024, 1, 1)))
    inbox.drained(path, folder, catalog._index, settings, spark).awaitTermination()
    frame.filter("id = 3").coalesce(1).write.mode("append").parquet(path)
    inbox.drained(path, folder, catalog._index, settings, spark).awaitTermination()
    outcome = lambda no: {r.id: r.outcome for r in spark.read.parquet(f"{folder}/outcomes/{no}").collect()}
    assert outcome(0) == {1: "refined", 2: "refined"} and outcome(1) == {3: "duplicate"}
    assert shelf.read(spark, f"{folder}/shelf", 2, schemas.SHELF).count() == 2


def test_memory_of_keys(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = spark.createDataFrame([("a", NOW), ("a", NOW + timedelta(days=1)), ("b", NOW)], "k string, ts timestamp")
    rows.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    q = inbox.first_within(stream, ["k"], "ts").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(r.k for r in spark.table("firsts").collect()) == ["a", "b"]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_changes_and_their_expiry(spark, tmp_path, rocks):
    """Each start is a restart: state and timers come from the checkpoint.  A key left alone for long is told to expire, and is new when it comes again."""
    path = str(tmp_path / "in")
    bodies = [("s", "k", "one", 0), ("s", "k", "one", 1), ("s", "k", "two", 2), ("s", "l", "one", 20 * 24), ("s", "l", "one", 36 * 24), ("s", "k", "two", 37 * 24), ("s", "l", "three", 38 * 24)]
    for no, (source, key, body, hours) in enumerate(bodies):
        row = [(source, key, body, NOW + timedelta(hours=hours))]
        spark.createDataFrame(row, "source_name string, fetch_key string, body string, fetched_at timestamp").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema("source_name string, fetch_key string, body string, fetched_at timestamp").parquet(path)
        q = inbox.changes(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
        q.awaitTermination()
        got = sorted((r.fetch_key, r.last_changed_at, bool(r.expired), bool(r.unchanged)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert sum(x[2] for x in got) == (no >= 4), (no, got)
    at = lambda h: NOW + timedelta(hours=h)
    assert got == sorted([
        ("k", at(0), False, False), ("k", at(0), False, True), ("k", at(2), False, False), ("k", at(2), True, False), ("k", at(37 * 24), False, False),
        ("l", at(20 * 24), False, False), ("l", at(20 * 24), False, True), ("l", at(38 * 24), False, False),
    ])


def posting(i, title="T", source="s"):
    return (i, title, f"http://h/{i}", "Co", "Berlin", "", source, str(i))


def test_a_batch_rewrites_its_own_buckets(spark, tmp_path):
    """Untouched buckets keep their files; a batch that is run again replaces what it wrote; the whole is what one upsert after the other gives."""
    columns = "id long, title string, url string, company string, location string, salary string, source string, external_id string"
    folder = str(tmp_path / "shelf")
    batches = [spark.createDataFrame([posting(i) for i in range(300)], columns), spark.createDataFrame([posting(7, "New"), posting(1000)], columns), spark.createDataFrame([posting(8, "Newer"), posting(7, "Last")], columns)]
    want = spark.createDataFrame([], schemas.SHELF)
    for no, jobs in enumerate(batches):
        want = lifecycle.shelf_upserted(want, jobs, NOW + timedelta(days=no))
        for _ in range(2 if no == 1 else 1):
            touched = shelf.upsert(spark, folder, no, jobs, NOW + timedelta(days=no), schemas.SHELF)
        written = [b for v, b in shelf._listed(spark, folder, "version=*/bucket=*") if v == no + 1]
        assert sorted(written) == touched and len(touched) <= jobs.count()
        shelf.swept(spark, folder, no)
    rows = lambda df: sorted(map(str, df.select("id", "title", "source", "external_id", "first_seen_at", "last_seen_at").collect()))
    assert rows(shelf.read(spark, folder, 3, schemas.SHELF)) == rows(want)
    left = shelf._listed(spark, folder, "version=*/bucket=*")
    assert len(left) <= shelf.BUCKETS + 4  # the latest, and what the last batch would read again


def test_memory_adds_up(spark, tmp_path, monkeypatch):
    """Additions, and whole tables every third batch, without what was forgotten; what is done with goes."""
    monkeypatch.setattr(shelf, "WHOLE", 3)
    new = lambda no: spark.createDataFrame([(f"h{no}", 0, f"b{no}", NOW)], schemas.MEMORY)
    folder = str(tmp_path / "memory")
    held = lambda no: sorted(r.content_hash for r in shelf.remembered(spark, folder, no, schemas.MEMORY).collect())
    for no in range(8):
        for _ in range(2):  # each batch is run twice
            assert held(no) == [f"h{i}" for i in range(no) if not (i == 0 and no >= 3)]
            memory = shelf.remembered(spark, folder, no, schemas.MEMORY)
            shelf.remember(spark, folder, no, new(no), memory.filter("content_hash <> 'h0'"))
    assert held(8) == [f"h{i}" for i in range(1, 8)]
    assert sorted(shelf._listed(spark, folder, "added=*")) == [(7,), (8,)] and shelf._listed(spark, folder, "whole=*") == [(6,)]


def test_near_copies_on_a_stream(spark, tmp_path):
    """As the batch operator marks them, file by file; what is older than the window is forgotten."""
    rng = random.Random(9)
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(4)]
    rows = [(10 * no + k, f"h{no}-{k}", b + "x" * (no % 3), NOW + timedelta(days=d)) for no, d in enumerate((0, 3, 9, 11, 25)) for k, b in enumerate(bases[: 2 + no % 3])]
    schema = "id long, content_hash string, text string, seen_at timestamp"
    path, folder = str(tmp_path / "in"), str(tmp_path / "out")
    memory, want = spark.createDataFrame([], schemas.MEMORY), {}
    for no in range(5):
        batch = spark.createDataFrame([r for r in rows if r[0] // 10 == no], schema)
        batch.coalesce(1).write.mode("append").parquet(path)
        inbox.near_marked(spark.readStream.schema(schema).parquet(path), folder).awaitTermination()
        got = {r.id: r.near for r in spark.read.parquet(f"{folder}/outcomes/{no}").collect()}
        now, bands = F.lit(max(r[3] for r in rows if r[0] // 10 == no)), nearsim.band_hashes(batch.select("id", "text"))
        near = {r.id for r in nearsim.near_duplicates(bands, memory, now).collect()}
        assert got == {r[0]: r[0] in near for r in rows if r[0] // 10 == no}
        want |= got
        new = bands.join(batch, "id").filter(~F.col("id").isin(sorted(near) or [-1])).select("content_hash", "band", "band_hash", "seen_at")
        memory = spark.createDataFrame(nearsim.remembered(nearsim.forgotten(memory, now), new).collect(), schemas.MEMORY)
    assert want[10] and want[20] and not want[40]  # after 25 days the first are forgotten


def test_follower_asks_the_store_little():
    """A key costs one read, one write and one timer, which moves only when the newest time does; a body that is null is never like the last one."""

    class Store:
        def __init__(self):
            self.held, self.timers, self.calls = None, set(), []

        def getValueState(self, name, schema):  # noqa: N802
            return self

        def get(self):
            self.calls.append("get")
            return self.held

        def update(self, value):
            self.calls.append("update")
            self.held = value

        def registerTimer(self, at):  # noqa: N802
            self.calls.append("register")
            self.timers.add(at)

        def deleteTimer(self, at):  # noqa: N802
            self.calls.append("delete")
            self.timers.remove(at)

    store = Store()
    follower = inbox.Follower(timedelta(milliseconds=5))
    follower.init(store)
    row = lambda at, checksum: inbox.Row(at=at, checksum=checksum)
    asked = lambda *rows: [(r.checksum, r.unchanged, r.since) for r in follower.handleInputRows(("s", "k"), iter(rows), None)]
    assert asked(row(3000, "b"), row(1000, "a"), row(2000, "a")) == [("a", False, 1000), ("a", True, 1000), ("b", False, 3000)]
    assert store.calls == ["get", "update", "register"] and store.timers == {8}
    store.calls.clear()
    assert asked(row(3000, "b")) == [("b", True, 3000)] and store.calls == ["get", "update"] and store.timers == {8}
    assert asked(row(9000, None), row(9500, None)) == [(None, False, 9000), (None, False, 9500)] and store.timers == {14}


def test_minima_are_exact():
    """Also where a remainder is 0 or the largest, and where factors and hashes are."""
    rng, p = random.Random(5), nearsim.PRIME
    draw = lambda low: rng.choice([low, p - 1, rng.randrange(low, p)])
    for n in (1, 7, 513, 2000):
        h = np.array([draw(0) for _ in range(n)], np.int64)
        a = [draw(1) for _ in range(40)]
        b = [rng.choice([draw(0), (-x * int(h[0])) % p, (p - 1 - x * int(h[-1])) % p]) for x in a]
        want = [min((x * int(y) + z) % p for y in h) for x, z in zip(a, b)]
        assert nearsim.minima(h, np.array(a), np.array(b)).tolist() == nearsim.least(h, *nearsim.factors(np.array(a), np.array(b))).tolist() == want


def test_a_refined_batch_hashes_once(spark, sf_dir, monkeypatch):
    """Shelf and memory are tables when a batch is refined: none of its steps makes bands of the shelf again."""
    plans = []
    refined = catalog.R.refine
    monkeypatch.setattr(catalog.R, "refine", lambda batch, shelf, memory, *more: (plans.extend(d._jdf.queryExecution().optimizedPlan().toString() for d in (shelf, memory)), refined(batch, shelf, memory, *more))[1])
    catalog.QUERIES["refine_summary"](spark, sf_dir)
    assert len(plans) == 2 and not any("MapInArrow" in p or "Project" in p for p in plans)

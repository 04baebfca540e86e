import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np

from tests.test_catalog import plain
from tidewell.llm import resample


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def grams(text, longest, buckets):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, longest=1, buckets=10_000, percent=10, least=20):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(grams(text, longest, buckets))
    for text in target:
        t.update(grams(text, longest, buckets))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        found = grams(text, longest, buckets)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return Counter(map(repr, (r[:5] for r in rows)))


def got(df):
    return Counter(repr([r.doc_id, r.n_features, r.weight, r.score, r["rank"]]) for r in df.collect())


def test_odd_documents(spark, odd):
    target = spark.createDataFrame([(1, "The quick brown fox", 1), (2, None, 2), (3, "naïve 日本語 w5 w6", 3)], "item_id long, text string, rank int")
    docs, aim = [(r.doc_id, r.text) for r in odd.collect()], [r.text for r in target.collect()]
    assert got(resample.resample(odd, target, percent=50)) == brute(docs, aim, percent=50)
    assert got(resample.resample(odd, target, percent=100, least_words=1)) == brute(docs, aim, percent=100, least=1)


def test_empty(spark, empty, odd):
    assert resample.resample(empty, empty).collect() == []
    assert resample.resample(odd, empty).count() == odd.count()


def test_chunks_give_what_whole_texts_give(spark):
    """Runs of up to three words, with chunks of very few bytes: each run counts once, where it starts."""
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice(["ab", "B", "é日", "word7", "x" * 40]) + rng.choice([" ", "  ", ", ", "\n--\n"]) for _ in range(n))
    docs = [(i, rng.choice(["", "  ,", " "]) + text(rng.randrange(0, 120)) + rng.choice(["", "end"])) for i in range(60)] + [(60, "y" * 500), (61, "---" * 200), (62, text(5000))]
    aim = [(None, text(50)) for _ in range(5)]
    frame, target = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(aim, "doc_id long, text string")
    for longest in (1, 2, 3):
        for size in (16, 200, 1 << 20):
            assert got(resample.resample(frame, target, longest=longest, buckets=500, chunk_bytes=size)) == brute(docs, [t for _, t in aim], longest, 500)


def test_a_long_text_is_many_rows(spark):
    docs = spark.createDataFrame([(1, "some words go on " * 20_000), (2, "short")], "doc_id long, text string")
    rows = resample.features(docs, chunk_bytes=4096).collect()
    assert len({r.row for r in rows}) == 2 and max(r.n_words for r in rows) < 1100 and sum(r.n_words for r in rows) == 80_001


def test_many_buckets():
    n, found = resample.hashed(b"a b c", b" d e", 3, 1 << 20)
    assert n == 3 and found.tolist() == [zlib.crc32(x) % (1 << 20) for x in (b"a", b"b", b"c", b"a b", b"b c", b"c d", b"a b c", b"b c d", b"c d e")]


def test_ranks_follow_the_order_in_any_number_of_ranges(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(int(rng.integers(0, 9)), i) for i in range(3000)], "score long, id long")
    ranked = resample.ranked(rows, [rows["score"].desc(), rows["id"].asc()], 1000).orderBy("rank").filter("rank IS NOT NULL").collect()
    want = sorted(((r.score, r.id) for r in rows.collect()), key=lambda r: (-r[0], r[1]))[:1000]
    assert [(r.score, r.id) for r in ranked] == want and [r["rank"] for r in ranked] == list(range(1, 1001))


def test_sql_agrees(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    assert plain(resample.resample(docs, target).toPandas()) == plain(con.sql(resample.SQL).df())

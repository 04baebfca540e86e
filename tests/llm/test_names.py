import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tidewell.llm import common, language, mixing, neardup, secrets
from tidewell.llm.graphs import components

OWN = ["_text", "_lang", "_host", "_suffix", "_row", "_doc", "_owner", "_repo", "_parts", "_cut0", "_live", "_size", "_key", "_source", "_order", "_shard", "_logs", "row", "words", "spans"]
STAGES = {
    "language": language.keep_identified,
    "neardup": neardup.keep_one,
    "secrets": lambda d: secrets.redact(d, F.col("source"), F.concat_ws("/", "source", "lang")),
    "mixing": mixing.mixed_rows,
}


@pytest.mark.parametrize("name", STAGES)
def test_columns_named_like_the_operators_own(spark, odd, name):
    """What a stage keeps of a table has the values that it had, whatever the columns are called."""
    docs = odd.select("doc_id", "text", "lang", "source", *[F.concat_ws("-", F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in OWN])
    got = STAGES[name](docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows
    for r in rows:
        assert all(r[n] == "-".join([n] + ([] if r["doc_id"] is None else [str(r["doc_id"])])) for n in OWN)
    plain = STAGES[name](odd.select("doc_id", "text", "lang", "source")).collect()
    key = lambda r: repr((r["doc_id"], r["text"], r["lang"], r["source"]))
    assert sorted(map(key, rows)) == sorted(map(key, plain))


_SPILLS = """
import json, sys
from pyspark.sql import SparkSession
from tidewell.llm import warc
folder = sys.argv[1]
spark = SparkSession.builder.master("local[2]").config("spark.shuffle.spill.numElementsForceSpillThreshold", "20").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", folder).getOrCreate()
warc.ARC_BYTES, warc.ARCHIVE_BYTES = 60_000, 90_000
pages = spark.range(900).selectExpr("id AS page_id", "concat('http://h', id % 7, '/', id) AS url", "repeat(concat('<p>', id % 400, '</p>'), 10 + cast(id % 90 AS int)) AS html")
pages = pages.unionByName(spark.range(2).selectExpr("10000 + id AS page_id", "'http://large/' AS url", "repeat('x', 17000000) AS html")).coalesce(1)
got = warc.query(pages).collect()
print(json.dumps(sorted([r.page_id, r.payload_bytes, r.record_type, r.intact] for r in got)))
"""


def test_records_keep_their_order_where_a_writer_spills(tmp_path):
    """A session of its own, as the threshold holds for a whole process."""
    done = subprocess.run([sys.executable, "-c", _SPILLS, str(tmp_path)], capture_output=True, text=True, env=os.environ, timeout=240, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    rows = json.loads(done.stdout.strip().splitlines()[-1])
    assert len(rows) == 902 and all(r[3] for r in rows) and [r[1:3] for r in rows[-2:]] == [[17_000_000, "revisit"], [17_000_000, "response"]]
    assert [r[1] for r in rows[:900]] == [len(f"<p>{i % 400}</p>") * (10 + i % 90) for i in range(900)]


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    """A key that holds a third of the rows, keys that have no partner, and many small ones: as by a plain join."""
    left = spark.range(9_000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id % 700 END AS k", "id AS v")
    right = spark.range(600).selectExpr("id AS k", "id * 2 AS w").unionByName(spark.createDataFrame([(-1, 5)], "k long, w long"))
    for how in ("inner", "left"):
        monkeypatch.setattr(common, "ALONE", 0)
        got = common.joined_with_hot(left, right, ["k"], 9_000, how)
        assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()
        assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, ["k"], how).collect()))


def test_hubs_and_hot_hosts(spark, odd, monkeypatch):
    """What has hot joins gives the same with and without them."""
    star = spark.createDataFrame([(0, i) for i in range(1, 3_000)] + [(5_000, 5_001), (2_999, 4_000)], "a long, b long")
    told = lambda: sorted(map(str, language.query(odd).collect()))
    live = lambda: sorted(map(str, secrets.scan(odd, F.col("source"), F.col("lang")).collect()))
    plain = told(), live()
    monkeypatch.setattr(common, "ALONE", 0)
    assert {r.root for r in components(star).collect()} == {0, 5_000} and components(star).count() == 3_003
    assert (told(), live()) == plain

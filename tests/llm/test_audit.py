import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_catalog import plain
from tidewell.llm import audit


def fails(text, late):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": late}


def brute(docs, labels):
    """Every order applied to the rows one filter after the other."""
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = [((p or ""), fails(t or "", i is not None and i > least[t or ""]), any(l[0] == i and l[1] == 1 for l in labels if i is not None), any(l[0] == i and l[2] == 1 for l in labels if i is not None)) for i, t, p in docs]
    out = {}
    for part in {r[0] for r in rows}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                every = [r for r in rows if r[0] == part and r[1][f]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(every) - len(gone), sum(sum(r[1].values()) == 1 for r in every), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = shapley[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


def rows_of(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_odd_documents(spark, odd):
    labels = [(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (6, 1, None), (7, 0, 1), (99, 1, 1)]
    docs = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert rows_of(audit.query(odd, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))) == brute(docs, labels)


def test_empty(spark, empty):
    assert audit.query(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


@pytest.mark.parametrize("n_parts", [1, 7, 150])
def test_bitsets(n_parts):
    rng = np.random.default_rng(n_parts)
    n = 1000
    parts = np.concatenate([np.arange(n_parts), rng.integers(0, n_parts, n - n_parts)])
    fails, marks = rng.integers(0, 32, n), rng.integers(0, 4, n) | 4
    got = audit.indexed(parts, n_parts, fails, marks, 5)
    for _ in range(60):
        p, s = rng.integers(n_parts), rng.integers(32)
        left = (parts == p) & (fails & s == 0)
        assert got[p, s].tolist() == [left.sum(), (left & (marks & 1 > 0)).sum(), (left & (marks & 2 > 0)).sum(), left.sum()]


def test_many_parts_in_a_task(spark, monkeypatch):
    """A part for each row, more than a task holds at a time, beside one that has a third of all rows."""
    monkeypatch.setattr(audit, "PARTS", 16)
    rows = spark.range(900).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("part"), (F.col("id") % 32).cast("int").alias("fails"), (F.col("id") % 2 == 0).alias("good"), F.lit(False).alias("toxic"))
    got = {(r.part, r.subset): (r.n, r.good) for r in audit.left_by_subset(rows, 5).filter("part IN ('hot', '1')").collect()}
    for s in range(32):
        hot = [i for i in range(0, 900, 3) if i % 32 & s == 0]
        assert got["hot", s] == (len(hot), sum(i % 2 == 0 for i in hot)) and got["1", s] == (int(not s & 1), 0)


def test_sql_agrees(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    assert plain(audit.query(docs, labels).toPandas()) == plain(con.sql(audit.SQL).df())


def test_failures_at_their_bounds():
    rng = random.Random(3)
    for text in ["", "x " * 199, "x y " * 100, " ".join(map(str, range(200))), "A" + "b" * 49, "A" + "b" * 48, "Ä" * 50 + "A", "é" * 98 + "AA", "é" * 97 + "AA", "a|b", " x y", "".join(rng.choice("aA #\n日") for _ in range(500))]:
        want = fails(text, False)
        assert audit.failures(text.encode()) == sum(want[c] << i for i, c in enumerate("ABCD"))

import re

import numpy as np

from tidewell.llm import mixing


def expected_targets(sizes):
    """By the words of the rule: share by weight, stop at twice the size, share the excess anew."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, target, free = 1.5 * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    left = total
    while free and left > 1e-9:
        whole = sum(weight[s] for s in free)
        share = {s: target[s] + left * weight[s] / whole for s in free}
        left = 0.0
        for s in list(free):
            if share[s] >= 2 * sizes[s]:
                left += share[s] - 2 * sizes[s]
                share[s] = 2.0 * sizes[s]
                free.discard(s)
            target[s] = share[s]
    return target


def check(docs):
    rows = mixing.query(docs).collect()
    given = docs.select("doc_id", "text", "source").collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(g.doc_id), count(g.text)) for g in given)
    sizes = {}
    for g in given:
        sizes[g.source] = sizes.get(g.source, 0) + count(g.text)
    want = expected_targets(sizes)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert sorted({(r.source_size, round(r.target, 6)) for r in rows}) == sorted({(sizes[s], round(want[s], 6)) for s in sizes})
    by = {}
    for r in rows:
        by[(r.source_size, r.target)] = by.get((r.source_size, r.target), 0) + r.taken
    if len({(sizes[s], round(want[s], 6)) for s in sizes}) == len(sizes):  # else two sources can't be told apart here
        assert all(abs(taken - target) <= 1 for (_, target), taken in by.items())
    return rows


def test_odd_documents(odd, empty):
    check(odd)
    assert mixing.query(empty).collect() == []
    kept = mixing.copies(mixing.mix(odd), odd.columns)
    assert set(odd.columns) <= set(kept.columns)


def test_documents_and_reruns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = check(docs)
    assert sorted(rows) == sorted(mixing.query(docs.repartition(7)).collect())
    assert all((r.shard_first is None) == (r.taken == 0) for r in rows)


def test_tree_splits_exactly():
    rng = np.random.default_rng(1)
    counts = np.array([50, 0, 7, 1, 300])
    shards = np.array([100, 58, 100, 100])
    got = mixing.split_tree(counts, shards, rng)
    assert (got.sum(axis=1) == counts).all() and (got.sum(axis=0) == shards).all() and (got >= 0).all()
    mean = np.mean([mixing.split_tree(counts, shards, np.random.default_rng(i))[:, 0] for i in range(2000)], axis=0)
    assert np.allclose(mean, counts * 100 / 358, atol=0.6)  # as drawn without replacement


def test_ranks_are_global(spark):
    df = spark.createDataFrame([(f"s{i:03d}",) for i in range(300)] + [(None,)], "s string")
    from pyspark.sql import functions as F

    got = {r.s: r["rank"] for r in mixing.ranked(df, F.col("s").asc_nulls_last()).collect()}
    assert got == {**{f"s{i:03d}": i for i in range(300)}, None: 300}


def test_shards_are_written_in_their_order(spark, sf_dir):
    from pyspark.sql import functions as F

    taken = mixing.copies(mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")), ["doc_id"])
    rows = mixing.shuffled(taken).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")).orderBy("at").collect()
    assert len(rows) == taken.count() and len({r._shard for r in rows}) == mixing.SHARDS
    assert [(r._shard, r._order) for r in rows] == sorted((r._shard, r._order) for r in rows)
    assert all(len({r._shard for r in rows if r.part == p}) == 1 for p in {r.part for r in rows})

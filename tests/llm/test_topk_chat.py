import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import chat, topk
from tidewell.llm.queries import ORACLE_SQL, QUERIES


def brute(rows, k):
    fine = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {i: min((list(x) for j, x in fine if j == i)) for i, _ in fine if i % 20 == 0}.items():
        scored = sorted((-int(np.dot(v, w)), j) for j, w in fine if j != q and len(w) == len(v))
        out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(120)] + [(0, [0.5] * 6), (7, [0.5] * 6), (7, [0.5] * 6)]
    rows += [(200, None), (220, []), (240, [float("nan")] * 6), (260, [None] * 6), (280, [float("inf")] * 6), (None, [0.1] * 6), (300, [0.1, 0.2]), (320, [3e6] * 6), (301, [0.3, -0.2])]
    got = sorted(map(tuple, topk.top_k(vectors(spark, rows), 20, lambda i: i % 20 == 0).collect()))
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == brute(rows, 20)


def test_clusters_are_skipped(spark, monkeypatch):
    """Clustered vectors with columns named like the operator's own: clusters that can't reach the cutoff aren't asked, and the answers stay exact."""
    monkeypatch.setattr(topk, "BLOCK", 16)
    asked = []
    monkeypatch.setattr(topk, "stage", lambda df, name, rows=None, of=topk.stage: asked.append(of(df, name, rows)) or asked[-1] if name == "asked" else of(df, name, rows))
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((8, 12)) * 4
    rows = [(i, [float(x) for x in centres[i % 8] + rng.standard_normal(12) * 0.02]) for i in range(800)]
    frame = vectors(spark, rows).selectExpr("vec_id", "embedding", "'x' AS id", "1 AS n", "2 AS code", "3 AS block", "4L AS cutoff", "5 AS slice")
    got = sorted(map(tuple, topk.top_k(frame, 5, lambda i: i % 20 == 0).collect()))
    assert got == brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 5)
    met = asked[0].selectExpr("sum(length(q_ids) / 8)").first()[0]
    assert met < 40 * topk.clusters(topk._blocks(frame.selectExpr("vec_id AS id", "transform(embedding, x -> bigint(floor(x * 64))) AS v").mapInArrow(topk._encode(5), topk._ENCODED).selectExpr("*", "CAST(NULL AS BIGINT) AS cutoff"), 16, 800)).selectExpr("size(codes)").first()[0] / 2


def test_keys_grow_with_the_blocks(spark):
    """A key has BLOCKS_A_KEY blocks at most, whatever the size of a cluster, and every row meets every block of its cluster once."""
    blocks = spark.range(103).selectExpr("3 AS n", "cast(id % 2 AS int) AS code", "cast(id / 2 AS int) AS block", "id AS held")
    asked = spark.range(10).selectExpr("3 AS n", "cast(id % 2 AS int) AS code", "id AS q")
    met = topk.dealt(asked, blocks, topk.BLOCKS_A_KEY)
    assert met.count() == met.select("q", "held").distinct().count() == 5 * 103
    by_key = met.groupBy("code", "_run").agg(F.countDistinct("held").alias("n")).collect()
    assert len(by_key) == 13 + 13 and max(r.n for r in by_key) == topk.BLOCKS_A_KEY


def test_few_and_none(spark):
    assert topk.top_k(vectors(spark, []), 20, lambda i: i % 20 == 0).collect() == []
    assert [tuple(r) for r in topk.top_k(vectors(spark, [(0, [1.0]), (1, [0.5])]), 20, lambda i: i % 20 == 0).collect()] == [(0, 1, 1, 64 * 32)]


def test_preferences(spark, empty):
    rows = [
        (0, 0, "system", "Be kind."), (0, 1, "user", "Hi"), (0, 2, "assistant", "Hello 😀"), (1, 0, "system", "Be kind."), (1, 1, "user", "Hi"), (1, 2, "assistant", "What?"), (1, 3, None, None),
        (2, 0, "user", "alone"), (None, 0, "user", "lost"), (4, 0, "user", "a"), (5, 0, "user", "a"), (6, 1, "user", "t"), (6, 1, "assistant", "t"), (7, None, "user", None),
    ]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, prompt string")
    got = {r.pair_id: r for r in chat.preferences(turns, F.shiftright("conv_id", 1), F.col("conv_id") % 2 == 0).collect()}
    one = got[0]
    assert one.n_common == 2 and one.prompt == "<|system|>\nBe kind.<|end|>\n<|user|>\nHi<|end|>\n"
    for side, mask, say in ((one.chosen, one.chosen_mask, "Hello 😀<|end|>"), (one.rejected, one.rejected_mask, "What?<|end|>")):
        a, b = map(int, mask.split(":"))
        assert side[a:b] == say
    assert one.rejected.endswith("<|end|>\n<||>\n<|end|>\n")
    assert (got[1].prompt, got[1].rejected, got[1].chosen_mask) == ("", "", "") and got[2].chosen == got[2].rejected == "" and len(got) == 4


def test_long_and_odd_conversations(spark, empty):
    """2,000 turns, a turn of 300,000 characters, turns without a side, repeated rows, an empty table."""
    long = [(0, i, "assistant" if i % 2 else "user", f"turn {i} 😀") for i in range(2000)] + [(1, i, "assistant" if i % 2 else "user", f"turn {i} 😀" if i < 1500 else f"other {i}") for i in range(2000)]
    rows = [*long, (2, 0, "assistant", "x" * 300_000), (3, 0, "assistant", "y"), (3, 0, "assistant", "y")]
    turns = spark.createDataFrame([(*r, "p") for r in rows], "conv_id long, turn long, role string, text string, before string")
    pair, chosen = F.shiftright("conv_id", 1), F.when(F.col("turn") != 777, F.col("conv_id") % 2 == 0)
    got = {r.pair_id: r for r in chat.preferences(turns, pair, chosen).collect()}
    shown = lambda t: f"<|{t[2]}|>\n{t[3]}<|end|>\n"
    kept = [t for t in long if t[1] != 777]
    one, other = ([t for t in kept if t[0] == c] for c in (0, 1))
    assert got[0].n_common == 1499 and got[0].prompt == "".join(map(shown, one[:1499])) and got[0].rejected == "".join(map(shown, other[1499:]))
    for text, mask, turns_left in ((got[0].chosen, got[0].chosen_mask, one[1499:]), (got[0].rejected, got[0].rejected_mask, other[1499:])):
        learnt = [text[int(a) : int(b)] for a, b in (x.split(":") for x in mask.split(","))]
        assert learnt == [f"{t[3]}<|end|>" for t in turns_left if t[2] == "assistant"]
    assert len(got[1].chosen) == 300_022 and got[1].rejected_mask == "14:22,37:45"
    none = turns.limit(0)
    assert chat.preferences(none, pair, chosen).collect() == []


def test_sql_agrees(spark, sf_dir):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name in ("op6_preferences", "op9_topk"):
        got, want = QUERIES[name](spark, sf_dir), con.sql(ORACLE_SQL[name])
        assert sorted(map(tuple, got.select(*sorted(got.columns)).collect())) == sorted(want.select(", ".join(f'"{c}"' for c in sorted(want.columns))).fetchall())

"""Exact top-k search by inner product, by three phases with a uniform threshold.

Vectors are clustered by the signs of up to CODE_BITS random projections, and a cluster is cut into
blocks of about BLOCK vectors, each one row that holds a matrix.  The components are cut into SEGMENTS
parts; a pair's score is the sum of its partial scores.

Phase 1 gathers score lists: every query meets LISTS blocks of its own cluster, and the k-th best of
all that they return is a safe cutoff, no better than the true k-th score.
Phase 2 sends the cutoff out.  A cluster whose vectors lie within a radius of their mean in each segment can't
reach it if the bounds of its segments don't sum to it, and isn't asked.  Where it is, an entry is sufficient only
if some segment reaches the uniform share, cutoff / SEGMENTS, of the cutoff.
Phase 3 completes the scores of the sufficient entries exactly; the k best of them are the answer.

Candidates are sent once.  A query is sent to the clusters that it must ask, at most 2^CODE_BITS times SLICES,
so what is shuffled grows in proportion to the rows; only the arithmetic of pairs that no bound
rules out grows with queries times candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import stage

SEGMENTS = 4
BLOCK = 8192
#: Queries that one task compares with a block at a time, and queries in a block of their own.
AT_ONCE, ASKED = 128, 2048
#: Signs of projections that name a cluster, at most; fewer where a cluster would hold less than BLOCK vectors.
CODE_BITS = 8
#: Blocks of its own cluster from which a query gets its cutoff.
LISTS = 4
#: Blocks of candidates, and of queries, that share a key of a join: a cluster has as many keys as it has such runs of blocks.
BLOCKS_A_KEY, ASKED_A_KEY = 4, 16

_ENCODED = "id long, n int, code int, raw binary"
_FOUND = "query_id long, n int, vec_id long, score long"
_NONE = np.iinfo(np.int64).min


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v: floor(64 x) of each component; without vectors that are null, empty, or hold a null or non-finite component."""
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * 64)).cast("array<long>").alias("v"))


def _encode(bits: int):
    """Rows (id, v) as _ENCODED: the length, the cluster and the components, of two bytes where that is enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ns, codes, raws = [], [], []
            for v in batch.column(1):
                x = v.values.to_numpy(zero_copy_only=False)
                n = len(x)
                if n not in planes:
                    planes[n] = np.random.default_rng([n, 17]).standard_normal((bits, n))
                ns.append(n)
                codes.append(int(((planes[n] @ x) > 0) @ (1 << np.arange(bits))))
                raws.append(x.astype("<i2" if x.min() >= -(1 << 15) and x.max() < 1 << 15 else "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int32()), pa.array(codes, pa.int32()), pa.array(raws, pa.binary())], names=["id", "n", "code", "raw"])

    return work


def _matrix(raws: list[bytes], n: int) -> np.ndarray:
    """The vectors of a column of encoded ones, as int64."""
    return np.stack([np.frombuffer(r, "<i2" if len(r) == 2 * n else "<i8") for r in raws]).astype(np.int64) if len(raws) else np.zeros((0, n), np.int64)


def _narrow(x: np.ndarray) -> bytes:
    return x.astype("<i2" if x.min() >= -(1 << 15) and x.max() < 1 << 15 else "<i8").tobytes()


def _wide(raw: bytes, rows: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if len(raw) == 2 * rows * n else "<i8").reshape(rows, n)


def _cuts(n: int) -> list[tuple[int, int]]:
    cuts = np.linspace(0, n, SEGMENTS + 1).astype(int).tolist()
    return list(zip(cuts, cuts[1:]))


_BLOCK = "n int, code int, block int, ids binary, vectors binary, cutoffs binary"


def _blocks(rows: DataFrame, of: int, n: int) -> DataFrame:
    """The encoded rows, ``n`` at most, with their cutoffs as _BLOCK: by cluster, in blocks of about ``of`` rows."""
    sizes = stage(rows.groupBy("n", "code").agg(F.ceil(F.count(F.lit(1)) / of).cast("int").alias("blocks")), "sizes", n)
    dealt = rows.join(sizes, ["n", "code"]).withColumn("block", F.pmod(F.xxhash64("id", "raw", F.lit(3)), F.col("blocks")).cast("int"))

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        cutoffs = pdf["cutoff"].fillna(_NONE).astype("<i8") if pdf["cutoff"].notna().any() else np.full(len(pdf), _NONE, "<i8")
        return pd.DataFrame({"n": [key[0]], "code": [key[1]], "block": [key[2]], "ids": [pdf["id"].to_numpy("<i8").tobytes()], "vectors": [_narrow(_matrix(pdf["raw"].tolist(), int(key[0])))], "cutoffs": [np.asarray(cutoffs, "<i8").tobytes()]})

    return dealt.groupBy("n", "code", "block").applyInPandas(pack, _BLOCK)


def _partial(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(segment, query, candidate): exact, as every sum stays below 2^24 or 2^53; whole numbers beyond that."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    q, c = q.astype(kind), c.astype(kind)
    return np.stack([q[:, a:b] @ c[:, a:b].T for a, b in _cuts(q.shape[1])])


def _sufficient(q: np.ndarray, q_ids: np.ndarray, bound: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and scores of the k best entries of each query that reach its bound, and of those that tie with the k-th."""
    parts = _partial(q, c)
    # A score that reaches the cutoff has a segment that reaches its uniform share.
    enough = (parts >= (bound / SEGMENTS)[:, None]).any(axis=0) & (q_ids[:, None] != c_ids)
    if len(c_ids) > k and enough.sum(axis=1).max(initial=0) > 8 * k:
        total = parts.sum(axis=0)
        total[~enough] = total.min(initial=0) - 1
        enough &= total >= np.partition(total, len(c_ids) - k, axis=1)[:, len(c_ids) - k, None]
    row, col = np.nonzero(enough)
    scores = np.zeros(len(row), np.int64)
    for p in parts:
        scores += p[row, col].astype(np.int64)
    good = scores >= bound[row]
    return row[good], col[good], scores[good]


def _searched(k: int):
    """_FOUND of rows (n, q_ids, q_vectors, cutoffs, ids, vectors): of each query the k best sufficient entries of the block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, q_raw, q_vec, cut_raw, c_raw, c_vec in zip(*(c.to_pylist() for c in batch.columns)):
                q_ids, c_ids, cutoffs = (np.frombuffer(x, "<i8") for x in (q_raw, c_raw, cut_raw))
                q, c = (_wide(x, len(ids), n).astype(np.int64) for x, ids in ((q_vec, q_ids), (c_vec, c_ids)))
                for at in range(0, len(q), AT_ONCE):
                    ids, bound = q_ids[at : at + AT_ONCE], cutoffs[at : at + AT_ONCE]
                    row, col, scores = _sufficient(q[at : at + AT_ONCE], ids, bound, c, c_ids, k)
                    order = np.lexsort((c_ids[col], -scores, row))
                    row, col, scores = row[order], col[order], scores[order]
                    best = np.arange(len(row)) - np.searchsorted(row, np.arange(len(ids)))[row] < k
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row[best]]), pa.array(np.full(best.sum(), n, np.int32)), pa.array(c_ids[col[best]]), pa.array(scores[best])], names=["query_id", "n", "vec_id", "score"])

    return work


def clusters(blocks: DataFrame) -> DataFrame:
    """n, codes, means, reaches: of each cluster the mean of its blocks' means, and the largest distance of its vectors from that in each segment; at most 2^CODE_BITS of a length."""

    def of_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, code, ids, vectors in zip(*(c.to_pylist() for c in batch.columns)):
                x = _wide(vectors, len(ids) // 8, n).astype(np.float64)
                mean = x.mean(axis=0)
                out.append((n, code, mean.tolist(), [float(np.sqrt(((x[:, a:b] - mean[a:b]) ** 2).sum(axis=1).max())) for a, b in _cuts(n)]))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())))], names=["n", "code", "mean", "reach"])

    def of_cluster(key, pdf: pd.DataFrame) -> pd.DataFrame:
        means, reaches = np.stack(pdf["mean"]), np.stack(pdf["reach"])
        mean = means.mean(axis=0)
        away = np.stack([np.sqrt(((means[:, a:b] - mean[a:b]) ** 2).sum(axis=1)) for a, b in _cuts(int(key[0]))], axis=1)
        return pd.DataFrame({"n": [key[0]], "code": [key[1]], "mean": [mean], "reach": [(away + reaches).max(axis=0)]})

    kind = "n int, code int, mean array<double>, reach array<double>"
    each = blocks.select("n", "code", "ids", "vectors").mapInArrow(of_block, kind).groupBy("n", "code").applyInPandas(of_cluster, kind)
    return each.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("code", "mean", "reach"))).alias("clusters")).select("n", F.col("clusters.code").alias("codes"), F.col("clusters.mean").alias("means"), F.col("clusters.reach").alias("reaches"))


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, code, q_ids, q_vectors, cutoffs) of rows (n, ids, vectors, cutoffs, codes, means, reaches): for each cluster those queries of the block that it may reach the cutoff of."""
    for batch in batches:
        out = []
        for n, ids, vectors, cut_raw, codes, means, reaches in zip(*(c.to_pylist() for c in batch.columns)):
            ids, cutoffs, means, reaches = np.frombuffer(ids, "<i8"), np.frombuffer(cut_raw, "<i8"), np.array(means), np.array(reaches)
            q = _wide(vectors, len(ids), n)
            most = sum(q[:, a:b] @ means[:, a:b].T + np.linalg.norm(q[:, a:b].astype(np.float64), axis=1)[:, None] * reaches[:, s] for s, (a, b) in enumerate(_cuts(n)))
            ask = most + np.abs(most) * 1e-9 + 1 >= cutoffs[:, None]  # far more than rounding may lose
            for i, code in enumerate(codes):
                if (at := np.flatnonzero(ask[:, i])).size:
                    out.append((n, code, ids[at].tobytes(), _narrow(q[at]), cutoffs[at].tobytes()))
        cols = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["n", "code", "q_ids", "q_vectors", "cutoffs"])


def dealt(few: DataFrame, many: DataFrame, of: int) -> DataFrame:
    """Rows of ``few`` joined by cluster with blocks (n, code, block, ...) of ``many``: a key for each ``of`` blocks, to each of which the rows of ``few`` are sent."""
    run = F.floor(F.col("block") / of).cast("int")
    runs = many.groupBy("n", "code").agg((F.max(run) + 1).alias("_runs"))
    sent = few.join(runs, ["n", "code"]).withColumn("_run", F.explode(F.sequence(F.lit(0), F.col("_runs") - 1))).drop("_runs")
    return sent.join(many.withColumn("_run", run).drop("block"), ["n", "code", "_run"])


def top_k(vectors: DataFrame, k: int, is_query, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best candidates (all, if there are fewer), ties to the smaller id.

    Vectors that are null or empty, or hold a null or non-finite component, take no part, nor do rows without
    an id.  Vectors of different lengths are searched apart.  Repeated ids are candidates of their
    own, but none with the query's id is its candidate; a query id that occurs more than once with one length has one
    answer for it, by its least vector.  An empty table gives no rows.
    """
    rows = stage(whole_vectors(vectors, id_col, vector_col).filter("id IS NOT NULL"), "vectors")
    n = rows.count()
    bits = min(CODE_BITS, max(0, (n // BLOCK).bit_length() - 1))
    encoded = lambda df: df.mapInArrow(_encode(bits), _ENCODED)
    bare = F.lit(None).cast("long").alias("cutoff")
    cand = stage(_blocks(encoded(rows).select("*", bare), BLOCK, n), "candidates")
    queries = rows.filter(is_query(F.col("id"))).groupBy("id", F.size("v").alias("n")).agg(F.min("v").alias("v")).select("id", "v")
    queries = stage(encoded(queries), "queries", n)
    ranks = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "n").orderBy(F.desc("score"), "vec_id")))
    asking = [F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), "cutoffs"]

    # Phase 1: the lists of some blocks of each query's own cluster.
    own = stage(_blocks(queries.select("*", bare), ASKED, n).select("n", "code", "block", *asking), "own")
    lists = dealt(cand.filter(F.col("block") < LISTS).select("n", "code", "ids", "vectors"), own, ASKED_A_KEY)
    first = lists.select("n", "q_ids", "q_vectors", "cutoffs", "ids", "vectors").mapInArrow(_searched(k), _FOUND)
    cutoffs = ranks(first).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), "n", F.col("score").alias("cutoff"))

    # Phase 2: the cutoffs, and with them the queries, go to the clusters that may reach them.
    told = _blocks(queries.join(cutoffs, ["id", "n"], "left").select("id", "n", "code", "raw", "cutoff"), ASKED, n).join(clusters(cand), "n")
    sent = told.select("n", "ids", "vectors", "cutoffs", "codes", "means", "reaches").mapInArrow(_asked, "n int, code int, q_ids binary, q_vectors binary, cutoffs binary")
    met = dealt(stage(sent, "asked"), cand.select("n", "code", "block", "ids", "vectors"), BLOCKS_A_KEY)

    # Phase 3: what is sufficient is completed.
    found = met.select("n", "q_ids", "q_vectors", "cutoffs", "ids", "vectors").mapInArrow(_searched(k), _FOUND)
    return ranks(found).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

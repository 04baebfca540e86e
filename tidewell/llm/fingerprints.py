"""Document fingerprints by consistent weighted sampling.

Method: a text is a set of weighted terms (its pairs of neighbouring words, lower-cased, weighed by
how often they occur; a lone word is a term itself).  For each of LANES samples every term draws from
its own gamma variables r and c and its uniform b: with t = floor(ln w / r + b) and
ln y = r (t - b), the sample is the (term, t) with the least c / (y e^r).  Two texts draw the same
sample with a probability equal to the generalised Jaccard similarity of their terms, the sum of the
smaller weights over that of the larger ones.  A fingerprint is 16 bits of each sample.

A term's variables come from two tables, of 65,536 pairs of r and b and of as many c, indexed for each lane
by bits of another hash of the term.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import partitions
from tidewell.llm.terms import kmers, word_hashes

LANES = 64
TERM_WORDS = 2
_SEED = 20_011
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Sampler:
    def __init__(self, lanes: int = LANES, seed: int = _SEED):
        rng = np.random.default_rng(seed)
        self.lanes = lanes
        self.spread = rng.integers(1, 1 << 63, lanes, dtype=np.uint64) | np.uint64(1)
        self.r = rng.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
        self.b = rng.random(1 << 16).astype(np.float32)
        self.light = self.r * (self.b - 1)  # -ln y - r of a term of weight 1, whose t is 0

    def sample(self, words: np.ndarray) -> np.ndarray:
        """16 bits for each lane."""
        terms, counts = np.unique(kmers(words, TERM_WORDS), return_counts=True)
        if not len(terms):
            return np.zeros(self.lanes, np.uint16)
        out = np.empty(self.lanes, np.uint16)
        each = max(1, 400_000 // len(terms))  # lanes at a time: memory stays bounded for very long texts
        log_w = np.log(counts).astype(np.float32)
        heavy = np.flatnonzero(counts > 1)
        for lane in range(0, self.lanes, each):
            spread = self.spread[lane : lane + each]
            h = spread[:, None] * terms[None, :]
            h ^= h >> np.uint64(29)
            at_r, at_c = (h >> np.uint64(48)).view(np.int64), ((h >> np.uint64(24)) & np.uint64(0xFFFF)).view(np.int64)
            score = np.take(self.light, at_r, mode="clip")
            score += np.take(self.log_c, at_c, mode="clip")
            t = np.zeros((len(spread), len(terms)), np.int32) if len(heavy) else None
            if len(heavy):
                rh, bh = self.r[at_r[:, heavy]], self.b[at_r[:, heavy]]
                th = np.floor(log_w[heavy] / rh + bh)
                score[:, heavy] -= rh * th
                t[:, heavy] = th
            best = score.argmin(axis=1)
            rows = np.arange(len(spread))
            drawn = terms[best]
            if t is not None:
                drawn = drawn ^ (t[rows, best].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            out[lane : lane + each] = (drawn * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many characters of the following text, or all of them."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _fingerprinted(rows: Iterator[tuple[int | None, str]], sampler: Sampler) -> Iterator[tuple]:
    """Result rows of documents in their order; each needs the one that follows."""
    before = None  # (id, text, its sample) that still lacks the next text
    held: list[tuple[int | None, str]] = []

    def flush():
        nonlocal before
        texts = [h[1] for h in held]
        pairs = ([before[1]] if before else []) + texts
        changed = [edited(a, b) for a, b in zip(pairs, pairs[1:])]
        own = [sampler.sample(w) for w in word_hashes(texts)]
        samples = ([before[2]] if before else []) + own
        ids = ([before[0]] if before else []) + [h[0] for h in held]
        for i, (text, words) in enumerate(zip(changed, word_hashes(changed))):
            e = sampler.sample(words)
            yield ids[i], len(pairs[i]), hashlib.sha256(text.encode()).hexdigest(), samples[i].astype(">u2").tobytes().hex(), e.astype(">u2").tobytes().hex(), likeness(samples[i], e), likeness(samples[i], samples[i + 1])
        before = (ids[-1], pairs[-1], samples[-1])

    size = 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size > 2_000_000:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its own fingerprint, its edited text's, and their likeness (see _OUT).

    The next document is that of the next smaller id, after the last one the first; equal ids go by
    descending text; null ids come last.  A null text counts as empty.  Texts without words have one
    common fingerprint.  A lone row is its own next.  An empty table gives no rows.

    The ids are cut into as many ranges as there are shuffle partitions, so each task sees its documents
    in order; the first document of each range is also sent to the range before.
    """
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    least = -(1 << 63)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(least))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), key.alias("key"))
    # Range bounds, at most one per partition; block 0 has the largest ids.
    cuts = rows.agg(F.percentile_approx("key", [(i + 1) / n for i in range(n - 1)] or [0.5], 20_000)).first()[0] or []
    cuts = sorted(set(cuts))
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<long>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, len(cuts).bit_length())))])
    smaller = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.get(bounds, at + step - 1) < F.col("key")), at + step).otherwise(at))  # a binary search
    block = F.lit(len(cuts)) - smaller
    blocked = rows.withColumn("block", block.cast("int"))
    heads = {r[0]: r[1] for r in blocked.groupBy("block").agg(F.max("key")).collect()}
    order = sorted(heads)
    before = {heads[b]: order[i - 1] for i, b in enumerate(order)}  # the first range's head goes to the last
    few = spark.createDataFrame([(k, b) for k, b in before.items()], "key long, to int") if before else spark.createDataFrame([], "key long, to int")
    firsts = rows.join(F.broadcast(few), "key").groupBy("key", "to", "doc_id").agg(F.max("text").alias("text"))
    extra = firsts.select("doc_id", "text", "key", F.col("to").alias("block"), F.lit(True).alias("extra"))
    every = blocked.withColumn("extra", F.lit(False)).unionByName(extra)
    ordered = every.repartitionById(len(cuts) + 1, "block").sortWithinPartitions("extra", F.desc("key"), F.desc("text")).select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        names = [c.split()[0] for c in _OUT.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        held: list[tuple] = []
        for row in _fingerprinted(rows, sampler):
            held.append(row)
            if len(held) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    return ordered.mapInArrow(work, _OUT)

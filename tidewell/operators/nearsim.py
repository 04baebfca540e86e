"""Near duplicates of descriptions against a memory that forgets.

A description's character shingles give LANES minima of linear hash functions, joined to bands of
BAND_WIDTH lanes.  Two descriptions are near if enough bands agree: as many as are expected at the
threshold.  A shingle's hash is a polynomial of its code points, and a lane is (a h + b), both modulo
2^31 - 1, so that a text's shingles are hashed as arrays.

Minima are found without a division: (a h + b) / PRIME, modulo 1, is a fraction of 64 bits, which wraps by itself.  Factors rounded to 64 bits
are wrong by less than 2^-34 after a product with h, while different remainders are 2^-31 apart, so the least fraction tells the least remainder exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANES = 128
BAND_WIDTH = 4
SHINGLE = 5
THRESHOLD = 0.9
WINDOW_DAYS = 10
PRIME = (1 << 31) - 1
BASE = 1_103_515_245
#: Shingles whose lanes are computed at a time, and texts whose bands are.
BLOCK, TEXTS = 512, 256


def lanes(n: int = LANES, seed: int = 42) -> list[tuple[int, int]]:
    """(a, b) of each lane, by a rule that SQL can follow as well."""
    return [(1 + (48271 * (seed + 7 * i + 1)) % (PRIME - 1), (69621 * (seed + 13 * i + 5)) % PRIME) for i in range(n)]


def _fold(x: np.ndarray, spare: np.ndarray) -> None:
    """Positive numbers below 2^62 in place as what they are modulo PRIME, PRIME itself instead of 0."""
    for _ in range(2):
        np.right_shift(x, 31, out=spare)
        x &= PRIME
        x += spare


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """The different hashes of the runs of ``size`` characters; of all characters where there are fewer."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    n = max(1, len(points) - size + 1)
    h, spare = np.zeros(n, np.int64), np.empty(n, np.int64)
    for k in range(min(size, len(points))):
        h *= BASE
        h += points[k : n + k]
        _fold(h, spare)
    h[h == PRIME] = 0
    return np.unique(h)


def factors(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lanes 2^64 a / PRIME and 2^64 b / PRIME, rounded; the second with 2^31, more than any error, so that nothing falls below 0."""
    slope, start = ([((int(x) << 64) + PRIME // 2) // PRIME + more for x in xs] for xs, more in ((a, 0), (b, 1 << 31)))
    return np.array(slope, np.uint64)[:, None], np.array(start, np.uint64)[:, None]


def minima(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least (a h + b) modulo PRIME of each lane."""
    return least(h, *factors(a, b))


def least(h: np.ndarray, slope: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Minima by the lanes' factors, in blocks that stay in a processor's cache."""
    h = h.astype(np.uint64)
    low = np.full(len(slope), np.iinfo(np.uint64).max)
    block = np.empty((len(slope), min(len(h), BLOCK)), np.uint64)
    for at in range(0, len(h), BLOCK):
        x = block[:, : len(h[at : at + BLOCK])]
        np.multiply(slope, h[None, at : at + BLOCK], out=x)
        x += start
        np.minimum(low, x.min(axis=1), out=low)
    # low * PRIME / 2^64, by halves.
    half, prime = np.uint64(32), np.uint64(PRIME)
    return (((low >> half) * prime + ((low & np.uint64(0xFFFFFFFF)) * prime >> half)) >> half).astype(np.int64)


def required_bands(n_lanes: int = LANES, band_width: int = BAND_WIDTH, threshold: float = THRESHOLD) -> int:
    if not 0.0 < threshold <= 1.0 or band_width < 1 or n_lanes < 1 or n_lanes % band_width:
        raise ValueError("threshold must be in (0, 1], and band_width must divide the lanes")
    return max(1, math.ceil(n_lanes // band_width * threshold**band_width))


def band_hashes(docs: DataFrame, n_lanes: int = LANES, band_width: int = BAND_WIDTH, shingle: int = SHINGLE, seed: int = 42) -> DataFrame:
    """id, band, band_hash of rows (id, text): a row per band, none for null or empty texts."""
    required_bands(n_lanes, band_width)
    a, b = (np.array(x, np.int64) for x in zip(*lanes(n_lanes, seed)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_bands, own = n_lanes // band_width, factors(a, b)
        # Few texts at a time, so that a task holds little besides the batch it is given.
        for batch in (whole.slice(at, TEXTS) for whole in batches for at in range(0, len(whole), TEXTS)):
            ids, hashes = [], []
            for doc_id, value in zip(batch.column(0), batch.column(1)):
                text = value.as_py()
                if not text:
                    continue
                h = shingle_hashes(" ".join(text.lower().split()), shingle)
                ids.append(doc_id.as_py())
                values = list(map(str, least(h, *own).tolist()))
                hashes += [hashlib.md5("-".join(values[at : at + band_width]).encode()).hexdigest() for at in range(0, n_lanes, band_width)]
            bands = np.tile(np.arange(n_bands, dtype=np.int32), len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), n_bands)), pa.array(bands), pa.array(hashes, pa.string())], names=["id", "band", "band_hash"])

    return docs.mapInArrow(work, "id long, band int, band_hash string")


def _first_of_alike(bands: DataFrame, key: str) -> DataFrame:
    """key, first: of the documents with equal bands throughout the smallest key.  Both are small: bands are folded before the shuffle."""
    folded = [F.bit_xor(F.xxhash64(*x)).alias(n) for n, x in (("s", ("band", "band_hash")), ("t", ("band_hash", "band")))]
    signed = bands.groupBy(key).agg(*folded)
    return signed.join(signed.groupBy("s", "t").agg(F.min(key).alias("first")), ["s", "t"]).select(key, "first")


def _rarest(bands: DataFrame, frequencies: DataFrame, key: str, least: int) -> DataFrame:
    """key, band, band_hash: each document's rarest bands, all but ``least`` - 1, in an order that is the same for all.  A frequent band's rows are a skewed join's, which is split at run time."""
    known = bands.join(frequencies, ["band", "band_hash"])
    order = F.array_sort(F.collect_list(F.struct("n", "band", "band_hash")))
    return known.groupBy(key).agg(F.slice(order, F.lit(1), F.greatest(F.size(order) - least + 1, F.lit(1))).alias("own")).select(key, F.explode("own").alias("own")).select(key, "own.band", "own.band_hash")


def candidate_pairs(probes: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """id, content_hash of documents (id, band, band_hash) and remembered ones (content_hash, band, band_hash) that may share ``least`` bands, each pair once.

    Of two that do, of n bands and m, one of the n - least + 1 and m - least + 1 rarest is common; a band that many unlike
    documents have is hardly among these, so it sends no pairs.
    """
    every = probes.select("band", "band_hash").unionByName(known.select("band", "band_hash"))
    frequencies = every.groupBy("band", "band_hash").agg(F.count(F.lit(1)).alias("n"))
    asked, held = _rarest(probes, frequencies, "id", least), _rarest(known, frequencies, "content_hash", least)
    return asked.join(held, ["band", "band_hash"]).select("id", "content_hash").distinct()


def shared_bands(bands: DataFrame, memory: DataFrame, as_of, window_days: int = WINDOW_DAYS, least: int = 1) -> DataFrame:
    """id, shared of rows (id, band, band_hash): the most bands that one remembered document within the window shares, of those that share ``least``.

    Documents with equal bands throughout, as copies have, meet as one on either side, so a band that thousands
    of copies share gives one row.  Pairs are candidates by their rarest bands, and each is then counted on all of them.
    """
    fresh = forgotten(memory, as_of, window_days).select("content_hash", "band", "band_hash").distinct()
    alike = _first_of_alike(bands, "id")
    probes = bands.join(alike.select(F.col("first").alias("id")).distinct(), "id", "left_semi")
    known = fresh.join(_first_of_alike(fresh, "content_hash").select(F.col("first").alias("content_hash")).distinct(), "content_hash", "left_semi")
    pairs = candidate_pairs(probes, known, least)
    whole = lambda df, key, name: df.groupBy(key).agg(F.collect_list(F.struct("band", "band_hash")).alias(name))
    both = pairs.join(whole(probes, "id", "asked"), "id").join(whole(known, "content_hash", "held"), "content_hash")
    hits = both.select("id", "content_hash", F.size(F.array_intersect("asked", "held")).alias("n")).filter(F.col("n") >= least)
    most = hits.groupBy(F.col("id").alias("first")).agg(F.max("n").cast("int").alias("shared"))
    return alike.join(most, "first").select("id", "shared")


def near_duplicates(bands: DataFrame, memory: DataFrame, as_of, required: int | None = None, window_days: int = WINDOW_DAYS) -> DataFrame:
    """id of the rows that share ``required`` bands with a remembered document."""
    return shared_bands(bands, memory, as_of, window_days, required or required_bands()).select("id")


def unknown_bands(memory: DataFrame, new: DataFrame) -> DataFrame:
    """The new (content_hash, band, band_hash, seen_at) that the memory lacks."""
    keys = ["content_hash", "band_hash"]
    return new.dropDuplicates(keys).join(memory.select(*keys), keys, "left_anti").select(*memory.columns)


def remembered(memory: DataFrame, new: DataFrame) -> DataFrame:
    """The memory with the new bands that it lacks."""
    return memory.unionByName(unknown_bands(memory, new))


def forgotten(memory: DataFrame, as_of, window_days: int = WINDOW_DAYS) -> DataFrame:
    """The memory without what is older than the window."""
    return memory.filter(F.col("seen_at") >= as_of - F.make_dt_interval(days=F.lit(window_days)))

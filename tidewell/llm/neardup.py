"""Near-duplicate documents by order MinHash.

Method: a text is the sequence of its runs of K words (k-mers), each labelled with how often it has
occurred before, so that the labelled k-mers of a text are all different.  For each of BANDS hash
functions the MINIMA least k-mers are kept in the order in which they stand in the text; two texts
that draw the same ordered tuple become candidates.  The chance grows with the share of common
k-mers and with how well their order agrees, which is what edit similarity needs.

A pair is verified by banded alignment of its whole word sequences: the longest common subsequence of
s words within the band that no pair of enough similarity leaves gives s / (m + n - s), and THRESHOLD
links.  One changed word breaks K k-mers, so near copies share far fewer k-mers than words.

A short text has few k-mers, and one changed word may leave none of them.  Texts of SHORT words or
fewer therefore meet in further buckets: labelled words in a common order, rarest first, of which two texts of
similarity t share one among the first n - ceil(t n) + 1 of either.  No link between such texts is lost.

Texts of equal words are one class at once.  The distinct texts of a bucket are then settled in two steps:

1. Likeness, the share of common labelled words, is estimated by a sketch of LANES one-byte minima, and the pairs
   of a maximum spanning forest over all pairs at SCREEN or above are verified.  A bucket of more than CHUNK texts
   is cut into groups of alike texts, and its HUBS most central texts meet all its groups.  Where all pairs
   of the forests hold, as in families of copies, the bucket is settled: linear in its size.
2. In each bucket whose texts are still in different components, every pair between components at SCREEN
   or above is aligned in its task until it is linked or refuted; what is sent and returned is linear in the
   texts.  In a cut bucket all texts outside its main component meet all of its groups, in blocks of
   CHUNK texts on either side, each a unit of work of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import TEXTS_A_BATCH, joined_with_hot, stage
from tidewell.llm.graphs import components
from tidewell.llm.terms import kmers, mixed, occurrences, stretches, word_hashes

K = 5
THRESHOLD = 0.8
BANDS = 20
MINIMA = 2
LANES = 128
#: Share of common words by sketch below which a pair isn't aligned.  A link shares THRESHOLD at least, and the sketch errs by 0.035 (one standard deviation) there.
SCREEN = 0.65
#: Words up to which texts meet by their rarest words as well, how many of these they have at most, and cells of the table of the words' counts.
SHORT = 80
PREFIX = SHORT - -(-SHORT * 4 // 5) + 1
CELLS = 1 << 18
#: Rows of a bucket that one comparison sees; larger buckets are cut into groups.
CHUNK = 2048
#: Hubs of a cut bucket, and those that each of its groups proposes.
HUBS, OWN_HUBS = 64, 8
#: Tasks that share a component when its texts get its name.
SALTS = 16
#: Rows of keys, of 60 bytes at most, up to which they go to every task that has texts; more are a join for which texts are shuffled.
SENT = 100_000
#: Lists of texts that a task sees at a time.
UNITS_A_BATCH = 32

#: Rows with a sketch that go to one file.
WIDE_A_FILE = 25_000
#: Buckets that a text is in at most.
ROWS = BANDS + PREFIX

_SEED = np.random.default_rng(77).integers(1, 1 << 63, LANES, dtype=np.uint64) | np.uint64(1)
_SKETCHED = "doc_id long, raw binary, words binary, n int, sketch binary, buckets array<long>, short binary"


def labels(words: np.ndarray) -> np.ndarray:
    """Values with the number of their occurrence: all different."""
    return mixed(words + occurrences(words).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) if len(words) else words


def _hashed(lanes: slice, found: np.ndarray) -> np.ndarray:
    h = _SEED[lanes, None] * found[None, :]
    h ^= h >> np.uint64(32)
    return h


def sketch(words: np.ndarray) -> bytes:
    """One byte for each lane, of a text's labelled words."""
    low = np.empty(LANES, np.uint8)
    each = max(1, 400_000 // len(words))
    for lane in range(0, LANES, each):
        at = _hashed(slice(lane, lane + each), words).argmin(axis=1)
        low[lane : lane + each] = (words[at] * np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(56)
    return low.tobytes()


def tuples(found: np.ndarray) -> list[int]:
    """A key for each band, of a text's labelled k-mers: the MINIMA least, in the order of the text."""
    out: list[int] = []
    each = max(1, 400_000 // len(found))
    for band in range(0, BANDS, each):
        bands = np.arange(band, min(BANDS, band + each))
        h = _hashed(slice(band, band + len(bands)), found)
        least = [h.argmin(axis=1)]
        for _ in range(min(MINIMA, len(found)) - 1):
            h[np.arange(len(bands)), least[-1]] = np.iinfo(np.uint64).max
            least.append(h.argmin(axis=1))
        key = bands.astype(np.uint64)
        for column in np.sort(np.stack(least), axis=0):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + found[column])
        out += key.view(np.int64).tolist()
    return out


def aligned(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity s / (m + n - s) of two word sequences, s the length of their longest common subsequence within the band; 0.0 below THRESHOLD."""
    m, n = len(a), len(b)
    if not m or not n:
        return float(m == n)
    if min(m, n) < THRESHOLD * max(m, n):
        return 0.0
    # So many words are common at THRESHOLD, so no common word is further off its place.
    least = int(np.ceil(THRESHOLD * (m + n) / (1 + THRESHOLD) - 1e-9))
    band = max(m, n) - least
    same = a[: min(m, n)] == b[: min(m, n)]
    front = int(same.argmin()) if not same.all() else len(same)
    same = a[m - (min(m, n) - front) :][::-1] == b[n - (min(m, n) - front) :][::-1]
    back = (int(same.argmin()) if not same.all() else len(same)) if len(same) else 0
    left, right = a[front : m - back].tolist(), b[front : n - back].tolist()
    # The columns of the alignment as bits of one number: a bit of ``open_`` is 0 where the subsequence grew.
    places: dict[int, int] = {}
    for i, word in enumerate(left):
        places[word] = places.get(word, 0) | 1 << i
    every, within = (1 << len(left)) - 1, (1 << 2 * band + 1) - 1
    open_ = every
    for j, word in enumerate(right):
        hit = places.get(word)
        if hit:
            hit &= open_ & (within << j - band if j > band else within >> band - j)
            open_ = (open_ + hit) | (open_ - hit)
    s = front + back + len(left) - (open_ & every).bit_count()
    return s / (m + n - s) if s >= least else 0.0


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SKETCHED.split(", ")]
    for batch in batches:
        ids, raws, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
        for start, stop in stretches(texts):
            keys, ns, sketches, buckets, shorts = [], [], [], [], []
            done: dict[bytes, tuple] = {}
            for words in word_hashes(texts[start:stop]):
                key = hashlib.blake2b(words.tobytes(), digest_size=16).digest()
                if key not in done:
                    own = labels(words)
                    done[key] = (len(words), sketch(own), tuples(labels(kmers(words, K))), own.tobytes() if len(words) <= SHORT else None) if len(words) else (0, b"", [], None)
                keys.append(key)
                for out, got in zip((ns, sketches, buckets, shorts), done[key]):
                    out.append(got)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(start, stop - start), raws.slice(start, stop - start), pa.array(keys, pa.binary()), pa.array(ns, pa.int32()), pa.array(sketches, pa.binary()), pa.array(buckets, pa.list_(pa.int64())), pa.array(shorts, pa.binary())], names=names)


def _cells(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - (CELLS.bit_length() - 1))).astype(np.int64)


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(CELLS, np.int64)
    for batch in batches:
        for own in batch.column(0):
            np.add.at(sums, _cells(np.frombuffer(own.as_py(), np.uint64)), 1)
    at = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at])], names=["cell", "n"])


def rare_words(short: DataFrame) -> DataFrame:
    """words, lane, bucket: the buckets of short texts (words, lane, short) by their rarest labelled words.

    Rarity is told by counts of hashed words in a table of CELLS; any order would lose nothing, as it is the same for all texts.
    """
    got = short.select("short").mapInArrow(_cell_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[got.column(0).to_numpy()] = got.column(1).to_numpy()
    table = short.sparkSession.sparkContext.broadcast(counts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [np.zeros(0, np.int64)], []
            for own in batch.column(2):
                words = np.frombuffer(own.as_py(), np.uint64)
                order = np.lexsort((words, table.value[_cells(words)]))
                n = len(words) - int(np.ceil(THRESHOLD * len(words) - 1e-9)) + 1
                found.append(mixed(words[order[:n]] + np.uint64(1)).view(np.int64))
                sizes.append(n)
            each = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(each), batch.column(1).take(each), pa.array(np.concatenate(found))], names=["words", "lane", "bucket"])

    return short.mapInArrow(work, "words binary, lane int, bucket long")


def compared(ns: np.ndarray, sketches: np.ndarray) -> tuple[set[tuple[int, int]], np.ndarray]:
    """Pairs of rows to verify, those of the maximum spanning forest over all pairs at SCREEN or above, and how central each row is."""
    size, out = len(ns), set()
    best, best_of, inside, central = np.full(size, -1.0), np.zeros(size, np.int64), np.zeros(size, bool), np.zeros(size)
    at = 0
    for _ in range(size):
        inside[at] = True
        like = likeness(ns, sketches, ns[at], sketches[at])
        like[at] = 0.0
        central[at] = like[like >= SCREEN].sum()
        better = like > best
        best[better], best_of[better] = like[better], at
        rest = np.where(inside, -2.0, best)
        nxt = int(rest.argmax())
        if rest[nxt] >= SCREEN:
            out.add((min(nxt, int(best_of[nxt])), max(nxt, int(best_of[nxt]))))
        at = nxt
    return out, central


def likeness(ns: np.ndarray, sketches: np.ndarray, n: int, sketch: np.ndarray) -> np.ndarray:
    """Shares of common words with one text, by sketch; 0 where the lengths alone refute a link."""
    like = (sketches == sketch).mean(axis=1)
    like[np.minimum(ns, n) < THRESHOLD * np.maximum(ns, n)] = 0.0
    return like


def _matrix(members: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([m["n"] for m in members]), np.frombuffer(b"".join(m["sketch"] for m in members), np.uint8).reshape(len(members), LANES)


def _group_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of groups (bucket, members), and their hubs as (a, null, central)."""
    for batch in batches:
        out = []
        for bucket, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            members.sort(key=lambda m: m["words"])
            pairs, central = compared(*_matrix(members))
            out += [(bucket, members[x]["words"], members[y]["words"], None) for x, y in sorted(pairs)]
            out += [(bucket, members[x]["words"], None, round(float(central[x]), 3)) for x in np.argsort(-central, kind="stable")[:OWN_HUBS].tolist()]
        cols = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.float64()))], names=["bucket", "a", "b", "central"])


def _hub_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of the members of groups, each with the hub of its bucket that it is most like."""
    for batch in batches:
        a, b = [], []
        for members, hubs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            (ns, sketches), (hub_ns, hub_sketches) = _matrix(members), _matrix(hubs)
            like = np.stack([likeness(ns, sketches, n, h) for n, h in zip(hub_ns, hub_sketches)])
            like[np.array([[h["words"] == m["words"] for m in members] for h in hubs])] = 0.0
            no = like.argmax(axis=0)
            for at in np.flatnonzero(like.max(axis=0) >= SCREEN).tolist():
                x, y = sorted((members[at]["words"], hubs[no[at]]["words"]))
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def candidate_pairs(first: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(a, b: pairs of texts (words, n, sketch, buckets) to verify first, each once, the smaller key first; words, bucket, group: the texts of buckets of more than two)."""
    # Sketches join only those that share a bucket, so they aren't sent for every bucket of every text.
    lane = F.conv(F.hex(F.substring("sketch", 51, 2)), 16, 10).cast("int").alias("lane")
    short = rare_words(first.filter("short IS NOT NULL").select("words", lane, "short"))
    held = stage(first.select("words", lane, F.explode("buckets").alias("bucket")).unionByName(short), "buckets", ROWS * n)
    sizes = stage(held.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes", ROWS * n // 2)
    held = stage(joined_with_hot(held, sizes, ["bucket"], ROWS * n), "held", ROWS * n)
    sketched = first.select("words", "n", "sketch")
    listed = F.collect_list(F.struct("words", "n", "sketch")).alias("members")
    groups = held.filter(F.col("size") <= CHUNK).select("words", "bucket").join(sketched, "words").groupBy("bucket").agg(listed)
    out = "bucket long, a binary, b binary, central double"
    pairs = groups.mapInArrow(_group_pairs, out).filter("b IS NOT NULL").select("a", "b")
    many = held.filter(F.col("size").between(3, CHUNK)).select("words", "bucket", F.lit(0).cast("long").alias("group"))
    # A large bucket is cut by two lanes of the sketch, which alike texts mostly share, and where that isn't enough by the text.
    cut = held.filter(F.col("size") > CHUNK).select("words", "bucket", F.pmod(F.xxhash64("lane"), F.ceil(F.col("size") / CHUNK)).alias("part"))
    if not cut.limit(1).count():
        return pairs.distinct(), many
    parts = stage(cut.groupBy("bucket", "part").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("n_groups")), "parts", ROWS * n // CHUNK)
    cut = cut.join(parts, ["bucket", "part"]).withColumn("group", F.col("part") * F.lit(1 << 32) + F.pmod(F.xxhash64("words", F.lit(1)), F.col("n_groups")))
    cut_groups = stage(cut.join(sketched, "words").groupBy("bucket", "group").agg(listed).select("bucket", "members"), "groups")
    within = stage(cut_groups.mapInArrow(_group_pairs, out), "within", batch=UNITS_A_BATCH)
    best = Window.partitionBy("bucket").orderBy(F.desc("central"), "a")
    hubs = within.filter("b IS NULL").withColumn("no", F.row_number().over(best)).filter(F.col("no") <= HUBS)
    hubs = hubs.select("bucket", F.col("a").alias("words")).join(sketched, "words").groupBy("bucket").agg(F.collect_list(F.struct("words", "n", "sketch")).alias("hubs"))
    across = cut_groups.join(hubs, "bucket").select("members", "hubs").mapInArrow(_hub_pairs, "a binary, b binary")
    return pairs.unionByName(within.filter("b IS NOT NULL").select("a", "b")).unionByName(across).distinct(), many.unionByName(cut.select("words", "bucket", "group"))


def _open_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, own, words, root) of the texts of units (own, members) that have a pair at SCREEN or above in another component."""
    for batch in batches:
        out = []
        for unit, own, members in zip(*(c.to_pylist() for c in batch.columns)):
            ns, sketches = _matrix(members)
            roots = np.array([m["root"].hex() for m in members])
            partners = np.zeros(len(members), bool)
            for m in own:
                open_ = (likeness(ns, sketches, m["n"], np.frombuffer(m["sketch"], np.uint8)) >= SCREEN) & (roots != m["root"].hex())
                if open_.any():
                    partners |= open_
                    out.append((unit, True, m["words"], m["root"]))
            out += [(unit, False, members[i]["words"], members[i]["root"]) for i in np.flatnonzero(partners).tolist()]
        cols = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.bool_(), pa.binary(), pa.binary()))], names=["unit", "own", "words", "root"])


def open_texts(groups: DataFrame, first: DataFrame, roots: DataFrame, n: int) -> DataFrame:
    """What _open_texts finds in the groups (words, bucket, group) of buckets with several components: (unit, own, words, root).

    Texts of the component that most of a bucket is in meet those of others only as the latter's partners.
    """
    placed = groups.join(roots.withColumnRenamed("node", "words"), "words", "left").withColumn("root", F.coalesce("root", "words"))
    placed = stage(placed, "placed", n)

    def several(placed: DataFrame) -> DataFrame:
        """main: the largest component of each bucket that holds more; size, rest: texts in the bucket and outside main."""
        by_root = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
        of = by_root.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("n_roots")).filter("n_roots > 1")
        return of.select("bucket", F.col("most.root").alias("main"), "size", (F.col("size") - F.col("most.n")).alias("rest"))

    found = stage(several(placed), "several", n // 3)
    open_ = placed.join(found, "bucket")
    listed = open_.join(first.select("words", "n", "sketch"), "words").groupBy("bucket", "group").agg(F.collect_list(F.struct("words", "n", "sketch", "root")).alias("members"), F.first("main").alias("main"), F.first("rest").alias("rest"))
    listed = stage(listed, "listed")
    # The texts outside the main component in as few parts as hold CHUNK each, which meet all groups of the bucket; each part's units are a key of their own.
    outside = listed.select("bucket", "rest", F.explode(F.filter("members", lambda m: m["root"] != F.col("main"))).alias("text"))
    parts = F.ceil(F.col("rest") / CHUNK)
    own = outside.groupBy("bucket", F.pmod(F.xxhash64("text.words", F.lit(3)), parts).alias("part")).agg(F.collect_list("text").alias("own"))
    units = own.join(listed.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.col("group").alias("other"), "members"), ["bucket", "part"])
    return units.select(F.xxhash64("bucket", "part", "other").alias("unit"), "own", "members").mapInArrow(_open_texts, "unit long, own boolean, words binary, root binary")


def settled(unit: list[dict]) -> Iterator[tuple[bytes, bytes]]:
    """Links (a, b) that join components of a unit's texts (own, words, root, seq): every pair of an own text and another that isn't yet in one component is aligned."""
    own, members = [[t for t in unit if t["own"] == side] for side in (True, False)]
    parent: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    seqs = [np.frombuffer(t["seq"], np.uint32) for t in members]
    if not own or not members:
        return
    # Words labelled with their occurrences: the number that two texts share bounds their alignment.
    names = [labels(s.astype(np.uint64)) for s in seqs]
    every, holder = np.concatenate(names), np.repeat(np.arange(len(names)), [len(x) for x in names])
    order = np.argsort(every, kind="stable")
    every, holder = every[order], holder[order]
    sizes = np.array([len(s) for s in seqs])
    for t in sorted(own, key=lambda t: t["words"]):
        seq = np.frombuffer(t["seq"], np.uint32)
        mine = labels(seq.astype(np.uint64))
        a, b = np.searchsorted(every, mine, "left"), np.searchsorted(every, mine, "right")
        at = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange((b - a).sum())
        common = np.bincount(holder[at], minlength=len(seqs))
        able = common >= THRESHOLD * (sizes + len(seq)) / (1 + THRESHOLD) - 1e-9
        for j in np.flatnonzero(able)[np.argsort(-common[able], kind="stable")].tolist():
            if top(t["root"]) != top(members[j]["root"]) and aligned(seq, seqs[j]) >= THRESHOLD:
                parent[top(members[j]["root"])] = top(t["root"])
                yield t["words"], members[j]["words"]


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [pair for unit in batch.column(0).to_pylist() for pair in settled(unit)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], names=["a", "b"])


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(words, seq) of (words, text): the text's words as hashes of 32 bits."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for start, stop in stretches(texts):
            seqs = [(w >> np.uint64(32)).astype("<u4").tobytes() for w in word_hashes(texts[start:stop])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(seqs, pa.binary())], names=["words", "seq"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [aligned(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) >= THRESHOLD for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, raw (MD5 of the text), class_id, first for each row of ``docs``: class_id is the smallest
    doc_id of its class, and first tells whether the row is the one that names it.

    A null text counts as empty; texts without words are one class of copies.  A null id takes part like any other and counts as
    the smallest only in a class of null ids.  An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("raw"), text.alias("text"))
    table = stage(rows.mapInArrow(_sketches, _SKETCHED), "sketches", batch=TEXTS_A_BATCH)
    # A row for each distinct sequence of words; copies are summed before the shuffle.
    first = table.groupBy("words").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "raw")).alias("least"), *[F.first(c).alias(c) for c in ("n", "sketch", "buckets", "short")])
    first = stage(first.select("words", F.col("least.doc_id").alias("doc_id"), F.col("least.raw").alias("raw"), "n", "sketch", "buckets", "short"), "distinct", table.count(), a_file=WIDE_A_FILE)
    n = first.count()
    pairs, groups = candidate_pairs(first, n)
    # A text is in ROWS buckets at most, in each of which the forest has fewer pairs than texts.
    pairs, groups = stage(pairs, "pairs", ROWS * n, TEXTS_A_BATCH), stage(groups, "many", ROWS * n)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("words")).unionByName(groups.select("words")).distinct()
    # One text for each, found by its MD5 and id, so that its copies don't meet in one task.
    wanted = stage(first.join(needed, "words").select("words", "raw", "doc_id"), "wanted", n)
    found = rows.join(_sent(wanted), (rows["raw"] == wanted["raw"]) & rows["doc_id"].eqNullSafe(wanted["doc_id"])).select("words", "text").dropDuplicates(["words"])
    found = stage(found.mapInArrow(_sequences, "words binary, seq binary"), "sequences", batch=TEXTS_A_BATCH)
    side = lambda x: found.select(F.col("words").alias(x), F.col("seq").alias(f"seq_{x}"))
    links = stage(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "seq_a", "seq_b").mapInArrow(_verified, "a binary, b binary"), "verified", ROWS * n, TEXTS_A_BATCH, True)
    roots = components(links, pairs.count())
    open_ = stage(open_texts(groups, first, roots, groups.count()), "open", groups.count(), UNITS_A_BATCH, True)
    if open_.limit(1).count():
        units = open_.join(found, "words").groupBy("unit").agg(F.collect_list(F.struct("own", "words", "root", "seq")).alias("texts"))
        more = stage(units.select("texts").mapInArrow(_settled, "a binary, b binary"), "settled", n, UNITS_A_BATCH, True)
        if more.limit(1).count():
            roots = components(links.unionByName(more), links.count() + more.count())
    # A class is named by its smallest document.
    own = F.struct(F.col("doc_id").isNull(), "doc_id", "raw").alias("own")
    linked = first.select("words", own).join(roots, F.col("words") == F.col("node"))
    named = linked.groupBy("root").agg(F.min("own").alias("least"))
    # A component may hold a third of all texts: its name goes to SALTS tasks.
    salted = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    merged = linked.select("words", "root", F.pmod(F.xxhash64("words"), F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["root", "salt"]).select("words", "least")
    of_words = stage(first.select("words", own).join(merged, "words", "left").select("words", F.coalesce("least", "own").alias("least")), "classes", n)
    joined = table.select("doc_id", "raw", "words").join(of_words, "words")
    return joined.select("doc_id", "raw", F.col("least.doc_id").alias("class_id"), (F.col("least.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("least.raw") == F.col("raw"))).alias("first"))


def _sent(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= SENT else keys


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class, that with the smallest id; equal rows of it are one."""
    named = classes(docs, id_col, text_col)
    # One key of id and text: copies of a text don't meet in one task.
    key = lambda id_, raw: F.unhex(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("-")).cast("binary"), raw)))
    keys = named.groupBy(key(F.col("doc_id"), F.col("raw")).alias("_key")).agg(F.max("first").alias("first"), F.count(F.lit(1)).alias("n"))
    keys = stage(keys.filter("NOT first OR n > 1"), "keys")  # of what goes, and of rows that are there more than once
    own = key(F.col(id_col).cast("long"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    rows = docs.select(F.struct("*").alias("_doc"), own.alias("_key"))
    once = rows.join(_sent(keys.select("_key")), "_key", "left_anti")
    again = rows.join(_sent(keys.filter("first").select("_key")), "_key", "left_semi").dropDuplicates(["_key"])
    return once.unionByName(again).select("_doc.*")

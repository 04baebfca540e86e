"""What filters do to a corpus in every order: a packed bitmap index.

Method: a task packs its rows' filter failures and labels into bitsets of 64-bit words, each part of the
corpus (as a source) in words of its own, so that a part's bitmap is a range of words.  What is left
after a set of filters is the rows AND-NOT the failures of each; popcounts of it, and of its overlap with
the labels, are summed by part.  Of five filters there are 2^5 sets, each one AND-NOT away from
a smaller one.  Sums over tasks then give all orders: what a filter removes as the next step depends only
on the set before it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import TEXTS_A_BATCH, stage

LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
_CAPITALS, _SIGNS, _CONTINUED = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|", bytes(range(0x80, 0xC0))
#: Parts whose sums a task holds at a time.
PARTS = 1024


def failures(text: bytes) -> int:
    """Which of the filters A to D a text (UTF-8) fails, a bit for each."""
    words, without = text.split(), lambda signs: len(text.translate(None, signs))  # bytes split at ASCII white space
    n, capitals = len(words), len(text) - without(_CAPITALS)
    fails = (n < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * without(_CONTINUED), without(_SIGNS) < len(text))
    return sum(failed << no for no, failed in enumerate(fails))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, part, digest, fails) of (doc_id, part, text): the text's SHA-256, and its failures."""
    for batch in batches:
        digests, fails = [], []
        for text in batch.column(2):
            raw = text.as_py()
            digests.append(hashlib.sha256(raw).digest())
            fails.append(failures(raw))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(fails, pa.int32())], names=["doc_id", "part", "digest", "fails"])


def judged(docs: DataFrame, labels: DataFrame, part: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, fails (a bit for each of LETTERS), good, toxic of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    table = stage(rows.mapInArrow(_judged, "doc_id long, part string, digest binary, fails int"), "judged", batch=TEXTS_A_BATCH)
    known = table.filter("doc_id IS NOT NULL")
    # Of each text the smallest document passes E.  Copies are folded before the shuffle and found again by id and text, so that no text is a hot key.
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    said = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    joined = known.join(first, ["doc_id", "digest"], "left").join(said, "doc_id", "left")
    late = F.when(F.col("first").isNull(), 1 << LETTERS.index("E")).otherwise(0)
    yes = lambda name: F.coalesce(name, F.lit(False)).alias(name)
    nameless = table.filter("doc_id IS NULL").select("part", "fails", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return joined.select("part", (F.col("fails") + late).alias("fails"), yes("good"), yes("toxic")).unionByName(nameless)


def indexed(parts: np.ndarray, n_parts: int, fails: np.ndarray, marks: np.ndarray, n_filters: int) -> np.ndarray:
    """Counts (part, set of filters, mark) of what the sets leave, by bitsets: mark 0 is all rows, mark i those with bit i - 1 of ``marks``; each part has rows."""
    sizes = np.bincount(parts, minlength=n_parts)
    words = -(-sizes // 64)
    begins = np.cumsum(words) - words
    order = np.argsort(parts, kind="stable")
    place = np.empty(len(parts), np.int64)
    place[order] = np.arange(len(parts)) + np.repeat(begins * 64 - (np.cumsum(sizes) - sizes), sizes)

    def bitset(held: np.ndarray) -> np.ndarray:
        bits = np.zeros(int(words.sum()) * 64, bool)
        bits[place[held]] = True
        return np.packbits(bits, bitorder="little").view(np.uint64)

    failed = [bitset((fails >> i & 1).astype(bool)) for i in range(n_filters)]
    left = np.empty((1 << n_filters, int(words.sum())), np.uint64)
    left[0] = bitset(np.ones(len(parts), bool))  # the parts' own bitmaps, side by side
    for subset in range(1, 1 << n_filters):
        lowest = subset & -subset
        left[subset] = left[subset ^ lowest] & ~failed[lowest.bit_length() - 1]
    n_marks = 1 + int(marks.max(initial=1)).bit_length()
    held = [left] + [left & bitset((marks >> i & 1).astype(bool)) for i in range(n_marks - 1)]
    return np.stack([np.add.reduceat(np.bitwise_count(h).astype(np.int64), begins, axis=1).T for h in held], axis=2)


def left_by_subset(rows: DataFrame, n_filters: int) -> DataFrame:
    """part, subset, n, good, toxic of rows (part, fails, good, toxic): what each set of filters leaves of each part, zeros included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def sent() -> pa.RecordBatch:
            flat = np.concatenate([*sums.values(), np.zeros((0, 3), np.int64)])
            parts = pa.array([p for p in sums for _ in range(1 << n_filters)], pa.string())
            subsets = pa.array(np.tile(np.arange(1 << n_filters, dtype=np.int32), len(sums)))
            sums.clear()
            return pa.RecordBatch.from_arrays([parts, subsets, *(pa.array(np.ascontiguousarray(c)) for c in flat.T)], names=["part", "subset", "n", "good", "toxic"])

        for batch in batches:
            if not len(batch):
                continue
            coded = batch.column(0).dictionary_encode()
            names, fails = coded.dictionary.to_pylist(), batch.column(1).to_numpy()
            good, toxic = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            # A third mark that all rows have keeps both labels' counts where no row has them.
            counts = indexed(coded.indices.to_numpy(), len(names), fails, good | toxic << 1 | 4, n_filters)
            for name, each in zip(names, counts[:, :, :3]):
                if name in sums:
                    sums[name] += each
                else:
                    sums[name] = each.copy()
            if len(sums) > PARTS:
                yield sent()
        yield sent()

    counted = rows.select("part", "fails", "good", "toxic").mapInArrow(count, "part string, subset int, n long, good long, toxic long")
    return counted.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def interactions(rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step and the counts of query() of rows (part, fails, good, toxic), for all orders of the filters, a bit of ``fails`` and a letter each."""
    n, every = len(letters), (1 << len(letters)) - 1
    sets = left_by_subset(rows, n).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("sets"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    each = sets.select("part", "sets", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    # The set before the step, as bits, and the step's own bit.
    bits = lambda text: sum((F.when(F.contains(text, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(letters)), F.lit(0))
    each = each.withColumns({"before": bits(F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1)), "own": bits(F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))})
    before, own = F.col("before"), F.col("own")
    left = lambda subset, what="n": F.get("sets", subset)[what]
    lost = lambda subset, what="n": left(subset, what) - left(subset.bitwiseOR(own), what)
    # A set of k filters stands before the step in k! (n - 1 - k)! orders.
    weight = F.array(*[F.lit(math.factorial(s.bit_count()) * math.factorial(max(0, n - 1 - s.bit_count()))).cast("long") for s in range(1 << n)])
    shapley = F.aggregate(F.sequence(F.lit(0), F.lit(every)), F.lit(0).cast("long"), lambda total, s: total + F.get(weight, s) * lost(s))
    return each.select(
        "part", "filter_order", "step", left(before.bitwiseOR(own)).alias("kept"), lost(before).alias("removed"), (lost(F.lit(0)) - lost(before)).alias("redundant"), lost(F.lit(every).bitwiseXOR(own)).alias("unique_fails"),
        lost(before, "good").alias("good_lost"), lost(before, "toxic").alias("toxic_lost"), shapley.alias("shapley"),
    )


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text counts as empty, a null part as ''.  A document without an id passes E and has no labels; rows of one id and text
    are one document's and pass E together.  A document with several labels is good or toxic if any says so.  An empty table gives no rows.
    """
    return interactions(judged(docs, labels, F.col("source")))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails,
  coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM w LEFT JOIN (SELECT doc_id AS id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1) l ON l.id = doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step, list_transform(string_split(filter_order, ''), lambda y: ascii(y) - 64) AS ord FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, CAST(step AS INT) AS step, ord[step] AS own,
  sum(n) FILTER (NOT list_bool_or(list_transform(ord[1:step], lambda i: fails[i]))) AS kept,
  sum(n) FILTER (fails[ord[step]] AND NOT coalesce(list_bool_or(list_transform(ord[1:step - 1], lambda i: fails[i])), false)) AS removed,
  sum(n) FILTER (fails[ord[step]] AND coalesce(list_bool_or(list_transform(ord[1:step - 1], lambda i: fails[i])), false)) AS redundant,
  sum(n) FILTER (fails[ord[step]] AND list_sum(list_transform(fails, lambda b: CAST(b AS INT))) = 1) AS unique_fails,
  sum(good) FILTER (fails[ord[step]] AND NOT coalesce(list_bool_or(list_transform(ord[1:step - 1], lambda i: fails[i])), false)) AS good_lost,
  sum(toxic) FILTER (fails[ord[step]] AND NOT coalesce(list_bool_or(list_transform(ord[1:step - 1], lambda i: fails[i])), false)) AS toxic_lost
  FROM g, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""

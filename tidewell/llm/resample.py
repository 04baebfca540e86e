"""Documents drawn by how a target distribution weighs their words.

Method: a text's features are its runs of 1 to ``longest`` words, hashed to buckets; a bucket's gain is
the log ratio of its shares in the target and in the corpus, and a document's weight the sum of its
features' gains.  Gumbel noise on the weights and the highest scores make a draw without replacement.

Long texts would be skewed work for one task: they are split at word boundaries into chunks that are dealt
out anew.  A chunk carries longest - 1 words of the next one and owns the features that start in it, so
each feature counts once; counts of buckets are summed over all chunks, features and weights by document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import TEXTS_A_BATCH, partitions, stage

BUCKETS = 10_000
LEAST_WORDS = 20
DRAWN_PERCENT = 10
SEED = 2024
#: Bytes from which on a text is split, and of its chunks.
CHUNK_BYTES = 65_536

#: Letters in lower case; what parts words as a space.
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_CHUNK = "row long, doc_id long, own binary, carried binary"
_FEATURES = "row long, doc_id long, n_words long, buckets binary"


def split(text: bytes, size: int, carry: int) -> Iterator[tuple[bytes, bytes]]:
    """(words of its own, words carried) of the chunks of a text, each of about ``size`` bytes, ended by a space or the text's end."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        upto = end
        for _ in range(carry):
            while text[upto : upto + 1] == b" ":
                upto += 1
            upto = text.find(b" ", upto) if text.find(b" ", upto) >= 0 else len(text)
        yield text[at:end], text[end:upto]
        at = end


def hashed(own: bytes, carried: bytes, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """(words, buckets of the features that start in them) of a chunk."""
    words = own.split()
    n, every = len(words), words + (carried.split() if longest > 1 else [])
    crcs = list(map(zlib.crc32, every))
    found = crcs[:n]
    ends = [b" " + w for w in every]
    for k in range(1, longest):
        crcs = list(map(zlib.crc32, ends[k:], crcs))  # a run goes on by one more word
        found += crcs[:n]
    return n, (np.array(found, np.uint32) % np.uint32(buckets)).astype("<u4")


def features(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS, chunk_bytes: int = CHUNK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_FEATURES of every text, a row for each chunk: row tells the texts apart that have several, and is null for the others."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(*batch.columns):
                chunks = list(split(text.as_py().translate(_PLAIN), chunk_bytes, longest - 1))
                cols = [[row.as_py()] * len(chunks), [doc_id.as_py()] * len(chunks), *zip(*chunks)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["row", "doc_id", "own", "carried"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, found = [], []
            for own, carried in zip(batch.column(2), batch.column(3)):
                n, of = hashed(own.as_py().translate(_PLAIN), carried.as_py(), longest, buckets)
                ns.append(n)
                found.append(of.astype("<u2").tobytes() if buckets <= 1 << 16 else of.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(found, pa.binary())], names=["row", "doc_id", "n_words", "buckets"])

    long = F.octet_length("text") > chunk_bytes
    whole = rows.filter(~long).select(F.lit(None).cast("long").alias("row"), "doc_id", F.col("text").alias("own"), F.lit(b"").alias("carried"))
    chunks = rows.filter(long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(cut, _CHUNK).repartition(partitions(docs.sparkSession), "row", F.xxhash64("own"))
    return stage(whole.unionByName(chunks).mapInArrow(work, _FEATURES), "features", batch=TEXTS_A_BATCH)


def _width(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def bucket_counts(found: DataFrame, buckets: int) -> DataFrame:
    """bucket, n of what features() gives: summed in the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for each in batch.column(0):
                sums += np.bincount(np.frombuffer(each.as_py(), _width(buckets)), minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at])], names=["bucket", "n"])

    return found.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of every bucket, as whole thousandths, of counts (bucket, n): as many numbers as there are buckets."""
    spark = corpus.sparkSession
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    both = stage(both, "gains", buckets)
    most = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    up = (F.col("t") + 1).cast("double") * F.lit(float(most["s"] + buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(most["t"] + buckets))
    got = both.select("bucket", F.floor(1000.0 * F.log(up / down)).alias("gain")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def weighed(found: DataFrame, gain: np.ndarray, buckets: int) -> DataFrame:
    """doc_id, n_words, n_features, weight of each text of what features() gives."""
    table = found.sparkSession.sparkContext.broadcast(gain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [np.frombuffer(each.as_py(), _width(buckets)) for each in batch.column(3)]
            ns, sums = [len(x) for x in of], [int(table.value[x].sum()) for x in of]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ns, pa.int64()), pa.array(sums, pa.int64())], names=["row", "doc_id", "n_words", "n_features", "weight"])

    each = found.mapInArrow(work, "row long, doc_id long, n_words long, n_features long, weight long")
    long = each.filter("row IS NOT NULL").groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")])
    return each.filter("row IS NULL").drop("row").unionByName(long.drop("row"))


def ranked(rows: DataFrame, order: list, k: int, name: str = "rank") -> DataFrame:
    """``rows`` with their place in the order, from 1 on, and null beyond ``k``.

    The rows are sorted in ranges; the driver sees one number for each range.
    """
    sorted_ = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([own] * len(batch), pa.int32()), pa.array(np.arange(at, at + len(batch)))], names=[*batch.schema.names, "_range", "_no"])
            at += len(batch)

    placed = stage(sorted_.mapInArrow(number, f"{columns}, _range int, _no long"), "ranked")
    sizes = dict(placed.groupBy("_range").count().collect())
    before = np.cumsum([0, *(sizes.get(i, 0) for i in range(max(sizes, default=0)))]).tolist()
    rank = F.get(F.array(*[F.lit(x) for x in before]).cast("array<long>"), F.col("_range")) + F.col("_no") + 1
    return placed.withColumn(name, F.when(rank <= k, rank)).drop("_range", "_no")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, chunk_bytes: int = CHUNK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``: the drawn ones have ranks from 1 on, the others null.

    ``target`` has a column ``text_col`` as well.  A null text has no words; texts of fewer than ``least_words`` words aren't drawn.  Ties go to the smaller
    id, a null id last.  Repeated rows are rows of their own.  A null id draws its noise from the seed alone.  Without a target all gains
    follow the corpus; an empty table gives no rows.
    """
    found = features(docs, longest, buckets, chunk_bytes, id_col, text_col)
    aim = features(target.select(F.lit(None).cast("long").alias(id_col), text_col), longest, buckets, chunk_bytes, id_col, text_col)
    gain = gains(bucket_counts(found, buckets), bucket_counts(aim, buckets), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stage(weighed(found, gain, buckets).withColumn("score", F.col("weight") + noise), "scored")
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    # The row's number parts what is alike throughout, so that no range is one large tie.
    numbered = able.withColumn("_row", F.monotonically_increasing_id())
    placed = ranked(numbered, [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.asc("_row")], drawn)
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return placed.select(*out).unionByName(scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")).select(*out))


SQL = r"""
WITH RECURSIVE poly(i, k, v) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM poly WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM poly WHERE k = 8),
d AS (SELECT row_number() OVER () AS no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
dw AS (SELECT no, unnest(words) AS word FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
n AS (SELECT no, word, count(*) AS n FROM dw GROUP BY ALL),
v AS (SELECT DISTINCT word FROM (SELECT word FROM n UNION ALL SELECT word FROM bw)),
b AS (SELECT word, xor(4294967295, list_reduce(list_transform(range(1, octet_length(encode(word)) * 2, 2), lambda i: CAST('0x' || substr(hex(encode(word)), i, 2) AS BIGINT)),
  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295)) % 10000 AS bucket FROM v, crc),
s AS (SELECT bucket, sum(n) AS s FROM n JOIN b USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN b USING (word) GROUP BY 1),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket)),
w AS (SELECT no, sum(n * gain) AS weight FROM n JOIN b USING (word) JOIN g USING (bucket) GROUP BY 1),
e AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || doc_id), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS BIGINT) AS score
  FROM d LEFT JOIN w USING (no)),
r AS (SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM e WHERE n_features >= 20) THEN place END AS rank FROM r
"""

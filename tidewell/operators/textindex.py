"""Indexes of the shelf's texts as tables: words with their places, and trigrams for substrings.

An index is a folder of Parquet tables: ``entries`` (term, field, ids, places of each), ``sizes`` (how many texts a term
has) and ``changed`` (ids whose older entries no longer count).  Entries lie in a folder for each bucket of terms,
sorted by term, so that a search reads the buckets of its own terms and in them the row groups that hold these.  Texts are
dealt by id and each task lists the terms of its own, a block of texts at a time: words are never shuffled, a term has a row for each
block that it is in, and one that all texts have isn't one task's work.

A refresh adds a version with the entries of new and changed rows; older entries of these ids are left out
when read, until compacted() writes all anew.  A version that is written again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as T

BUCKETS = 32
FIELDS = ("title", "description")
#: The term of every text that isn't null, whatever its words.
EVERY = ""
GRAM = 3
#: Grams of a pattern whose lists are read: its rarest.
RAREST = 4
#: Terms of the texts that are listed together, about.
BLOCK = 1 << 20


def words(col: Column) -> Column:
    """A text's words in their order, behind EVERY; null of null."""
    return F.when(col.isNotNull(), F.concat(F.array(F.lit(EVERY)), T.words(col)))


def grams(col: Column) -> Column:
    """A text's different runs of GRAM lower-case characters, behind EVERY; null of null.  _grams_listed() gives the same for a block of texts."""
    chars = F.split(F.lower(col), "")
    # Shifted copies of the characters joined place by place: a lambda over places would split the text for each of them.
    shifted = [F.slice(chars, i + 1, F.greatest(F.size(chars) - GRAM + 1, F.lit(0))) for i in range(GRAM)]
    some = F.array_distinct(reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y)), shifted))
    return F.when(col.isNotNull(), F.concat(F.array(F.lit(EVERY)), some))


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _changes(x: np.ndarray) -> np.ndarray:
    """The places of an array that isn't empty where its value isn't the one before, the first included."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


def _lists(ids: pa.Array, key: np.ndarray, terms: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Of sorted different term * texts + text: the terms, where each one's texts begin, and their ids."""
    code, row = np.divmod(key, len(ids))
    each = _changes(code)
    return terms.take(pa.array(code[each])), pa.array(np.append(each, len(code)), pa.int32()), ids.take(pa.array(row))


def _words_listed(ids: pa.Array, words: pa.Array) -> list[pa.Array]:
    """Of texts' ids and arrays of words: each different word, the ids that have it and its places in each, which count from 1 on (EVERY has none)."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
    coded = words.flatten().dictionary_encode()
    row, place = np.repeat(np.arange(len(ids)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = coded.indices.to_numpy().astype(np.int64) * len(ids) + row
    order = np.argsort(key, kind="stable")  # by word, then by text, then by place
    key, place = key[order], place[order]
    pairs, kept = _changes(key), place > 0
    term, starts, own = _lists(ids, key[pairs], coded.dictionary)
    inner = np.append(0, np.cumsum(kept))[np.append(pairs, len(key))]
    places = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(place[kept], pa.int32()))
    return [term, pa.ListArray.from_arrays(starts, own), pa.ListArray.from_arrays(starts, places)]


def _grams_listed(ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
    """Of texts' ids and lower-case texts: each different gram and EVERY, and the ids that have it."""
    ids, texts = ids.filter(texts.is_valid()), texts.drop_null().to_pylist()
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    n = max(0, len(points) - GRAM + 1)
    code = reduce(lambda a, b: a << 21 | b, [points[i : n + i] for i in range(GRAM)])  # a code point has 21 bits
    inside = row[:n] == row[len(row) - n :]
    coded = pa.array(code[inside]).dictionary_encode()
    key = np.sort(coded.indices.to_numpy().astype(np.int64) * len(texts) + row[:n][inside])
    every = len(coded.dictionary) * len(texts) + np.arange(len(texts))
    runs = (coded.dictionary.to_numpy()[:, None] >> 21 * np.arange(GRAM)[::-1] & 0x1FFFFF).astype("<u4").tobytes().decode("utf-32-le")
    terms = pa.array([*(runs[i : i + GRAM] for i in range(0, len(runs), GRAM)), EVERY], pa.string())
    term, starts, own = _lists(ids, np.append(key[_changes(key)] if len(key) else key, every), terms)
    return [term, pa.ListArray.from_arrays(starts, own)]


@dataclass(frozen=True)
class Kind:
    """What of a text goes to the tasks that list terms, how long it is, how a block of texts is listed, and whether places are kept."""

    sent: Callable[[Column], Column]
    length: Callable[[pa.Array], pa.Array]
    listed: Callable[[pa.Array, pa.Array], list[pa.Array]]
    placed: bool


WORDS, GRAMS = Kind(words, pc.list_value_length, _words_listed, True), Kind(F.lower, pc.binary_length, _grams_listed, False)


def entries(rows: DataFrame, kind: Kind, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """bucket, term, field, ids and places (of each id from 1 on, in their order; of grams none) of rows with an id and the fields: a row for each block of texts that has the term."""
    names = ["term", "field", "ids"] + ["places"] * kind.placed

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, f in enumerate(fields, 1):
                ends = np.cumsum(pc.fill_null(kind.length(batch.column(no)), 0).to_numpy())
                cuts = [0, *(_changes(ends // BLOCK)[1:] if len(ends) else []), len(ends)]
                for at, to in zip(cuts, cuts[1:]):
                    ids, texts = batch.column(0).slice(at, to - at), batch.column(no).slice(at, to - at)
                    if texts.null_count < len(texts):
                        term, *lists = kind.listed(ids, texts)
                        yield pa.RecordBatch.from_arrays([term, pa.array([f] * len(term), pa.string()), *lists], names=names)

    id_type = rows.schema["id"].dataType.simpleString()
    blocks = rows.select("id", *[kind.sent(F.col(f)).alias(f) for f in fields]).mapInArrow(work, f"term string, field string, ids array<{id_type}>" + ", places array<array<int>>" * kind.placed)
    return blocks.withColumn("bucket", bucket(F.col("term")))


def single(blocks: DataFrame) -> DataFrame:
    """Entries with a row for each id."""
    own = [c for c in ("ids", "places") if c in blocks.columns]
    return blocks.select(*[c for c in blocks.columns if c not in own], F.inline(F.arrays_zip(*own))).withColumnRenamed("ids", "id")


def _write_entries(blocks: DataFrame, path: Callable[[str], str]) -> None:
    blocks.sortWithinPartitions("bucket", "term", "field", F.get("ids", F.lit(0))).write.mode("overwrite").partitionBy("bucket").parquet(path("entries"))
    sizes = blocks.sparkSession.read.parquet(path("entries")).groupBy("bucket", "term", "field").agg(F.sum(F.size("ids")).alias("n"))
    sizes.coalesce(BUCKETS).sortWithinPartitions("term").write.mode("overwrite").parquet(path("sizes"))


def write(rows: DataFrame, folder: str, kind: Kind, version: int = 0, gone: DataFrame | None = None, fields: tuple[str, ...] = FIELDS) -> None:
    """Write the entries of ``rows`` as a version of the index: the first with 0, a refresh with the next number and ``gone``, the ids that have left."""
    path = lambda table: f"{folder}/{table}/version={version}"
    _write_entries(entries(rows.select("id", *fields).repartition("id"), kind, fields), path)
    ids = rows.select("id") if version else rows.select("id").limit(0)
    (ids.unionByName(gone.select("id")) if gone is not None else ids).distinct().write.mode("overwrite").parquet(path("changed"))


def _counting(spark: SparkSession, folder: str, held: DataFrame) -> DataFrame:
    """Of entries of all versions those that still count, with a row for each id."""
    later = spark.read.parquet(f"{folder}/changed").select(F.col("id").alias("_id"), F.col("version").alias("_version"))
    return single(held).join(later, (F.col("id") == F.col("_id")) & (F.col("_version") > F.col("version")), "left_anti").drop("version")


def lookup(spark: SparkSession, folder: str, terms: list[str]) -> DataFrame:
    """The entries of the terms that still count, with a row for each id: reads the terms' buckets only."""
    # Constants that the planner folds, so that other buckets' folders aren't listed.
    own = [bucket(F.lit(t)) for t in terms]
    held = spark.read.parquet(f"{folder}/entries").filter(F.col("bucket").isin(own) & F.col("term").isin(terms))
    return _counting(spark, folder, held).drop("bucket")


def compacted(spark: SparkSession, folder: str, to: str) -> None:
    """Write what still counts as the first version of an index in another folder."""
    held = _counting(spark, folder, spark.read.parquet(f"{folder}/entries"))
    # Ids are dealt to blocks by their hash, as many as there are folders of terms.
    keys, lists = ["bucket", "term", "field"], [c for c in ("id", "places") if c in held.columns]
    whole = held.groupBy(*keys, F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).alias("block")).agg(F.sort_array(F.collect_list(F.struct(*lists))).alias("all")).drop("block")
    blocks = whole.select(*keys, F.col("all.id").alias("ids"), *[F.col(f"all.{c}").alias(c) for c in lists[1:]])
    _write_entries(blocks, lambda table: f"{to}/{table}/version=0")
    spark.read.parquet(f"{folder}/changed").select("id").limit(0).write.mode("overwrite").parquet(f"{to}/changed/version=0")


# -- substrings ----------------------------------------------------------------------------------


def grams_of(pattern: str) -> list[str]:
    """The grams that a text matching the LIKE pattern has: those of its stretches without wild cards."""
    pieces = pattern.lower().replace("_", "%").split("%")
    return sorted({p[i : i + GRAM] for p in pieces for i in range(len(p) - GRAM + 1)})


def candidates(spark: SparkSession, folder: str, pattern: str, fields: tuple[str, ...]) -> DataFrame | None:
    """id, field of the texts that have the pattern's rarest grams; None if it has no gram."""
    asked = grams_of(pattern)
    if not asked:
        return None
    sizes = spark.read.parquet(f"{folder}/sizes").filter(F.col("term").isin(asked) & F.col("field").isin(*fields)).groupBy("term").agg(F.sum("n").alias("n"))
    known = {r["term"]: r["n"] for r in sizes.collect()}  # a row for each gram of the pattern
    rarest = sorted(asked, key=lambda g: known.get(g, 0))[:RAREST]
    lists = lookup(spark, folder, rarest).filter(F.col("field").isin(*fields))
    return lists.groupBy("id", "field").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(rarest)).select("id", "field")


def containing(shelf: DataFrame, folder: str, patterns: list[str], fields: tuple[str, ...]) -> DataFrame:
    """id of the rows of which one of the fields holds one of the patterns in any case: candidates by their grams, verified together on their texts, which are read once.  Where a pattern has no gram, all rows are looked through."""
    found = [candidates(shelf.sparkSession, folder, p, fields) for p in patterns]
    rows = shelf.select("id", *fields)
    if all(f is not None for f in found):
        rows = rows.join(reduce(DataFrame.unionByName, found).select("id").distinct(), "id", "left_semi")
    hits = [F.coalesce(F.ilike(F.col(f), F.lit(f"%{p}%")), F.lit(False)) for p in patterns for f in fields]
    return rows.filter(reduce(lambda a, b: a | b, hits)).select("id")

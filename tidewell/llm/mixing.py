"""Mixing sources to target weights.

Method: multivariate-hypergeometric splitting tree.  Each source's documents are dealt by hash into
blocks, and the blocks are put into a random order.  A source's target fixes how many blocks, in that
order and if need be over and over, the mix draws from it.  The order is found in two levels, over groups
of blocks and inside each, so that no task sees all blocks of a source.  A tree then splits these exact quotas
among the output shards: at each node the left shards' blocks are drawn without replacement from the
node's, so that the counts are multivariate hypergeometric, as if all drawn blocks had been shuffled
as one.  Every shard takes the next blocks in the source's random order, so that shards are disjoint,
and sorts its documents by a hash.

The tree runs in two levels so that nothing grows with the number of sources on the driver: over
GROUPS groups of sources there, then over the sources of each group in tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import partitions, stage

# Weights by the source's rank, the share of all words, the most passes over a document.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_TIMES = 2
SHARDS = 16
GROUPS = 256
BLOCK_ROWS = 128


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(df: DataFrame, *order: Column, rows: int | None = None) -> DataFrame:
    """``df`` with its rank from 0 in a total order, without one task for all rows: only the rows' number per partition comes to the driver."""
    ordered = stage(df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked", rows)
    part = F.shiftright("_at", 33)
    counts = sorted((r["part"], r["n"]) for r in ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [(0, 0)], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    first = df.sparkSession.createDataFrame(starts[1:] or [(0, 0)], "_part long, _first long")
    return ordered.join(F.broadcast(first), part == F.col("_part")).withColumn("rank", F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_first")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most_times: int = MOST_TIMES) -> DataFrame:
    """sources (rank, source_size, ...) with target: ``share`` of all words by weight, none above ``most_times`` its source's size, the excess shared anew."""
    w = F.array(*[F.lit(float(x)) for x in weights])[(F.col("rank") % len(weights)).cast("int")]
    weighed = sources.withColumn("_w", w).withColumn("_cap", (F.col("source_size") * most_times).cast("double"))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    whole, level, before = share * total, None, -1.0
    while level is None or level != before:
        above = F.lit(False) if level is None else F.col("_w") * level >= F.col("_cap")
        taken, left = weighed.agg(F.coalesce(F.sum(F.when(above, F.col("_cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("_w"))), F.lit(0.0))).first()
        before, level = level, max(level or 0.0, (whole - taken) / left) if left else (level or 0.0)
    return weighed.withColumn("target", F.least("_cap", F.col("_w") * level)).drop("_w", "_cap")


def split_tree(counts: np.ndarray, shards: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Matrix (len(counts), len(shards)) of a random split of the counts among shards that hold ``shards`` each; the sums must agree."""
    out = np.zeros((len(counts), len(shards)), np.int64)

    def node(left: int, right: int, have: np.ndarray) -> None:
        if right - left == 1:
            out[:, left] = have
            return
        mid = (left + right) // 2
        want, rest = int(shards[left:mid].sum()), int(have.sum())
        half = np.zeros_like(have)
        for i in np.flatnonzero(have):  # one colour after another
            half[i] = rng.hypergeometric(have[i], rest - have[i], want) if want and rest > have[i] else min(want, have[i])
            want, rest = want - int(half[i]), rest - int(have[i])
        node(left, mid, half)
        node(mid, right, have - half)

    node(0, len(shards), np.asarray(counts, np.int64))
    return out


def shard_quotas(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """rank, cuts: of each source (rank, drawn), the blocks drawn by the shards up to each one."""
    groups = (F.col("rank") % GROUPS).cast("int")
    by_group = {r[0]: r[1] for r in sources.groupBy(groups.alias("g")).agg(F.sum("drawn").alias("n")).collect()}
    counts = np.array([by_group.get(g, 0) for g in range(GROUPS)], np.int64)
    total = int(counts.sum())
    per_shard = np.array([total * (j + 1) // shards - total * j // shards for j in range(shards)], np.int64)
    upper = split_tree(counts, per_shard, np.random.default_rng(seed))

    def lower(key, pdf):
        pdf = pdf.sort_values("rank")
        got = split_tree(pdf["drawn"].to_numpy(), upper[key[0]], np.random.default_rng([seed, key[0] + 1]))
        pdf["cuts"] = list(np.cumsum(got, axis=1))
        return pdf[["rank", "cuts"]]

    return sources.select("rank", "drawn", groups.alias("g")).groupBy("g").applyInPandas(lower, "rank long, cuts array<long>")


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, key_col: str | None = None, shards: int = SHARDS, seed: int = 7, **rule) -> DataFrame:
    """``docs`` with what the mix takes of each row: _size, _source_size, _target, _taken (words, repeats
    counted), _taken_first and _taken_again (of the first and second pass), _shard_first and
    _shard_again, and _order, by which a shard sorts its rows.

    A null text has size 0 and is never taken; a null source is a source of its own, the last.  Rows
    are told apart by id and a hash of the text, so that the input's order and partitions don't
    matter; equal rows share one place in the order and are interchangeable.  The document that
    reaches the target is taken in part, so that a source's taken words are its target rounded.
    """
    spark = docs.sparkSession
    size = F.col(size_col) if size_col else word_count(F.col(text_col))
    key = F.col(key_col) if key_col else F.xxhash64(F.col(id_col), F.xxhash64(F.col(text_col)))
    wide = docs.withColumns({"_size": size, "_key": key})
    sized = stage(wide.select(F.col(source_col).cast("string").alias("_source"), "_size", "_key"), "sized") if size_col is None else wide.select(F.col(source_col).cast("string").alias("_source"), "_size", "_key")
    n = sized.count()
    sources = ranked(sized.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("rows")), F.col("_source").asc_nulls_last(), rows=n)
    n_sources = sources.count()
    n_blocks = n // BLOCK_ROWS + n_sources
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS).cast("long")
    sources = stage(targets(sources, **rule).withColumn("blocks", blocks).withColumn("goal", F.round("target").cast("long")), "sources", n_sources)

    def dealt(df: DataFrame) -> DataFrame:
        cols = sources.select(F.col("_source").alias("_s"), F.col("rank").alias("_rank"), F.col("blocks").alias("_blocks"), F.col("source_size").alias("_of"), F.col("target").alias("_goal_exact"), F.col("goal").alias("_goal"))
        return df.join(cols, F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_block", F.pmod(F.xxhash64("_key", F.lit(seed)), F.col("_blocks")))

    placed = dealt(sized).groupBy("_rank", "_block").agg(F.sum("_size").alias("words"), F.first("_goal").alias("goal"), F.first("_of").alias("source_size"), F.first("_blocks").alias("of"))
    # A source's random order of blocks: groups of about the root of their number, and the blocks of a group.
    placed = stage(placed.withColumn("group", F.pmod(F.xxhash64("_block", "_rank", F.lit(seed + 5)), F.ceil(F.sqrt("of")))), "placed", n_blocks)
    earlier = Window.partitionBy("_rank").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = placed.groupBy("_rank", "group").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("n"))
    groups = groups.select("_rank", "group", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("words_before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    in_group = Window.partitionBy("_rank", "group").orderBy(F.xxhash64("_block", "_rank", F.lit(seed + 1)), "_block")
    inside_group = F.coalesce(F.sum("words").over(in_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumns({"first_word": inside_group, "no": F.row_number().over(in_group) - 1}).join(groups, ["_rank", "group"])
    placed = placed.withColumns({"first_word": F.col("first_word") + F.col("words_before"), "no": F.col("no") + F.col("before")})
    placed = placed.withColumns({"in_first": F.col("first_word") < F.col("goal"), "in_again": F.col("first_word") < F.col("goal") - F.col("source_size")})
    placed = stage(placed, "blocks", n_blocks)
    drawn = placed.groupBy(F.col("_rank").alias("rank")).agg((F.count_if("in_first") + F.count_if("in_again")).alias("drawn"), F.count_if("in_first").alias("drawn_first"))
    drawn = stage(drawn, "drawn", n_sources)
    quotas = shard_quotas(drawn, shards, seed).join(drawn.select("rank", "drawn_first"), "rank")
    placed = placed.join(quotas, F.col("_rank") == F.col("rank"))
    at = lambda no: F.size(F.filter("cuts", lambda c: c <= no)).cast("int")
    placed = placed.select(
        F.col("_rank").alias("_r"), F.col("_block").alias("_b"), F.col("first_word").alias("_first_word"),
        F.when(F.col("in_first"), at(F.col("no"))).alias("_shard_first"), F.when(F.col("in_again"), at(F.col("no") + F.col("drawn_first"))).alias("_shard_again"),
    )
    inside = Window.partitionBy("_rank", "_block").orderBy(F.xxhash64("_key", F.lit(seed + 2)), "_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt(wide.withColumn("_source", F.col(source_col).cast("string"))).withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    rows = rows.join(placed, (F.col("_rank") == F.col("_r")) & (F.col("_block") == F.col("_b")))
    start = F.col("_first_word") + F.col("_inside")
    part = lambda goal: F.greatest(F.lit(0), F.least(F.col("_size"), goal - start))
    rows = rows.withColumns({"_taken_first": part(F.col("_goal")), "_taken_again": part(F.col("_goal") - F.col("_of"))})
    rows = rows.withColumns({
        "_taken": F.col("_taken_first") + F.col("_taken_again"), "_order": F.xxhash64("_key", F.lit(seed + 3)),
        "_shard_first": F.when(F.col("_taken_first") > 0, F.col("_shard_first")), "_shard_again": F.when(F.col("_taken_again") > 0, F.col("_shard_again")),
        "_source_size": F.col("_of"), "_target": F.col("_goal_exact"),
    })
    added = ["_size", "_source_size", "_target", "_taken", "_taken_first", "_taken_again", "_shard_first", "_shard_again", "_order"]
    return rows.select(*docs.columns, *added)


def mixed_rows(docs: DataFrame) -> DataFrame:
    """``docs`` as often as the mix takes each row, shard by shard in the mix's random order, with all their columns whatever their names."""
    held = docs.select(F.struct("*").alias("_doc"))
    return shuffled(copies(mix(held, "_doc.source", "_doc.doc_id", "_doc.text"), ["_doc"])).select("_doc.*")


def copies(mixed: DataFrame, names: list[str]) -> DataFrame:
    """A row for each time that the mix takes a document, with its _shard and _order.  A document that the target cuts is kept whole if more than half of it is taken."""
    again = F.xxhash64("_order", F.lit(1))
    each = F.array(*[F.struct((F.col(f"_taken_{p}") * 2 > F.col("_size")).alias("whole"), F.col(f"_shard_{p}").alias("shard"), order.alias("order")) for p, order in (("first", F.col("_order")), ("again", again))])
    taken = mixed.withColumn("_each", F.filter(each, lambda e: e["whole"])).select(*names, F.explode("_each").alias("_e"))
    return taken.select(*names, F.col("_e.shard").alias("_shard"), F.col("_e.order").alias("_order"))


def shuffled(taken: DataFrame, shards: int = SHARDS) -> DataFrame:
    """What copies() gives with each shard in neighbouring partitions of its own, in its order; so written, a shard is a run of files."""
    each = -(-partitions(taken.sparkSession) // shards)
    # The order is a hash, so equal ranges of it hold about equally many rows.
    part = F.least(F.floor((F.col("_order") / float(1 << 63) + 1) / 2 * each), F.lit(each - 1))
    return taken.repartitionById(shards * each, (F.col("_shard") * each + part).cast("int")).sortWithinPartitions("_shard", "_order")


def query(docs: DataFrame) -> DataFrame:
    narrow = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", F.xxhash64("text")).alias("key")), "sizes")
    got = mix(narrow, size_col="size", key_col="key")
    return got.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"), F.col("_shard_first").alias("shard_first"), F.col("_shard_again").alias("shard_again"), F.col("_order").alias("shard_order"))

"""Exact duplicates: against the shelf, inside a batch, and on the shelf itself.

A batch is a DataFrame with a unique ``id`` in arrival order and the posting's columns; nothing
here collects it.  Probes of the shelf read its key columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as T

#: Aggregators cut titles at so many characters: a title of just this length may be cut.
CUT = 64
KEYS = ("external_id", "url", "content_hash")


def with_content_hash(jobs: DataFrame) -> DataFrame:
    hashed = T.content_hash(F.col("title"), F.col("company"))
    return jobs.withColumn("content_hash", hashed)


def parsed(raw: DataFrame, default_source: str = "") -> DataFrame:
    """Inbox rows as postings: no nulls in text fields, the canonical hash, an id that is never empty."""
    texts = {c: T.blank(F.col(c)) for c in ("title", "url", "company", "location", "description", "salary")}
    rows = with_content_hash(raw.withColumns(texts)).withColumn("source", F.coalesce(T.filled(F.col("source")), F.lit(default_source)))
    return rows.withColumn("external_id", T.stable_id(F.col("external_id"), F.col("url"), F.col("content_hash")))


def known_on_shelf(batch: DataFrame, shelf: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """id of the rows of which some non-empty key stands on the shelf.  One semi join of (kind, key): either table's keys are computed once."""
    each = F.explode(F.array(*[F.struct(F.lit(no).alias("kind"), F.col(key).alias("key")) for no, key in enumerate(keys)])).alias("k")
    listed = lambda df, *cols: df.select(*cols, each).select(*cols, "k.kind", "k.key").filter("key <> ''")
    return listed(batch, "id").join(listed(shelf).distinct(), ["kind", "key"], "left_semi").select("id").distinct()


def _companyless(company: Column) -> Column:
    return T.identity_company(company) == ""


def prefix_on_shelf(batch: DataFrame, shelf: DataFrame) -> DataFrame:
    """id of the rows whose title may be cut, or has no company, and of which the first CUT characters begin a shelf title in any case.

    An equality of lower-case prefixes, so a hash join rather than a search for each row.
    """
    probe = batch.filter((F.length("title") >= CUT) & (_companyless(F.col("company")) | (F.length("title") == CUT)))
    prefix = F.lower(F.left("title", F.lit(CUT))).alias("prefix")
    return probe.select("id", prefix).join(shelf.filter(F.length("title") >= CUT).select(prefix).distinct(), "prefix", "left_semi").select("id")


def cut_in_batch(batch: DataFrame) -> DataFrame:
    """id of the rows to drop of those that share their first CUT characters (case matters).

    The longest title stays, the earliest of equals; others go if they may be cut or have no company,
    and have no company or the keeper's.
    """
    rows = batch.filter(F.length("title") >= CUT).select("id", F.length("title").alias("n"), F.left("title", F.lit(CUT)).alias("prefix"), T.identity_company(F.col("company")).alias("name"))
    may_go = (F.col("n") == CUT) | (F.col("name") == "")
    return _replaced(rows.withColumn("may_go", may_go), [F.col("n"), -F.col("id")])


def _replaced(rows: DataFrame, order: list[Column]) -> DataFrame:
    """id of rows (id, prefix, name, may_go) that may go and have no company or that of their prefix's keeper, the last by ``order``.

    The keepers are folded in the tasks before the shuffle, and a prefix of many rows is a join's skewed key, which is split at run time.
    """
    keepers = rows.groupBy("prefix").agg(F.max(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("id").alias("keeper"), F.col("name").alias("keeper_name"))).alias("k"))
    both = rows.filter("may_go").join(keepers, "prefix")
    return both.filter((F.col("id") != F.col("k.keeper")) & ((F.col("name") == "") | (F.col("name") == F.col("k.keeper_name")))).select("id")


def first_of_each_key(batch: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``batch`` after passes over its keys, one after the other: each keeps the earliest of the rows left; empty keys are exempt.

    The passes sort only ids and keys; a claimed batch is limited, so no key's rows are many.
    """
    rows = batch.select("id", *keys)
    for key in keys:
        empty = F.col(key) == ""
        w = Window.partitionBy(key, F.when(empty, F.col("id"))).orderBy("id")
        rows = rows.withColumn("_no", F.row_number().over(w)).filter("_no = 1").drop("_no")
    return batch.join(rows.select("id"), "id", "left_semi")


def duplicates(batch: DataFrame, shelf: DataFrame) -> DataFrame:
    """id of all duplicates of a parsed batch, by the tiers in their order."""
    on_shelf = known_on_shelf(batch, shelf).unionByName(prefix_on_shelf(batch, shelf)).distinct()
    left = batch.select("id", "title", "company", *KEYS).join(on_shelf, "id", "left_anti")
    left = left.join(cut_in_batch(left), "id", "left_anti")
    return batch.select("id").join(first_of_each_key(left).select("id"), "id", "left_anti")


def best_of_each_hash(shelf: DataFrame) -> DataFrame:
    """The shelf with one row of each content hash: the longest description, then the newest, then the least id."""
    w = Window.partitionBy("content_hash").orderBy(F.length(T.blank(F.col("description"))).desc(), F.col("scraped_at").desc_nulls_last(), "id")
    return shelf.withColumn("_no", F.row_number().over(w)).filter("_no = 1").drop("_no")


def cut_on_shelf(shelf: DataFrame) -> DataFrame:
    """id of the shelf rows that a fuller row of the same first CUT characters (without the echoed company) replaces."""
    stripped = T.without_echo(F.col("title"), F.col("company"))
    rows = shelf.select("id", "scraped_at", F.length(T.blank(F.col("description"))).alias("rich"), stripped.alias("stripped"), T.identity_company(F.col("company")).alias("name"))
    rows = rows.filter(F.length("stripped") >= CUT).withColumns({"n": F.length("stripped"), "may_go": (F.length("stripped") == CUT) | (F.col("name") == "")})
    rows = rows.withColumn("prefix", F.left("stripped", F.lit(CUT)))
    return _replaced(rows, [~F.col("may_go"), F.col("n"), F.col("rich"), F.col("scraped_at"), -F.col("id")])


def rehashed_shelf(shelf: DataFrame) -> DataFrame:
    """The shelf with hashes computed anew and duplicates of both kinds removed."""
    best = best_of_each_hash(with_content_hash(shelf))
    return best.join(cut_on_shelf(best), "id", "left_anti")

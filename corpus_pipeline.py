"""A training corpus from documents: each stage works on what the one before has kept.

1. language: documents that fit no language go.
2. near_dups: of each class of near copies the document with the smallest id stays.
3. secrets: values of live-looking secrets are masked in the text; every document stays.
4. mix: sources are brought to their target weights; a document is there as often as the mix takes it, and rows
   are written shard by shard in the mix's random order, in which packing reads each file.
5. pack: the documents' tokens are placed in sequences; a row for each piece.

A stage's result is to be written before the next one begins, which then removes the tables that the one before has
left in the shared folder.  run() writes and removes below a folder of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import language, mixing, neardup, packing, secrets
from tidewell.llm.common import drop_stages, new_path, read, scratch
from tidewell.llm.queries import WORD_VOCABULARY


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redact(docs, F.col("source"), F.concat_ws("/", "source", "lang"))
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, WORD_VOCABULARY)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _cleaning(stage: Stage) -> Stage:
    def work(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_stages(spark, "pipeline")
        with scratch("pipeline"):
            return stage(spark, docs, sf_dir)

    return work


_PLAIN: list[tuple[str, Stage]] = [("language", identified), ("near_dups", deduplicated), ("secrets", redacted), ("mix", mixed), ("pack", packed)]
STAGES: list[tuple[str, Stage]] = [(name, _cleaning(stage)) for name, stage in _PLAIN]

#: Alignment, trigrams and tokens aren't SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents; each stage's own tables, and its input, are removed once it is written."""
    docs, own, before = read(spark, sf_dir, "documents"), f"pipeline-{uuid.uuid4().hex}", None
    for name, stage in _PLAIN:
        with scratch(f"{own}/{name}/out"):
            path = new_path(spark, name)
        with scratch(f"{own}/{name}/own"):
            stage(spark, docs, sf_dir).write.parquet(path)
        drop_stages(spark, f"{own}/{name}/own")
        if before:
            drop_stages(spark, f"{own}/{before}")
        docs, before = spark.read.parquet(path), name
    return docs

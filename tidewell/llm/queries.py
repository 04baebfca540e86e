"""The queries of this subpackage: (spark, sf_dir) -> DataFrame, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import audit, bpe, chat, fingerprints, language, lm, mixing, neardup, packing, resample, secrets, topk, warc
from tidewell.llm.common import drop_stages, read

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def clean(spark: SparkSession) -> None:
    """Remove what the queries so far have left in the shared folder, once their results have been consumed."""
    drop_stages(spark)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(read(spark, sf_dir, "documents"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.pseudo_likelihood(read(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.query(read(spark, sf_dir, "pages"))


def op6_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return chat.preferences(turns, F.shiftright("conv_id", 1), F.col("conv_id").bitwiseAND(F.lit(1)) == 0)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A source is an owner, and its documents of one language are a repository of the owner's.
    return secrets.scan(read(spark, sf_dir, "documents"), F.col("source"), F.concat_ws("/", "source", "lang"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(read(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), 20, lambda i: i % 20 == 0)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A document's declared language stands for its markup's, its source for its host; it has no address.
    return language.query(read(spark, sf_dir, "documents"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.query(read(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Operator 10 where there is all of its evidence: the markup's language, the address's suffix and host.
    return language.page_query(read(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pack, op2_fingerprint, op3_neardup, op4_pseudo_likelihood, op5_warc, op6_preferences, op7_secrets, op8_mix, op9_topk, op10_language, op11_audit, op12_resample, op13_bpe, language_of_pages)}
ORACLE_SQL: dict[str, str] = {"op5_warc": warc.SQL, "op6_preferences": chat.SQL, "op9_topk": topk.SQL, "op11_audit": audit.SQL, "op12_resample": resample.SQL}

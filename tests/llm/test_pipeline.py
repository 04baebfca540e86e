import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_neardup import brute
from tidewell.llm.queries import WORD_VOCABULARY


def test_every_stage_takes_odd_tables(spark, odd, empty, tmp_path):
    for start in (odd, empty):
        docs = start
        for no, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "")
            if no < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            path = str(tmp_path / f"{name}{start is odd}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)


def test_run_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {(r.doc_id, r.text) for r in docs.collect()}
    every = {(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert kept["language"] == every  # all of these are in a language
    ordered = sorted(every)
    assert kept["near_dups"] == {ordered[min(members)] for members in brute(ordered)}
    assert {i for i, _ in kept["secrets"]} == {i for i, _ in kept["near_dups"]}
    changed = kept["secrets"] - kept["near_dups"]
    assert all("[secret]" in t for _, t in changed)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total = sum(words(t) for _, t in kept["secrets"])
    mixed = docs.collect()
    assert {(r.doc_id, r.text) for r in mixed} <= kept["secrets"] and max(Counter(r.doc_id for r in mixed).values()) == 2
    assert abs(sum(words(r.text) for r in mixed) - 1.5 * total) < 0.05 * total
    tokenizer = Tokenizer.from_file(WORD_VOCABULARY)
    want = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed)
    rows = corpus_pipeline.run(spark, sf_dir).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(r.n for r in rows) == want and max(r.n for r in rows) <= 2048 and len(rows) <= np.ceil(want / 2048) * 1.05 + 1

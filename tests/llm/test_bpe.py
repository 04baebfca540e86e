import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm import bpe
from tidewell.llm.queries import BYTE_VOCABULARY


@pytest.fixture(scope="module")
def both():
    library = Tokenizer.from_file(BYTE_VOCABULARY)
    library.no_truncation()
    library.no_padding()
    return library, bpe.Encoder(BYTE_VOCABULARY)


def ids(encoder, text):
    return np.frombuffer(encoder.encode([text])[0], "<u4").tolist()


def decoded(encoder, lists):
    return encoder.decode(np.array([i for x in lists for i in x], np.int64), np.cumsum([0, *map(len, lists)]))


def wanted(library, docs):
    out = []
    for doc_id, text in docs:
        found = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append(repr((doc_id, len(found), sha(",".join(map(str, found))), sha(library.decode(found, skip_special_tokens=False)))))
    return sorted(out)


def rows_of(df):
    return sorted(repr((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in df.collect())


def test_odd_documents(odd, both):
    assert rows_of(bpe.query(odd, BYTE_VOCABULARY)) == wanted(both[0], [(r.doc_id, r.text) for r in odd.collect()])


def test_empty(empty):
    assert bpe.query(empty, BYTE_VOCABULARY).collect() == []


def test_documents(spark, sf_dir, both):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert rows_of(bpe.query(docs, BYTE_VOCABULARY)) == wanted(both[0], [(r.doc_id, r.text) for r in docs.collect()])
    assert bpe.encoded(docs, BYTE_VOCABULARY).join(docs, "doc_id").filter(F.col("decoded") != F.col("text")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(list(" \n\t'stremvd.,!aAé日😀09　\u0085՘Ᲊ")), st.characters(exclude_categories=["Cs"])), max_size=120), st.sampled_from(["", "<|endoftext|>", "<|endoftext", "<|endoftext|><|endoftext|> a"]))
def test_texts(both, text, end):
    library, own = both
    want = library.encode(text + end + text, add_special_tokens=False).ids
    assert ids(own, text + end + text) == want
    assert decoded(own, [want]) == [library.decode(want, skip_special_tokens=False)]


def test_pieces_of_every_character(both):
    """Characters newer than the library's Unicode are neither letters nor numbers to it."""
    library, own = both
    for start in range(0, 0x110000, 4096):
        text = "".join(f"a{chr(c)}1{chr(c)} x" for c in range(start, start + 4096) if not 0xD800 <= c <= 0xDFFF)
        assert own.pieces(text) == [text[a:z] for _, (a, z) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_long_pieces_and_rows_of_trees_agree(both):
    library, own = both
    rng = random.Random(5)
    for n in (2, 3, 63, 64, 65, 1000, 50_000):
        text = "".join(rng.choice("etaoinshr") for _ in range(n))
        want = library.encode(text, add_special_tokens=False).ids
        assert own.merged(text.encode()).tolist() == want == ids(own, text)
    for text in ("a" * 200, "ab" * 33, " " * 70, "-" * 1001, "\n" * 64):
        assert ids(own, text) == library.encode(text, add_special_tokens=False).ids


def test_what_is_forgotten_is_learned_anew(both, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    own = bpe.Encoder(BYTE_VOCABULARY)
    rng = random.Random(6)
    for _ in range(20):
        text = " ".join("".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9))) for _ in range(200))
        assert ids(own, text) == both[0].encode(text, add_special_tokens=False).ids
    assert len(own.known) + len(own.older) < 800


def test_decoding_any_ids(spark, both):
    library, own = both
    rng = random.Random(7)
    lists = [[rng.randrange(50_257) for _ in range(30)] for _ in range(200)]
    assert decoded(own, lists) == [library.decode(x, skip_special_tokens=False) for x in lists]
    rows = spark.createDataFrame([(None,), ([],), ([None, 15496, 99_999, -1],)], "ids array<int>")
    assert [r[0] for r in rows.select(bpe.decode(F.col("ids"), BYTE_VOCABULARY)).collect()] == ["", "", "Hello"]

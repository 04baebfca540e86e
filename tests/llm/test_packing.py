import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewell.llm import packing
from tidewell.llm.queries import WORD_VOCABULARY


def check(rows, docs, capacity=2048):
    """Every document's ids, cut and placed without gaps."""
    tokenizer = Tokenizer.from_file(WORD_VOCABULARY)
    want = []
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want.append((str(doc_id), piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))]
        assert sum(n for _, n in held) <= capacity
    return len(places), sum(r.length for r in rows)


def test_odd_documents(odd):
    rows = packing.pack(odd, WORD_VOCABULARY).collect()
    check(rows, [(r.doc_id, r.text) for r in odd.collect()])


def test_empty(empty):
    assert packing.pack(empty, WORD_VOCABULARY).collect() == []


def test_documents_fill_sequences(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs, WORD_VOCABULARY).collect()
    bins, total = check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert bins <= 1.02 * -(-total // 2048)


def test_best_fit_takes_the_tightest():
    p = packing.Packer(10, 4)
    first, second = p.place(4), p.place(7)
    assert first[0] != second[0]
    assert p.place(3) == (second[0], 7)  # 3 free rather than 6
    assert p.place(6) == (first[0], 4)
    assert not p.still_open()


def test_fullest_closes_first():
    p = packing.Packer(10, 2)
    a, b = p.place(6)[0], p.place(7)[0]
    c = p.place(8)[0]
    assert p.still_open() == {a, c} and b not in p.still_open()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 9))
def test_no_overlap(lengths, most):
    p, held = packing.Packer(64, most), defaultdict(int)
    for n in lengths:
        b, offset = p.place(n)
        assert offset == held[b]
        held[b] += n
        assert held[b] <= 64 and len(p.still_open()) <= most


def test_chunks_give_the_texts_ids():
    tokenizer, rng = packing.ChunkTokenizer(WORD_VOCABULARY), random.Random(4)
    pieces = ["it's", "'Twas", "don't...", "x,y;z", "<|endoftext|>", "A<|startoftext|>b,", "Σας", "é,", "É.", "a\xa0b", "a\x1cb", "12,3", "a1.b", "ﬁ", "“quote,”", "İst", "z", "ª²", "日本語,", "s.", "t:", "'s", "..", ".", " ", "\n", "é."]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", "", "\t", "\n"]) for _ in range(rng.randrange(12))) for _ in range(400)]
    for text, got in zip(texts, tokenizer.encode([t.encode() for t in texts])):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)

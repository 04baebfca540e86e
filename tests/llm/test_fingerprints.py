import hashlib
from collections import Counter

import numpy as np

from tidewell.llm import fingerprints as fp
from tidewell.llm.terms import word_hashes


def weights(text):
    w = text.lower().split()
    return Counter(zip(w, w[1:])) if len(w) > 1 else Counter(w)


def jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0


def expected(docs):
    ordered = sorted(docs, key=lambda d: (d[0] is not None, d[0] if d[0] is not None else 0, d[1]), reverse=True)
    out = []
    for (doc_id, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        n = len(text) // 3
        changed = text[: len(text) - n] + after[:n]
        out.append((str(doc_id), len(text), hashlib.sha256(changed.encode()).hexdigest()))
    return out


def test_odd_documents(odd):
    rows = fp.fingerprint(odd).collect()
    docs = [(r.doc_id, r.text or "") for r in odd.collect()]
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in rows) == sorted(expected(docs))
    by_text = {}
    for (doc_id, text) in docs:
        by_text.setdefault(text, set()).update(r.fingerprint for r in rows if r.doc_id == doc_id and r.n_chars == len(text))
    assert all(len(v) == 1 for t, v in by_text.items() if t and t != "no id here at all")
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def test_empty_and_lone(spark, empty):
    assert fp.fingerprint(empty).collect() == []
    (row,) = fp.fingerprint(spark.createDataFrame([(7, "one two three")], "doc_id long, text string")).collect()
    assert row.edited_sha256 == hashlib.sha256(("one two t"[:9] + "one ").encode()).hexdigest() and row.near_next == 1.0


def test_likeness_is_generalised_jaccard(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in fp.fingerprint(docs).collect()}
    texts = dict((r.doc_id, r.text) for r in docs.collect())
    order = sorted(texts, reverse=True)
    off = []
    for a, b in zip(order, order[1:] + order[:1]):
        off.append(rows[a].near_edited - jaccard(weights(texts[a]), weights(fp.edited(texts[a], texts[b]))))
    assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.08
    for a in order:
        assert rows[a].edited_sha256 == hashlib.sha256(fp.edited(texts[a], texts[order[(order.index(a) + 1) % len(order)]]).encode()).hexdigest()


def test_weights_count():
    sampler = fp.Sampler(lanes=4000)
    a, b = "x y x y x y x y x y z z", "x y x y q r"
    one, two = (sampler.sample(w) for w in word_hashes([a, b]))
    assert abs(fp.likeness(one, two) - jaccard(weights(a), weights(b))) < 0.04

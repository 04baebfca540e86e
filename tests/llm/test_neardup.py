import random
from collections import Counter, defaultdict

import numpy as np

from tidewell.llm import neardup
from tidewell.llm.graphs import components
from tidewell.llm.terms import word_hashes


def lcs(a, b):
    """Length of the longest common subsequence, row by row; a common end belongs to it."""
    if a and b and a[-1] == b[-1]:
        same = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
        return same + lcs(a[: len(a) - same], b[: len(b) - same])
    if a and b and a[0] == b[0]:
        return lcs(a[::-1], b[::-1])
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def similarity(a, b):
    """That of the alignment of words; 0 where their number in common can't reach 0.8."""
    if a == b:
        return 1.0
    most = (Counter(a) & Counter(b)).total()
    if not a or not b or most < 0.8 * (len(a) + len(b) - most):
        return 0.0
    s = lcs(a, b)
    return s / (len(a) + len(b) - s)


def brute(docs, threshold=0.8):
    """Classes of positions by the similarity of all pairs."""
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    words = [(t or "").lower().split() for _, t in docs]
    for i in range(len(docs)):
        for j in range(i):
            if root(i) != root(j) and similarity(words[i], words[j]) >= threshold:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    out = defaultdict(list)
    for i in range(len(docs)):
        out[root(i)].append(i)
    return sorted(map(tuple, out.values()))


def test_odd_documents(odd):
    rows = neardup.classes(odd).collect()
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    want = Counter()
    for members in brute(docs):
        ids = [docs[i][0] for i in members if docs[i][0] is not None]
        for i in members:
            want[(docs[i][0], min(ids, default=None))] += 1
    assert Counter((r.doc_id, r.class_id) for r in rows) == want
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(brute(docs))


def test_empty(empty):
    assert neardup.classes(empty).collect() == [] and neardup.keep_one(empty).collect() == []


def test_families_of_edits_lose_no_link(spark):
    """Copies of copies with words replaced, added and taken away, at all distances from the original."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    docs = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(25):
            text = list(base)
            for _ in range(int(rng.random() ** 2 * 0.06 * len(base))):
                at = rng.randrange(len(text))
                text[at : at + 1] = rng.choice([[word()], [], [text[at], word()]])
            docs.append((len(docs), " ".join(text)))
    docs += [(len(docs) + i, " ".join(word() for _ in range(50))) for i in range(100)]
    got = defaultdict(list)
    for r in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got[r.class_id].append(r.doc_id)
    want = {frozenset(x) for x in brute(docs)}
    assert {frozenset(v) for v in got.values()} == want


def test_alignment_is_the_longest_common_subsequence():
    rng = random.Random(2)
    w = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    a, b, c = word_hashes([" ".join(x) for x in (w, w[100:] + w[:100], w[:190] + ["new"] + w[190:])])
    assert neardup.aligned(a, a) == 1.0 and neardup.aligned(a, b) == 0.0 and neardup.aligned(a, c) == 200 / 201
    assert neardup.aligned(a[:0], a[:0]) == 1.0 and neardup.aligned(a, a[:0]) == 0.0
    over = 0
    for _ in range(400):
        x = [rng.randrange(12) for _ in range(rng.randrange(1, 80))]
        y = [rng.randrange(12) if rng.random() < 0.08 else w for w in x if rng.random() > 0.04] or [1]
        s = lcs(x, y)
        want = s / (len(x) + len(y) - s)
        over += want >= 0.8
        assert neardup.aligned(np.array(x), np.array(y)) == (want if want >= 0.8 else 0.0)
    assert 100 < over < 400


def test_large_buckets_are_cut(spark, monkeypatch):
    """A star: variants are linked to the original alone, which stands in one group of many."""
    monkeypatch.setattr(neardup, "CHUNK", 8)
    base = [f"w{i}" for i in range(80)]
    docs = [(0, " ".join(base))] + [(i + 1, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(0, 75, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.class_id for r in neardup.classes(frame).collect()} == {0} and len(brute(docs)) == 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 103), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 104))
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_compared_spans_every_group():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 256, (3, neardup.LANES), dtype=np.uint8)
    pairs, central = neardup.compared(np.full(60, 100), np.repeat(base, 20, axis=0))
    assert (central == 19).all() and all(a // 20 == b // 20 for a, b in pairs) and len(pairs) == 57


def classes_of(frame):
    got = defaultdict(list)
    for r in neardup.classes(frame).collect():
        got[r.class_id].append(r.doc_id)
    return {frozenset(v) for v in got.values()}


def template_family(rng, n, pairs, size=1004):
    """Texts of one template just under the threshold; the first 2 * pairs of them are pairs just over it."""
    docs = []
    for i in range(n):
        text = [f"w{j}" for j in range(size)]
        for at in rng.sample(range(size), size * 8 // 100):
            text[at] = f"x{i}y{at}"
        if i < 2 * pairs and i % 2:
            text = list(docs[-1])
            for at in rng.sample(range(size), size * 8 // 100):
                text[at] = f"x{i}y{at}"
        docs.append(text)
    return [(i, " ".join(t)) for i, t in enumerate(docs)]


def test_links_behind_many_that_fail(spark):
    """300 texts of one template: 150 pairs of which just those are links."""
    docs = template_family(random.Random(5), 300, 150, 204)
    want = {frozenset(x) for x in brute(docs)}
    got = classes_of(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sum(len(x) == 2 for x in want) > 100 and len(want - got) <= 0.01 * len(want)


def test_links_between_groups_of_a_cut_bucket(spark, monkeypatch):
    """The links' ends stand in different groups, and no hub has a link with either; most texts are outside the main component, in several blocks."""
    docs = template_family(random.Random(6), 120, 20)
    want = {frozenset(x) for x in brute(docs)}
    monkeypatch.setattr(neardup, "HUBS", 2)
    for chunk in (16, 64):
        monkeypatch.setattr(neardup, "CHUNK", chunk)
        assert classes_of(spark.createDataFrame(docs, "doc_id long, text string")) == want


def test_documents(spark, sf_dir):
    """All links of the table are found."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    place = [(r.doc_id, r.text) for r in docs.collect()]
    assert classes_of(docs) == {frozenset(place[i][0] for i in x) for x in brute(place)}


def edited(rng, text, edits):
    """The text with so many of its words replaced, added or taken away."""
    text = list(text)
    for at in sorted(rng.sample(range(len(text)), edits), reverse=True):
        text[at : at + 1] = rng.choice([[f"new{rng.random()}"], [], [text[at], f"more{rng.random()}"]])
    return text


def test_short_texts_lose_no_link(spark):
    """Texts of 5 to 80 words with as many edits as a link may have, and some with one more."""
    rng = random.Random(12)
    docs, words = [], [f"w{i}" for i in range(300)]
    for n in (5, 8, 9, 10, 12, 14, 18, 20, 27, 30, 36, 40, 55, 66):
        for _ in range(15):
            base = rng.choices(words, weights=[1 / (i + 1) for i in range(300)], k=n - 2) + [f"id{len(docs)}", "end"]
            docs += [base, edited(rng, base, min(n, n // 9 + rng.randrange(2)))]
    docs = [(i, " ".join(t)) for i, t in enumerate(docs)]
    want = {frozenset(x) for x in brute(docs)}
    assert sum(len(x) > 1 for x in want) > 100
    assert classes_of(spark.createDataFrame(docs, "doc_id long, text string")) == want


def test_short_and_longer_texts_at_the_limit(spark):
    """One or two edits across the length up to which rare words count: 5-word runs find these."""
    rng = random.Random(13)
    docs = []
    for i in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(neardup.SHORT + rng.randrange(-3, 4))]
        docs += [base, edited(rng, base, 1 + i % 2)]
    docs = [(i, " ".join(t)) for i, t in enumerate(docs)]
    assert classes_of(spark.createDataFrame(docs, "doc_id long, text string")) == {frozenset(x) for x in brute(docs)}


def test_few_and_many_keys_keep_the_same_rows(odd, monkeypatch):
    """Whether the keys of what goes are sent to the texts or joined with them."""
    kept = lambda: sorted(map(str, neardup.keep_one(odd.unionByName(odd.limit(4))).collect()))
    few = kept()
    monkeypatch.setattr(neardup, "SENT", -1)
    assert kept() == few == sorted(map(str, neardup.keep_one(odd).collect()))

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import language, lm
from tidewell.llm.terms import word_hashes


def test_language_of_odd_documents(odd, empty):
    rows = language.query(odd).collect()
    assert len(rows) == odd.count() and language.query(empty).collect() == []
    kept = language.keep_identified(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.accepted for r in rows)


def test_no_declared_language(spark):
    docs = spark.createDataFrame([(1, "some text", None, "a"), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    assert [(r.doc_id, r.language, r.accepted) for r in language.query(docs).orderBy("doc_id").collect()] == [(1, None, True), (2, None, True)]


def test_held_out_accuracy_and_junk(spark, sf_dir):
    """A fifth of the documents say nothing of their language; junk fits none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", F.col("lang").alias("truth"), F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("lang"))
    junk = [(10**6 + i, "".join(chr(33 + (i * 7919 + j * j * 31) % 90) for j in range(400)), "src1", None, None) for i in range(5)]
    rows = language.query(docs.unionByName(spark.createDataFrame(junk, docs.schema))).join(docs, "doc_id", "left").collect()
    hidden = [r for r in rows if r.doc_id % 5 == 0 and r.doc_id < 10**6]
    assert np.mean([r.language == r.truth for r in hidden]) > 0.95
    assert all(r.accepted for r in rows if r.doc_id < 10**6)
    assert not any(r.accepted for r in rows if r.doc_id >= 10**6)


def test_evidence_is_fused(spark):
    """A short text that both languages have goes by its host; a declared language outweighs a weak host."""
    english, german = "the house and the garden of the king ", "das haus und der garten von dem koenig "
    rows = [(i, english * 3, "en", "uk", "e.uk") for i in range(40)] + [(100 + i, german * 3, "de", "de", "d.de") for i in range(40)]
    rows += [(500, "a", None, "uk", "e.uk"), (501, "a", None, "de", "d.de"), (502, "a", None, "de", "new.de"), (503, "", "en", "de", "d.de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, suffix string, host string")
    got = {r.doc_id: r for r in language.identify(docs, F.col("text"), F.col("lang"), F.col("suffix"), F.col("host"), ["doc_id"]).collect()}
    assert [got[i]._lang for i in (500, 501, 502)] == ["en", "de", "de"]
    assert got[502]._probability < got[501]._probability < 1


def brute_posterior(rows):
    """(best language or und, its probability) of rows (text, declared, suffix, host), by the definition, one row after another."""

    def cells(text):
        raw = b" " + text.lower().encode() + b" "
        plain = lambda b: b >= 128 or b == 32 or 97 <= b <= 122
        return [((x * 0x9E3779B1 + y * 0x85EBCA6B + z * 0xC2B2AE35) & 0xFFFFFFFF) >> (32 - language.BITS) for x, y, z in zip(raw, raw[1:], raw[2:]) if plain(x) and plain(y) and plain(z)]

    size, langs = 1 << language.BITS, sorted({r[1] for r in rows if r[1]})
    counts = {lang: Counter() for lang in langs}
    for text, declared, *_ in rows:
        if declared:
            counts[declared].update(cells(text))

    def logs(text):
        got = cells(text)
        each = [sum(math.log((counts[lang][c] + language.ADDED_COUNT) / (counts[lang].total() + size * language.ADDED_COUNT)) for c in got) for lang in langs]
        return [x * min(1, language.INDEPENDENT / max(1, len(got))) for x in (*each, -len(got) * math.log(size))], len(got)

    scored = [logs(r[0]) for r in rows]
    told = [(r[2], r[3], int(np.argmax(s[:-1]))) for r, (s, n) in zip(rows, scored) if n]
    share = lambda found, upon: [(found.count(i) + language.STRENGTH * p) / (len(found) + language.STRENGTH) for i, p in enumerate(upon)]
    top = [[t[2] for t in told].count(i) + language.ADDED_COUNT for i in range(len(langs))]
    out = []
    for (_, declared, suffix, host), (s, _) in zip(rows, scored):
        prior = share([t[2] for t in told if t[0] == suffix], [x / sum(top) for x in top])
        prior = share([t[2] for t in told if t[:2] == (suffix, host)], prior)
        said = [0 if not declared else math.log(language.DECLARED_RIGHT if lang == declared else max((1 - language.DECLARED_RIGHT) / max(1, len(langs) - 1), 1e-6)) for lang in langs]
        post = [a + math.log(p) + e for a, p, e in zip(s, prior, said)] + [s[-1] + math.log(language.UNDETERMINED)]
        best = int(np.argmax(post))
        out.append((None if best == len(langs) else langs[best], 1 / sum(math.exp(x - post[best]) for x in post)))
    return out


def test_posterior_against_brute_force(spark, monkeypatch):
    """40 languages in blocks of 7, each with words of its own; hosts of mixed, single and no evidence."""
    monkeypatch.setattr(language, "BLOCK", 7)
    rng = np.random.default_rng(4)
    tags = [f"{chr(97 + i // 6)}{chr(97 + i % 6)}" for i in range(40)]
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzäöß"), 4)) for _ in range(12)] for _ in tags]
    rows = []
    for i in range(300):
        lang = int(rng.integers(40))
        text = " ".join(rng.choice(words[lang], int(rng.integers(0, 12))))
        rows.append((text, None if i % 5 == 0 else tags[lang], f"s{lang % 3}", f"h{lang % 9}"))
    rows += [("", None, "s0", "nowhere"), ("12 34 ;;", None, "none", "nowhere"), ("x", "aa", "s1", "h1"), ("%&$ zqx " * 30, None, "s1", "h1")]
    docs = spark.createDataFrame([(i, *r, "x", 0.5) for i, r in enumerate(rows)], "doc_id long, text string, lang string, suffix string, host string, n string, _by double")
    got = {r.doc_id: r for r in language.identify(docs, F.col("text"), F.col("lang"), F.col("suffix"), F.col("host"), ["doc_id"]).collect()}
    want = brute_posterior(rows)
    assert [got[i]._lang for i in range(len(rows))] == [w[0] for w in want]
    assert max(abs(got[i]._probability - w[1]) for i, w in enumerate(want)) < 1e-3


def test_pages(spark, sf_dir):
    rows = language.page_query(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()
    assert len(rows) == 50 and all(r.accepted for r in rows) and language.page_query(spark.createDataFrame([(1, None, None)], "page_id long, url string, html string")).first().language is None


def test_page_evidence(spark):
    df = spark.createDataFrame([('<!doctype html><html class="x" LANG="de-AT">', "http://www.site.at/x"), ("<p>none", None)], "html string, url string")
    lang, suffix, host = language.page_evidence(F.col("html"), F.col("url"))
    assert [tuple(r) for r in df.select(lang, suffix, host).collect()] == [("de", "at", "www.site.at"), (None, "", "")]


def test_network_gradient_is_right():
    rng = np.random.default_rng(0)
    net = lm.Network.start(np.ones(lm.WORDS))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids, around = rng.integers(0, lm.WORDS, 40), rng.integers(0, lm.WORDS + 1, (4, 40))
    grads = {k: np.zeros_like(v) for k, v in net.p.items()}
    net.run(ids, around, grads)
    for name in net.p:
        flat, g = net.p[name].reshape(-1), grads[name].reshape(-1)
        at = int(np.abs(g).argmax())
        old = flat[at]
        up, down = [(flat.__setitem__(at, old + d), net.run(ids, around, None).sum())[1] for d in (1e-4, -1e-4)]
        flat[at] = old
        assert abs((up - down) / 2e-4 - g[at]) < 1e-2 * max(1, abs(g[at])), name


def test_probabilities_sum_to_one():
    net = lm.Network.start(np.arange(lm.WORDS) + 1.0)
    every = np.arange(lm.WORDS)
    around = np.tile(np.array([[3], [lm.WORDS], [5], [9]]), (1, lm.WORDS))
    assert abs(np.exp(net.run(every, around, None).astype(np.float64)).sum() - 1) < 1e-4


def test_windows_stay_in_their_text():
    flat, around = lm._around([np.array([1, 2, 3]), np.array([], int), np.array([4])])
    assert flat.tolist() == [1, 2, 3, 4]
    assert around[:, 0].tolist() == [lm.WORDS, lm.WORDS, 2, 3] and around[:, 2].tolist() == [1, 2, lm.WORDS, lm.WORDS] and around[:, 3].tolist() == [lm.WORDS] * 4


def test_training_helps_and_order_matters(spark, sf_dir):
    """Held-out documents score better after training, and better than their own words in another order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids, frequency = lm.vocabulary(docs.select("text"))
    encoded = lm.encode(docs, ids).persist()
    start = lm.Network.start(frequency)
    net = start
    for _ in range(8):  # the corpus is small
        net = lm.train(encoded.filter("doc_id % 4 > 0"), net, int(frequency.sum()))
    held = encoded.filter("doc_id % 4 = 0")
    mean = lambda n, e: (lambda r: r[0] / r[1])(lm.score(e, n).agg(F.sum("log_prob"), F.sum("n_words")).first())
    assert mean(net, held) > mean(start, held) + 0.1
    mixed = lm.encode(docs.filter("doc_id % 4 = 0").withColumn("text", F.array_join(F.array_sort(F.split("text", " ")), " ")), ids)
    assert mean(net, held) > mean(net, mixed)


def test_scores_of_odd_documents(odd, empty):
    rows = lm.pseudo_likelihood(odd).collect()
    assert len(rows) == odd.count() and lm.pseudo_likelihood(empty).collect() == []
    for r in rows:
        assert (r.n_words == 0 and r.log_prob == 0 and r.mean_log_prob is None) or (r.log_prob < 0 and math.isfinite(r.mean_log_prob))


def test_every_word_has_its_own_probability(spark, monkeypatch):
    """Texts of one word: over all 3,000 words the probabilities sum to one, and a word seen once is less likely than others of its id."""
    words = [(f"w{i}", 1 + (i % 7) ** 2) for i in range(3000)]
    docs = spark.createDataFrame([(i, w) for i, (w, n) in enumerate(words) for _ in range(n)], "doc_id long, text string")
    got = []
    for head in (lm.HEAD, 4096, 2):  # all words looked up; some joined; all joined
        monkeypatch.setattr(lm, "HEAD", head)
        got.append({r.doc_id: r.log_prob for r in lm.pseudo_likelihood(docs).collect()})
        assert len(got[-1]) == 3000 and abs(sum(math.exp(x) for x in got[-1].values()) - 1) < 0.03  # ids without a word keep the rest
        mean = lambda n: np.mean([got[-1][i] for i, (_, m) in enumerate(words) if m == n])
        assert mean(1) < mean(10) - 1 and mean(10) < mean(37) - 0.5


def test_large_logits_stay_finite():
    net = lm.Network.start(np.ones(lm.WORDS))
    net.p["class_bias"][:] = np.linspace(-2000, 2000, len(net.p["class_bias"]))
    net.p["word_bias"][:] = 5000
    got = net.run(np.arange(lm.WORDS), np.full((2 * lm.WINDOW, lm.WORDS), 3), None)
    assert np.isfinite(got).all() and got.max() < 0.001


def test_partitions_do_not_matter(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 20_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    one, many = [sorted(tuple(r) for r in lm.pseudo_likelihood(docs.repartition(n)).collect()) for n in (1, 7)]
    assert one == many


def test_log_prob_against_brute_force(spark, sf_dir, monkeypatch):
    """Every word of some documents by the definition: the network's softmax over classes and words of a class, times the word's share of its id."""
    monkeypatch.setattr(lm, "HEAD", 2048)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").filter("length(text) < 1500").limit(40).persist()
    known, frequency = lm.vocabulary(docs.select("text"))
    encoded = lm.encode(docs, known)
    net = lm.train(encoded, lm.Network.start(frequency), int(frequency.sum()))
    got = {r.doc_id: r for r in lm.score_words(encoded, net, known).collect()}
    texts = {r.doc_id: r.text.lower().split() for r in docs.collect()}
    hashes = {w: int(word_hashes([w])[0][0]) for t in texts.values() for w in t}
    own = {int(h): int(i) for h, i in zip(known.head, known.ids)}
    ident = {w: own.get(h, lm.WORDS - lm.RARE + h % lm.RARE) for w, h in hashes.items()}
    count = Counter(w for t in texts.values() for w in t)
    of_id = Counter()
    for w, n in count.items():
        of_id[ident[w]] += n
    p = {k: v.astype(float) for k, v in net.p.items()}
    soft = lambda x: x - np.log(np.exp(x - x.max()).sum()) - x.max()
    assert len(texts) == 40
    for doc_id, words in texts.items():
        total = 0.0
        for at, w in enumerate(words):
            h = p["hidden"].copy()
            for off in (-2, -1, 1, 2):
                other = ident[words[at + off]] if 0 <= at + off < len(words) else lm.WORDS
                h += p["left" if off < 0 else "right"][other] / abs(off)
            h, c = np.tanh(h), ident[w] // lm.CLASS
            total += soft(h @ p["class_out"] + p["class_bias"])[c] + soft(h @ p["word_out"][c] + p["word_bias"][c])[ident[w] % lm.CLASS] + math.log(count[w] / of_id[ident[w]])
        assert got[doc_id].n_words == len(words) and abs(got[doc_id].log_prob - total) < 0.01 + 1e-4 * len(words)

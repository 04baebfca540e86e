import contextlib
import io
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import search, textindex
from tidewell.operators.keywords import Asked, parsed, parsed_terms, split_words

NOW = datetime(2024, 1, 31)


def run(*words):
    return Asked("run", words)


def no(part):
    return Asked("not", parts=(part,))


def every(*parts):
    return Asked("all", parts=parts)


def some(*parts):
    return Asked("any", parts=parts)


@pytest.mark.parametrize(("term", "want"), [
    ("agile coach", every(run("agile"), run("coach"))), ("agile -coach", every(run("agile"), no(run("coach")))), ("coach or trainer", some(run("coach"), run("trainer"))), ("a b or c -d", some(every(run("a"), run("b")), every(run("c"), no(run("d"))))),
    ('"data science" -"team lead"', every(run("data", "science"), no(run("team", "lead")))), ("or a", every(run("or"), run("a"))), ("a or", every(run("a"), run("or"))), ("a OR b", some(run("a"), run("b"))), ("a orb", every(run("a"), run("orb"))), ("a or-b", every(run("a"), run("or", "b"))),
    ("full-stack", run("full", "stack")), ("(a | b) & !c", every(run("a"), run("b"), run("c"))), ("--a", run("a")), ('"never closed', run("never", "closed")), ('a"b c"d', every(run("a"), run("b", "c"), run("d"))), ("- a", no(run("a"))), ("  ", None), ('"" -', None), ("a -,", run("a")),
    ("C++ c#", every(run("c"), run("c"))), ("Über", run("über")), ("a or -b", some(run("a"), no(run("b")))), ("a or b or c", some(run("a"), run("b"), run("c"))),
])
def test_syntax(term, want):
    assert parsed(term) == want


def test_terms_are_joined_by_or():
    assert parsed_terms(["a or b", " ", "c d"]) == some(run("a"), run("b"), every(run("c"), run("d"))) and parsed_terms([" "]) is None
    assert no(run("a")).holds_of_none() and not every(no(run("a")), run("b")).holds_of_none() and some(no(run("a")), run("b")).holds_of_none()


def brute(text, asked):
    if text is None:
        return False
    words = split_words(text)

    def holds(node):
        if node.kind == "run":
            return any(words[i : i + len(node.words)] == node.words for i in range(len(words)))
        each = [holds(p) for p in node.parts]
        return not each[0] if node.kind == "not" else all(each) if node.kind == "all" else any(each)

    return holds(asked)


@pytest.fixture(scope="module")
def shelf(spark):
    rng = random.Random(8)
    text = lambda n: None if rng.random() < 0.1 else "".join(rng.choice(["a", "b", "c", "data", "Team", "lead", "über"]) + rng.choice([" ", "-", ", ", " / "]) for _ in range(rng.randrange(n)))
    rows = [(i, text(6), text(30), NOW) for i in range(400)]
    return spark.createDataFrame(rows, "id long, title string, description string, scraped_at timestamp").persist()


ASKED = [["a b"], ['"a b" -c'], ["-a"], ["data or -lead"], ['"team lead" "b c"', "über -team"], ['-"a b" -"b a"'], ["nowhere"], ["nowhere -a"], ["data-team"]]


def as_dict(df):
    return {r.id: round(r.r, 12) for r in df.collect()}


def test_index_and_scan_give_what_the_words_say(spark, shelf, tmp_path):
    index = search.Index(str(tmp_path / "words"))
    textindex.write(shelf, index.words, textindex.WORDS)
    rows = shelf.collect()
    for keywords in ASKED:
        spec, asked = search.Search(NOW, keywords=keywords), parsed_terms(keywords)
        want = {r.id for r in rows if brute(r.title, asked) or brute(r.description, asked)}
        scan, by_index = as_dict(search.hits(shelf, spec)), as_dict(search.hits(shelf, spec, index))
        assert scan.keys() == want and by_index == scan, keywords
        assert search.total(shelf, spec, index).first()[0] == len(want)
        assert [r.id for r in search.page(shelf, spec, index).collect()] == [r.id for r in search.page(shelf, spec).collect()]


def test_a_count_reads_no_text(spark, shelf, tmp_path):
    """Only the lists of the asked words' buckets are read, and no column of texts."""
    path, index = str(tmp_path / "shelf"), search.Index(str(tmp_path / "words"))
    shelf.write.parquet(path)
    textindex.write(shelf, index.words, textindex.WORDS)
    counted = search.total(spark.read.parquet(path), search.Search(NOW, keywords=["data lead"]), index)
    with contextlib.redirect_stdout(io.StringIO()) as shown:
        counted.explain("formatted")
    plan = shown.getvalue()
    scans = re.findall(r"ReadSchema: (\S+)", plan)
    assert scans and not any("description" in s or "title" in s for s in scans)
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ IN \(\d+,\d+\)", plan) and re.search(r"PushedFilters: \[.*In\(term, \[data,lead\]\)", plan)


def test_refreshed_index(spark, shelf, tmp_path):
    """Changed, new and removed rows; a version written again replaces itself; compacting changes nothing."""
    folder = str(tmp_path / "words")
    textindex.write(shelf, folder, textindex.WORDS)
    changed = shelf.filter("id % 5 = 0").withColumn("title", F.lit("fresh words a b")).unionByName(spark.createDataFrame([(1000, "fresh a", None, NOW)], shelf.schema))
    gone = shelf.filter("id % 5 = 1").select("id")
    for _ in range(2):
        textindex.write(changed, folder, textindex.WORDS, 1, gone)
    after = shelf.filter("id % 5 > 1").unionByName(changed)
    textindex.write(changed.filter("id = 10").withColumn("title", F.lit("once more")), folder, textindex.WORDS, 2)
    after = after.withColumn("title", F.when(F.col("id") == 10, "once more").otherwise(F.col("title")))
    textindex.compacted(spark, folder, str(tmp_path / "compact"))
    for keywords in [*ASKED, ["fresh"], ["once more"]]:
        spec = search.Search(NOW, keywords=keywords)
        want = as_dict(search.hits(after, spec))
        assert as_dict(search.hits(after, spec, search.Index(folder))) == want == as_dict(search.hits(after, spec, search.Index(str(tmp_path / "compact"))))


def test_substrings_by_grams(spark, shelf, tmp_path):
    """Rows as by reading every text; candidates are few where the pattern is rare."""
    rare = spark.createDataFrame([(2000 + i, "t", f"some Rar%e pat{'tern' if i % 2 else 'tem'} 日本語x", NOW) for i in range(6)], shelf.schema)
    rows = shelf.unionByName(rare)
    index = search.Index(grams=str(tmp_path / "grams"))
    textindex.write(rows, index.grams, textindex.GRAMS)
    for pattern in ("pattern", "PATT", "a, b", "ta", "x", "", "日本語", "pat%tern", "r_r", "no such thing", "team lead", "über"):
        spec = search.Search(NOW, without=[pattern])
        assert sorted(r.id for r in search.hits(rows, spec, index).collect()) == sorted(r.id for r in search.hits(rows, spec).collect()), pattern
        level = search.Search(NOW, seniority=pattern)
        if pattern:
            assert sorted(r.id for r in search.hits(rows, level, index).collect()) == sorted(r.id for r in search.hits(rows, level).collect()), pattern
    assert textindex.candidates(spark, index.grams, "pattern", ("description",)).count() <= 6
    assert textindex.candidates(spark, index.grams, "no such thing", ("description",)).count() == 0
    assert textindex.candidates(spark, index.grams, "ab", ("title",)) is None


def test_grams_of_odd_texts(spark):
    texts = ["", "ab", "abc", "ABCab cabc", None, "😀é日x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    got = [r.g for r in rows.select(textindex.grams(F.col("t")).alias("g")).collect()]
    want = lambda t: None if t is None else ["", *dict.fromkeys(t.lower()[i : i + 3] for i in range(len(t) - 2))]
    assert got == [want(t) for t in texts]
    assert [r.w for r in rows.select(textindex.words(F.col("t")).alias("w")).collect()] == [None if t is None else ["", *split_words(t)] for t in texts] and T


def _plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as shown:
        df.explain("formatted")
    return shown.getvalue()


@pytest.mark.parametrize("kind", ["WORDS", "GRAMS"])
def test_terms_are_not_shuffled(spark, shelf, tmp_path, kind):
    """A task lists the terms of its own texts, in blocks: no exchange of terms, and a term that all texts have is a row for each block."""
    made = textindex.entries(shelf, getattr(textindex, kind))
    assert "Exchange" not in _plan(made)
    n = made.filter("term = '' AND field = 'description'").select(F.sum(F.size("ids")), F.count(F.lit(1))).first()
    assert n[0] == shelf.filter("description IS NOT NULL").count() and n[1] <= made.rdd.getNumPartitions()


def test_blocks_of_texts(shelf):
    """Texts listed in several blocks, some without any text, give what one block gives."""
    for kind in (textindex.WORDS, textindex.GRAMS):
        sent = shelf.select("id", kind.sent(F.col("description")).alias("d")).toArrow().combine_chunks().to_batches()[0]

        def listed(at, n):
            ids, texts = sent.column(0).slice(at, n), sent.column(1).slice(at, n)
            return [] if texts.null_count == len(texts) else [(t, *x) for t, *lists in zip(*(c.to_pylist() for c in kind.listed(ids, texts))) for x in zip(*lists)]

        assert sorted(x for at in range(0, 400, 3) for x in listed(at, 3)) == sorted(listed(0, 400))


def test_patterns_are_verified_together(spark, shelf, tmp_path):
    """The texts are read once for all excluded terms, beside the rows themselves."""
    path, index = str(tmp_path / "shelf"), search.Index(grams=str(tmp_path / "grams"))
    shelf.write.parquet(path)
    textindex.write(shelf, index.grams, textindex.GRAMS)
    held = _plan(search.filtered(spark.read.parquet(path), search.Search(NOW, without=["data", "lead", "team"]), index))
    assert len(re.findall(r"ReadSchema: \S*description", held)) == 2

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, words string, block int, rank int, target string, extra string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows, ties, and columns named like the operators' own."""
    words = "the quick brown fox jumps over a lazy dog while seven wizards brew strange potions near an old mill".split()
    base = " ".join(words * 3)
    long = " ".join(f"w{i % 977} {words[i % len(words)]}" for i in range(30_000))
    rows = [
        (1, base, "en", "a"), (1, base, "en", "a"), (2, base + " indeed", "en", "a"), (3, None, "en", "b"), (4, "", None, None), (5, "word", "de", ""), (6, long, "en", "a"), (7, long + " end", "en", "b"),
        (None, "no id here at all", "en", "c"), (None, None, None, None), (8, "  \n\t ", "en", "a"), (9, "ein ganz anderer satz mit worten " * 4, "de", "b"), (10, "naïve 日本語 😀 texts, with. stops!", "xx", "c"), (5, "another text with an id that repeats", "en", "a"),
    ]
    rows = [(*r, None if r[1] is None else len(r[1]), "x", 1, 2, "t", None) for r in rows]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)

"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior over the languages:

* the text: hashed byte trigrams of letters, multinomial with counts over all documents by declared language;
* the declared markup language, right with probability DECLARED_RIGHT;
* the address suffix and the host, as a prior smoothed in steps: a host's counts of languages (as the
  text alone tells them) lean on its suffix's, and these on all documents', by STRENGTH rows each.

One more hypothesis, "und", has evenly likely trigrams: a text that fits no language falls to it.
All counts come from grouped aggregation over all rows; a host with a third of the rows is summed
before the shuffle.

Every declared language takes part.  A language is a tag of two or three letters, so their number is
bounded whatever the corpus holds; their tables of 128 KB each are made and broadcast in blocks of BLOCK languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import TEXTS_A_BATCH, joined_with_hot, stage

BITS = 15
#: Languages whose tables are made at a time, and kept by a task that counts.
BLOCK = 32
DECLARED_RIGHT = 0.9
STRENGTH = 20.0
#: Neighbouring trigrams overlap and repeat, so a text counts as so many independent ones at most.
INDEPENDENT = 200.0
#: What "und" has of the prior: a short text needs to be far from every language to fall to it.
UNDETERMINED = 1e-9
ADDED_COUNT = 0.5
#: Rejected rows up to which their numbers, of eight bytes, are broadcast.
SENT = 200_000


def _trigrams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, hashed trigrams, which of them count, bounds) of stretches of texts of about 1 MB.

    Those of letters and spaces count: numbers, signs and codes tell nothing of a language.  A text's trigrams include its ends.
    """
    low = pc.utf8_lower(texts)
    sizes = pc.binary_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < len(low):
        upto, size = at, 0
        while upto < len(low) and (upto == at or size < 1_000_000):
            size += int(sizes[upto])
            upto += 1
        raw = np.frombuffer(b"".join(b" " + t + b" " for t in low.slice(at, upto - at).cast(pa.binary()).to_pylist()), np.uint8).astype(np.uint32)
        bounds = np.concatenate([[0], np.cumsum(sizes[at:upto] + 2)])
        h = np.zeros(len(raw), np.uint32)
        if len(raw) > 2:
            h[:-2] = (raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA6B) + raw[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)
        plain = (raw >= 128) | (raw == 32) | ((raw >= 97) & (raw <= 122))
        counts = np.zeros(len(raw), bool)
        counts[:-2] = plain[:-2] & plain[1:-1] & plain[2:]
        counts[np.concatenate([bounds[1:] - 1, bounds[1:] - 2])] = False  # these would reach into the next text
        yield at, upto, h, counts, bounds
        at = upto


def trigram_counts(texts: DataFrame) -> DataFrame:
    """declared, cell, n of all rows (declared, text): how often each hashed trigram occurs in the texts of a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, each in sums.items():
                at = np.flatnonzero(each)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(each[at], pa.int64())], names=["declared", "cell", "n"])
            sums.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, b, h, counts, bounds in _trigrams(batch.column(1)):
                place = {lang: i for i, lang in enumerate(sorted(set(langs[a:b])))}
                own = np.repeat(np.array([place[x] for x in langs[a:b]], np.int64), np.diff(bounds))
                cells, n = np.unique(((own << BITS) + h)[counts], return_counts=True)
                for lang, i in place.items():
                    if lang not in sums and len(sums) >= BLOCK:
                        yield from sent()
                    x, y = np.searchsorted(cells, [i << BITS, (i + 1) << BITS])
                    sums.setdefault(lang, np.zeros(1 << BITS, np.int64))[cells[x:y] - (i << BITS)] += n[x:y]
        yield from sent()

    return texts.mapInArrow(count, "declared string, cell long, n long").groupBy("declared", "cell").agg(F.sum("n").alias("n"))


def log_table(counts: np.ndarray) -> np.ndarray:
    """float32 (trigram, language): log probabilities of counts (language, trigram)."""
    smooth = counts + ADDED_COUNT
    return np.ascontiguousarray(np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32))


def _tables(counts: DataFrame, languages: list[str]) -> list:
    """A broadcast table for each block of languages."""
    out = []
    for at in range(0, len(languages), BLOCK):
        part = languages[at : at + BLOCK]
        got = counts.filter(F.col("declared").isin(part)).toArrow()
        table = np.zeros((len(part), 1 << BITS))
        place = {lang: i for i, lang in enumerate(part)}
        table[[place[x] for x in got.column(0).to_pylist()], got.column(1).to_numpy()] = got.column(2).to_numpy()
        out.append(counts.sparkSession.sparkContext.broadcast(log_table(table)))
    return out


def fused(docs: DataFrame, text: Column, declared: Column, suffix: Column, host: Column, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, told): rows have _row and _doc, the ``carry`` columns as a struct, of every row; told has _row, _lang (null for und), _probability and _accepted.  Both are written tables
    or read such, and told is narrow, so that no join over hosts moves what is carried.

    A null or empty text, or one without letters, is no evidence: declared language and priors decide.  A null declared
    language, or one that isn't a tag of two or three letters (what follows a hyphen is left out), is none either; null suffixes and hosts
    are one suffix and one host.  A row is rejected only if und is the likeliest.  Without any declared language in the
    table every row is accepted with a null language.  An empty table gives no rows.
    """
    said = F.lower(F.split_part(declared.cast("string"), F.lit("-"), F.lit(1)))
    said = F.when(said.rlike("^[a-z]{2,3}$"), said)
    rows = docs.select(F.struct(*carry).alias("_doc"), F.monotonically_increasing_id().alias("_row"), said.alias("_declared"), F.coalesce(suffix.cast("string"), F.lit("")).alias("_suffix"), F.coalesce(host.cast("string"), F.lit("")).alias("_host"), F.coalesce(text, F.lit("")).alias("_text"))
    counts = stage(trigram_counts(rows.filter("_declared IS NOT NULL").select(F.col("_declared").alias("declared"), F.col("_text").alias("text"))), "trigrams", batch=TEXTS_A_BATCH)
    languages = sorted(r[0] for r in rows.filter("_declared IS NOT NULL").select("_declared").distinct().collect())
    n_langs = len(languages)
    if not languages:
        table = stage(rows.select("_row", "_doc"), "languages")
        return table, table.select("_row", F.lit(None).cast("string").alias("_lang"), F.lit(1.0).alias("_probability"), F.lit(True).alias("_accepted"))
    tables = _tables(counts, languages)

    @F.arrow_udf("array<double>")
    def score(texts: pa.Array) -> pa.Array:
        """Log-likelihoods by language and und: only the text goes to Python, and only these numbers come back."""
        out = []
        for a, b, h, counts, bounds in _trigrams(texts):
            n = np.add.reduceat(counts, bounds[:-1], dtype=np.int64)
            sums = np.empty((b - a, n_langs + 1))
            sums[:, n_langs] = n * -np.log(1 << BITS)
            at = 0
            for table in tables:
                for lang in range(table.value.shape[1]):
                    each = table.value[h, lang].astype(np.float64)
                    each[~counts] = 0.0
                    sums[:, at] = np.add.reduceat(each, bounds[:-1])
                    at += 1
            out.append(np.round(sums * np.minimum(1.0, INDEPENDENT / np.maximum(n, 1))[:, None], 6))
        flat = np.concatenate(out) if out else np.zeros((0, n_langs + 1))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, n_langs + 1), pa.int32()), pa.array(flat.ravel()))

    likely = F.slice("_logs", 1, n_langs)
    # Without a trigram that counts all numbers are 0, and the text takes no part in the priors.
    best = F.when(F.get("_logs", F.lit(n_langs)) < 0, F.array_position(likely, F.array_max(likely)) - 1).otherwise(-1).cast("int")
    table = stage(rows.withColumn("_logs", score(F.col("_text"))).withColumn("_best", best).drop("_text"), "languages", batch=TEXTS_A_BATCH)
    scored = table.drop("_doc")
    n = scored.count()  # hosts are as many at most
    every = stage(scored.groupBy("_suffix", "_host", "_best").agg(F.count(F.lit(1)).alias("n")), "told", n)
    told = every.filter("_best >= 0")
    by_suffix = stage(told.groupBy("_suffix", "_best").agg(F.sum("n").alias("n")), "suffixes", n)
    whole = {r["_best"]: float(r["n"]) for r in by_suffix.groupBy("_best").agg(F.sum("n").alias("n")).collect()}
    whole = [whole.get(i, 0.0) + ADDED_COUNT for i in range(n_langs)]
    overall = F.array(*[F.lit(x / sum(whole)) for x in whole])

    def by_language(counts: DataFrame, *keys: str) -> DataFrame:
        listed = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_best", "n"))).alias("by"))
        return listed.withColumn("by", F.transform(F.sequence(F.lit(0), F.lit(n_langs - 1)), lambda i: F.coalesce(F.col("by")[i], F.lit(0))))

    def leaning(upon: Column) -> Column:
        """A prior of the counts by language and STRENGTH rows of ``upon``."""
        total = F.aggregate("by", F.lit(0.0), lambda s, n: s + n) + STRENGTH
        return F.transform(F.zip_with("by", upon, lambda n, p: n + p * STRENGTH), lambda x: x / total)

    # A host that no text tells anything of has its suffix's prior, and such a suffix that of all.
    suffixes = by_language(by_suffix, "_suffix").select("_suffix", leaning(overall).alias("_upper"))
    suffixes = stage(every.select("_suffix").distinct().join(suffixes, "_suffix", "left").select("_suffix", F.coalesce("_upper", overall).alias("_upper")), "upper", n)
    hosts = stage(every.select("_suffix", "_host").distinct().join(by_language(told, "_suffix", "_host"), ["_suffix", "_host"], "left"), "hosts", n)
    hosts = joined_with_hot(hosts, suffixes, ["_suffix"], n)
    priors = stage(hosts.select("_suffix", "_host", F.coalesce(leaning(F.col("_upper")), "_upper").alias("_prior")), "priors", n)
    joined = joined_with_hot(scored, priors, ["_suffix", "_host"], n)
    names = F.array(*[F.lit(x) for x in languages])
    wrong = (1 - DECLARED_RIGHT) / max(1, n_langs - 1)
    evidence = F.transform(names, lambda x: F.when(F.col("_declared").isNotNull(), F.log(F.when(x == F.col("_declared"), F.lit(DECLARED_RIGHT)).otherwise(max(wrong, 1e-6)))).otherwise(0.0))
    und = F.get(F.col("_logs"), F.lit(n_langs)) + float(np.log(UNDETERMINED))
    known = F.zip_with(F.zip_with(F.slice("_logs", 1, n_langs), F.transform("_prior", lambda p: F.log(p)), lambda a, b: a + b), evidence, lambda a, b: a + b)
    joined = joined.withColumn("_post", F.concat(known, F.array(und)))
    top = F.array_max("_post")
    joined = joined.withColumn("_at", F.array_position("_post", top)).withColumn("_probability", 1.0 / F.aggregate("_post", F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    joined = joined.withColumn("_accepted", F.col("_at") <= n_langs)
    told = joined.select("_row", F.when(F.col("_accepted"), F.get(names, (F.col("_at") - 1).cast("int"))).alias("_lang"), "_probability", "_accepted")
    return table.select("_row", "_doc"), stage(told, "identified", n)


def page_evidence(html: Column, url: Column) -> tuple[Column, Column, Column]:
    """(declared markup language, address suffix, host) of a web page."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    return F.nullif(F.regexp_extract(html, r"""(?i)<html[^>]*\blang\s*=\s*["']?([A-Za-z]+)""", 1), F.lit("")), F.substring_index(host, ".", -1), host


def page_text(html: Column) -> Column:
    """The letters of a page outside its markup, scripts and styles."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*>", " "), "<[^>]*+>|&[a-zA-Z#0-9]{1,8};", " ")


def identify(docs: DataFrame, text: Column, declared: Column, suffix: Column, host: Column, carry: list[str]) -> DataFrame:
    """The ``carry`` columns of every row with _lang, _probability and _accepted, as fused() tells them."""
    rows, told = fused(docs, text, declared, suffix, host, carry)
    return rows.join(told, "_row").select("_doc.*", "_lang", "_probability", "_accepted")


def _shown(got: DataFrame, id_col: str) -> DataFrame:
    return got.select(id_col, F.col("_lang").alias("language"), F.round("_probability", 6).alias("probability"), F.col("_accepted").alias("accepted"))


def page_query(pages: DataFrame) -> DataFrame:
    """page_id, language, probability, accepted of pages (page_id, url, html), with all four kinds of evidence."""
    declared, suffix, host = page_evidence(F.col("html"), F.col("url"))
    return _shown(identify(pages, page_text(F.col("html")), declared, suffix, host, ["page_id"]), "page_id")


def query(docs: DataFrame) -> DataFrame:
    return _shown(identify(docs, F.col("text"), F.col("lang"), F.lit(""), F.col("source"), ["doc_id"]), "doc_id")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that fit no language."""
    rows, told = fused(docs, F.col("text"), F.col("lang"), F.lit(""), F.col("source"), ["*"])
    gone = told.filter("NOT _accepted").select("_row")
    # Few ids go to every task; many are a join over the rows' numbers, which are even.
    return rows.join(F.broadcast(gone) if gone.count() <= SENT else gone, "_row", "left_anti").select("_doc.*")

"""Secret scan with corpus-wide ownership frequency.  DataFrame functions only.

Method: every text is searched for candidate values.  The hashes of the values are aggregated over
the corpus by distinct owner and distinct repository: a value that many hold is a widely copied
example, one that few hold and that isn't a placeholder is owner-specific and likely live.

Finding the places of matches without Python: a mark that the text can't hold is put around each
match's two groups, the text is split at the marks, and running sums of the parts' lengths are the
places, in code points.  The sums are a window over a text's matches, so the work is linear in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import joined_with_hot, stage

# Kinds in their order, and the two groups of each pattern (what leads to a value, the value).
KINDS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""",
    "access": r"()(AKIA[A-Z0-9]{16,})",
    "hex": r"()([0-9a-f]{24,})",
    "pem": r"()(-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]++|-(?!----(?:BEGIN|END) [A-Z ]*PRIVATE KEY-----))*+-----END [A-Z ]*PRIVATE KEY-----)?)",
}
#: What the ownership method adds to the kinds of the plain scan: a private key, from its first line to its last.
ADDED = ("pem",)
LEAST_ASSIGNED = 6
#: Owners from which on a value counts as widely copied; for one that two owners hold, repositories.
WIDE_OWNERS, WIDE_REPOS = 3, 6
#: Different characters from which on a hexadecimal value looks random.
RANDOM_CHARACTERS = 8
#: Assigned values that stand for one.
PLACEHOLDER = r"(?i)^(?:(.)\1*|(?:your|my|the|some|this|an?|new|old|test|dummy|fake|sample|example|change|insert|enter|put|todo)[-_.].*|.*(?:example|placeholder|changeme|xxxx|here)|none|null|true|false|undefined|required|optional|password|passwd|secret|token|api_?key)$"

_MARK = "\u0001"


def with_parts(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with _parts, array<struct<kind_no, gap, lead, value>>: each kind's leftmost matches that don't overlap, in their order, and how long the text before each one is, since the last."""
    held = F.coalesce(text, F.lit(""))
    split = lambda pattern: F.split(F.regexp_replace(F.translate(held, _MARK, "\u0002"), pattern, f"{_MARK}$1{_MARK}$2{_MARK}"), _MARK, -1)
    # The split texts are columns of their own, as a lambda would split the text again for each of its items.
    cut = docs.withColumns({f"_cut{no}": F.when(held.rlike(pattern), split(pattern)) for no, pattern in enumerate(KINDS.values())})

    def triples(no: int) -> Column:
        # before, lead, value, before, lead, value, ..., rest
        of = F.col(f"_cut{no}")
        each = F.transform(F.sequence(F.lit(0), ((F.size(of) - 1) / 3 - 1).cast("int")), lambda i: F.struct(F.lit(no).alias("kind_no"), F.length(of[i * 3]).alias("gap"), F.length(of[i * 3 + 1]).alias("lead"), of[i * 3 + 2].alias("value")))
        return F.when(of.isNotNull(), each).otherwise(F.array().cast("array<struct<kind_no:int,gap:int,lead:int,value:string>>"))

    return cut.withColumn("_parts", F.concat(*map(triples, range(len(KINDS))))).drop(*[f"_cut{no}" for no in range(len(KINDS))])


def spans(held: DataFrame) -> DataFrame:
    """row, owner, repo, kind_no, start, value_start, stop, hash, plausible of rows (row, owner, repo, parts), a row for each match that counts."""
    each = held.repartition("row").select("row", "owner", "repo", F.posexplode("parts").alias("no", "p")).select("row", "owner", "repo", "no", "p.*")
    size = F.length("value")
    upto = F.sum(F.col("gap") + F.col("lead") + size).over(Window.partitionBy("row", "kind_no").orderBy("no")).cast("int")
    value, kind = F.col("value"), lambda name: F.col("kind_no") == list(KINDS).index(name)
    # A key is told by its body, not by lines that all keys share.
    body = F.regexp_replace("value", r"-----[A-Z ]+-----|[\x20\x09-\x0D]", "")
    random = (F.size(F.array_distinct(F.split("value", ""))) >= RANDOM_CHARACTERS) & value.rlike("[0-9]") & value.rlike("[a-z]")
    plausible = F.when(kind("assign"), ~value.rlike(PLACEHOLDER)).when(kind("access"), ~F.contains("value", F.lit("EXAMPLE"))).when(kind("pem"), body != "").otherwise(random)
    each = each.select("row", "owner", "repo", "kind_no", (upto - size - F.col("lead")).alias("start"), (upto - size).alias("value_start"), upto.alias("stop"), size.alias("size"), F.sha2(F.when(kind("pem"), body).otherwise(value), 256).alias("hash"), plausible.alias("plausible"))
    return each.filter(~kind("assign") | (F.col("size") >= LEAST_ASSIGNED)).drop("size")


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos, n_found of candidates (hash, owner, repo).  A value that a third of all documents hold is summed before the shuffle."""
    each = candidates.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = each.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_found"))


def judged(found: DataFrame) -> DataFrame:
    """What spans() gives with n_owners, n_repos and verdict: example (held widely), live (held by few, and plausible) or other."""
    wide = (F.col("n_owners") >= WIDE_OWNERS) | ((F.col("n_owners") == WIDE_OWNERS - 1) & (F.col("n_repos") >= WIDE_REPOS))
    held = ownership(found).drop("n_found")
    return joined_with_hot(found, held, ["hash"], found.count()).withColumn("verdict", F.when(wide, "example").when(F.col("plausible"), "live").otherwise("other"))


def _prepared(docs: DataFrame, owner: Column, repo: Column, text_col: str) -> DataFrame:
    """_doc (the row as it is), _row, _owner, _repo and _parts of every row."""
    known = docs.select(F.struct("*").alias("_doc"), F.coalesce(owner.cast("string"), F.lit("")).alias("_owner"), F.coalesce(repo.cast("string"), F.lit("")).alias("_repo"), F.monotonically_increasing_id().alias("_row"))
    return with_parts(known, F.col("_doc")[text_col])


def _holding(table: DataFrame) -> DataFrame:
    return table.filter(F.size("_parts") > 0).select(F.col("_row").alias("row"), F.col("_owner").alias("owner"), F.col("_repo").alias("repo"), F.col("_parts").alias("parts"))


def scan(docs: DataFrame, owner: Column, repo: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_assign, n_access, n_hex, base_sha256, spans, of the
    candidates n_example (held by WIDE_OWNERS owners or more, or by one less in WIDE_REPOS repositories),
    n_live (by fewer, and plausible for their kind) and n_other, and the most owners and
    repositories that any of them has (0 without candidates).

    A null text counts as empty and has no spans; null owners or repositories count as one unknown
    owner.  Repeated rows are rows of their own.  An empty table gives no rows.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), owner.alias("_by"), repo.alias("_in"))
    table = stage(_prepared(narrow, F.col("_by"), F.col("_in"), "_text").select(F.col("_doc.doc_id").alias("doc_id"), "_row", "_owner", "_repo", "_parts"), "secrets")
    found = stage(judged(stage(spans(_holding(table)), "spans")), "judged")
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda which: F.array_join(F.transform(F.filter("all", which), lambda s: F.concat_ws(":", names[s["kind_no"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    kind_no = {k: no for no, k in enumerate(KINDS)}
    count = lambda where, name: F.count_if(where).alias(name)
    counts = [*[count(F.col("kind_no") == kind_no[k], f"n_{k}") for k in ("assign", "access", "hex")], *[count(F.col("verdict") == v, f"n_{v}") for v in ("example", "live", "other")]]
    by_row = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind_no", "stop"))).alias("all"), *counts, F.max("n_owners").alias("most_owners"), F.max("n_repos").alias("most_repos"))
    by_row = by_row.select("*", F.sha2(shown(lambda s: ~s["kind_no"].isin([kind_no[k] for k in ADDED])), 256).alias("base_sha256"), shown(lambda s: s["kind_no"].isNotNull()).alias("spans")).drop("all")
    # Rows without candidates take no part in the join.
    some = table.filter(F.size("_parts") > 0).select("doc_id", "_row").join(by_row, F.col("_row") == F.col("row"), "left")
    both = some.drop("_row", "row").unionByName(table.filter(F.size("_parts") == 0).select("doc_id"), allowMissingColumns=True)
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return both.select(
        "doc_id", *[zero(f"n_{k}") for k in ("assign", "access", "hex")], F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
        *[zero(c) for c in ("n_example", "n_live", "n_other", "most_owners", "most_repos")],
    )


def redact(docs: DataFrame, owner: Column, repo: Column, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with the values of live-looking secrets replaced by ``mask``, values that overlap by one; the other rows, and all other columns, stay as they are, whatever their names.

    The texts are searched once and staged with what was found.  Rows without candidates take no part in any shuffle.
    """
    table = stage(_prepared(docs, owner, repo, text_col), "secrets")
    live = judged(stage(spans(_holding(table)), "spans")).filter("verdict = 'live'")
    in_order = Window.partitionBy("row").orderBy("value_start", "stop")
    reached = F.max("stop").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    live = live.withColumn("new", (reached.isNull() | (F.col("value_start") >= reached)).cast("int")).withColumn("island", F.sum("new").over(in_order))
    islands = live.groupBy("row", "island").agg(F.min("value_start").alias("start"), F.max("stop").alias("stop"))
    listed = islands.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("_live"))
    text = F.col("_doc")[text_col]
    before = lambda i: F.when(i > 0, F.get("_live", i - 1)["stop"]).otherwise(0)
    pieces = F.transform("_live", lambda s, i: F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), F.lit(mask)))
    rest = F.element_at("_live", -1)["stop"]
    masked = F.concat(F.array_join(pieces, ""), F.substring(text, rest + 1, F.length(text)))
    changed = table.filter(F.size("_parts") > 0).join(listed, F.col("_row") == F.col("row"), "left").select(F.col("_doc").withField(f"`{text_col}`", F.when(F.col("_live").isNull(), text).otherwise(masked)).alias("_doc"))
    return table.filter(F.size("_parts") == 0).select("_doc").unionByName(changed).select("_doc.*")

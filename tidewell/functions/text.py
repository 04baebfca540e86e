"""Text functions of the posting engine, as Column builders.

Python's notion of white space and of lower case is what the engine promises; where Spark's differ,
the comment says so.  All of them stay in the JVM.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Tokens that name a legal form, the label that isn't an employer, and separators before an echoed name.
LEGAL_FORMS = ("gmbh", "mbh", "ag", "se", "kg", "kgaa", "ug", "ohg", "gbr", "co", "ev", "ltd", "llc", "inc", "plc", "holding")
APPLY_LABEL = "bewerbung als"
ECHO_SEPARATORS = "-–—|:"

# Phrases of a location that mean remote or hybrid work.
REMOTE_PHRASES = ("remote", "homeoffice", "home office", "fully remote", "anywhere", "work from home")
HYBRID_PHRASE = "hybrid"

# Phrases of a page that blocks machines.
BLOCK_MARKERS = ("unusual traffic", "ungewöhnlichen datenverkehr", "datenverkehr von ihrem", "kein roboter", "not a robot", "verify you are human", "captcha", "enable javascript", "access denied")

# Patterns that place a location string. Bare ", DE" is Delaware and doesn't count as Germany.
GERMAN_PLACE = (
    r"(?iu)\b(germany|deutschland|berlin|m[uü]nchen|munich|hamburg|k[oö]ln|cologne|frankfurt|stuttgart|d[uü]sseldorf|dusseldorf|leipzig|dortmund|essen|bremen|dresden"
    r"|hannover|hanover|n[uü]rnberg|nuremberg|duisburg|bochum|wuppertal|bielefeld|bonn|m[uü]nster|karlsruhe|mannheim|augsburg|wiesbaden|gelsenkirchen|aachen|braunschweig"
    r"|kiel|freiburg|heidelberg|mainz|erfurt|rostock|kassel|potsdam|saarbr[uü]cken|ulm|regensburg|w[uü]rzburg|ingolstadt|heilbronn|darmstadt|oldenburg|osnabr[uü]ck"
    r"|wolfsburg|paderborn|leverkusen|jena|walldorf)\b"
)
REMOTE_WORK = r"(?iu)\bremote\b|\banywhere\b|\bdistributed\b|work from home|\bwfh\b"
FOREIGN_PLACE = (
    r"(?iu)\b(usa?|united states|u\.s|canada|uk|united kingdom|india|ireland|romania|latam|apac|poland|netherlands|france|spain|portugal|italy|brazil|mexico|australia"
    r"|singapore|philippines|costa rica|colombia|argentina|south africa|denmark|sweden|norway|finland|belgium|austria|switzerland|czech|ukraine|turkey|egypt|kenya"
    r"|nigeria|israel|uae|dubai|japan|china|korea|vietnam|indonesia|malaysia|thailand|new york|california|texas)\b|,\s*[a-z]{2}\b"
)


def blank(col: Column) -> Column:
    """Null as the empty text."""
    return F.coalesce(col, F.lit(""))


def filled(col: Column) -> Column:
    """The empty text as null: for coalesce chains."""
    return F.nullif(col, F.lit(""))


def strip(col: Column) -> Column:
    """Without Unicode white space at both ends; Spark's trim takes U+0020 alone."""
    return F.regexp_replace(F.regexp_replace(blank(col), r"(?U)^\s+", ""), r"(?U)\s+$", "")


def collapsed(col: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.regexp_replace(strip(F.lower(blank(col))), r"(?U)\s+", " ")


def identity_field(col: Column) -> Column:
    """A title or company for the content hash: lower case, without bracketed parts, ASCII letters and digits only."""
    bare = F.regexp_replace(F.lower(blank(col)), r"\(.*?\)", " ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def identity_company(col: Column) -> Column:
    """Like identity_field, empty for the apply label, without tokens that name a legal form."""
    words = identity_field(col)
    kept = F.trim(F.regexp_replace(F.regexp_replace(words, r"\b(" + "|".join(LEGAL_FORMS) + r")\b", " "), r"\s+", " "))
    return F.when((words == APPLY_LABEL) | words.startswith(APPLY_LABEL + " "), "").otherwise(kept)


def title_stem(title: Column, company: Column) -> Column:
    """The title's identity without the company's name at its end."""
    stem, name = identity_field(title), identity_company(company)
    echoed = (name != "") & F.endswith(stem, F.concat(F.lit(" "), name))
    return F.when(echoed, F.left(stem, F.length(stem) - F.length(name) - 1)).otherwise(stem)


def content_hash(title: Column, company: Column) -> Column:
    """16 hex digits that a posting has on every board."""
    return F.left(F.sha2(F.concat(title_stem(title, company), F.lit("|"), identity_company(company)), 256), F.lit(16))


def stable_id(external_id: Column, url: Column, hashed: Column) -> Column:
    """The given id, else the address, else the content hash: never empty."""
    return F.coalesce(filled(external_id), filled(strip(url)), hashed)


def text_hash(col: Column) -> Column:
    return F.sha2(collapsed(col), 256)


def fetch_checksum(body: Column) -> Column:
    return F.sha2(blank(body), 256)


def without_echo(title: Column, company: Column) -> Column:
    """The raw title without a separator and the company's name at its end, in any case."""
    echo = F.concat(F.lit(rf"(?iu)\s*[{ECHO_SEPARATORS}]\s*\Q"), F.regexp_replace(company, r"\\E", ""), F.lit(r"\E\s*$"))
    return F.when(blank(company) != "", F.regexp_replace(title, echo, F.lit(""))).otherwise(title)


_APPLY_PREFIX = rf"(?i)^\s*{re.sub(' ', r'\\s+', APPLY_LABEL)}\b[:\s]*"


def feed_company(col: Column) -> Column:
    """A feed's company field: the apply label is none."""
    return F.when(strip(col).rlike(_APPLY_PREFIX), "").otherwise(strip(col))


def feed_title(title: Column, company: Column) -> Column:
    """A feed's title without the apply label before it and the company after it."""
    return strip(without_echo(F.regexp_replace(strip(title), _APPLY_PREFIX, ""), strip(company)))


def like_escaped(col: Column) -> Column:
    """With the wild cards of LIKE as ordinary characters."""
    return F.regexp_replace(col, r"([\\%_])", r"\\$1")


def char_shingles(col: Column, size: int = 5) -> Column:
    """The set of runs of ``size`` characters of the collapsed text; shorter texts are their own."""
    text = collapsed(col)
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(places, lambda at: F.substring(text, at, F.lit(size))))


def _decompositions() -> tuple[str, str]:
    """The characters of the basic plane whose compatibility decomposition (NFKD) without marks is one other character, these, then the marks themselves."""
    one, to, marks = [], [], []
    for code in (c for c in range(0xA0, 0x10000) if not 0xD800 <= c <= 0xDFFF):
        if unicodedata.combining(chr(code)):
            marks.append(chr(code))
        elif len(bare := _bare(chr(code))) == 1 and bare != chr(code):
            one.append(chr(code))
            to.append(bare)
    return "".join(one + marks), "".join(to)


def _bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


_COMPOSED, _PLAIN = _decompositions()
#: What may become several characters: Latin letters and signs such as ½ and ĳ, and nearly all scripts beyond Latin.
_SEVERAL = "[^\\x00-\u024f]|[\u00a8\u00af\u00b4\u00b8\u00bc-\u00be\u0132\u0133\u013f\u0140\u0149\u01c4-\u01cc\u01f1-\u01f3]"


@F.arrow_udf(StringType())
def _spelt(texts: pa.Array) -> pa.Array:
    return pa.array([t if t is None else _bare(t) for t in texts.to_pylist()], pa.string())


def unaccented(col: Column) -> Column:
    """Lower case without accents and in plain forms, as by NFKD; letters that only look accented (ø, ß) stay.  Only texts with characters that may become several leave the JVM."""
    low = F.translate(F.lower(blank(col)), _COMPOSED, _PLAIN)
    return F.coalesce(_spelt(F.when(low.rlike(_SEVERAL), low)), low)


def without_brackets(col: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(blank(col), r"\([^)]*\)", " "), r"(?U)\s+", " "))


def is_remote(location: Column) -> Column:
    low = F.lower(blank(location))
    return F.exists(F.array(*[F.lit(p) for p in REMOTE_PHRASES]), lambda p: F.contains(low, p))


def is_hybrid(location: Column) -> Column:
    return F.contains(F.lower(blank(location)), F.lit(HYBRID_PHRASE))


def looks_blocked(text: Column) -> Column:
    low = F.lower(blank(text))
    return F.exists(F.array(*[F.lit(m) for m in BLOCK_MARKERS]), lambda m: F.contains(low, m))


# -- addresses -----------------------------------------------------------------------------------


def url_host(url: Column) -> Column:
    return F.lower(blank(F.try_parse_url(url, F.lit("HOST"))))


def host_blocked(url: Column, hosts: list[str]) -> Column:
    """Whether the address's host is one of ``hosts`` or below one."""
    host = url_host(url)
    return F.exists(F.array(*[F.lit(h.lower()) for h in hosts]).cast("array<string>"), lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h)))


def resolution_provider(url: Column) -> Column:
    """'' for what can't be fetched, 'greenhouse' for that board's hosts, else 'generic'."""
    web = F.lower(blank(F.try_parse_url(url, F.lit("PROTOCOL")))).isin("http", "https") & (url_host(url) != "")
    return F.when(~web, "").when(F.contains(url_host(url), F.lit("greenhouse.io")), "greenhouse").otherwise("generic")


def board_and_job(url: Column) -> Column:
    """struct(board, job): what stands before and the number after /jobs/ in the path."""
    path = blank(F.try_parse_url(url, F.lit("PATH")))
    return F.struct(F.regexp_extract(path, r"([^/]+)/jobs/(\d+)", 1).alias("board"), F.regexp_extract(path, r"([^/]+)/jobs/(\d+)", 2).alias("job"))


def domain_of_url(url: Column) -> Column:
    """A posting's company domain: the board's name + .com, nothing for search sites, else the host without www."""
    host, path = url_host(url), F.regexp_replace(blank(F.try_parse_url(url, F.lit("PATH"))), "^/+", "")
    bare = F.replace(host, F.lit("www."), F.lit(""))
    site = F.contains(host, F.lit("indeed.com")) | F.contains(host, F.lit("adzuna.com"))
    return F.when(F.contains(host, F.lit("greenhouse.io")), F.concat(F.split_part(path, F.lit("/"), F.lit(1)), F.lit(".com"))).when(site, "").when(F.contains(bare, F.lit(".")), bare).otherwise("")


def domain_of_name(name: Column) -> Column:
    first = F.split_part(strip(F.regexp_replace(F.lower(blank(name)), r"[^a-z0-9\s]", "")), F.lit(" "), F.lit(1))
    return F.when(first != "", F.concat(first, F.lit(".com"))).otherwise("")


def slug_as_title(url: Column) -> Column:
    """The last part of a path as words, without a trailing number."""
    last = F.element_at(F.split(F.regexp_replace(blank(url), "/+$", ""), "/"), -1)
    return F.initcap(F.trim(F.replace(F.regexp_replace(last, r"-\d+$", ""), F.lit("-"), F.lit(" "))))


def pinned_location(html: Column) -> Column:
    """What a reader sees behind a pin sign, up to a middle dot or bar; null without the sign."""
    behind = F.substring(F.regexp_extract(blank(html), "(?s)📍(.*)", 1), 1, 259)
    seen = strip(F.regexp_replace(F.regexp_replace(behind, "<[^>]+>", " "), r"(?U)\s+", " "))
    return F.when(F.contains(blank(html), F.lit("📍")), strip(F.get(F.split(seen, "[·|]", 2), F.lit(0))))


def url_place(url: Column) -> Column:
    """What follows /job_posting/ in an address as words, without a trailing number."""
    last = F.element_at(F.split(F.regexp_replace(blank(url), "/+$", ""), "/job_posting/"), -1)
    return F.replace(F.regexp_replace(last, r"-\d+$", ""), F.lit("-"), F.lit(" "))


def id_token(col: Column) -> Column:
    return F.base64(F.encode(col, "UTF-8"))


def location_category(blob: Column) -> Column:
    """'de', 'remote' (no country named) or 'foreign'."""
    b = blank(blob)
    return F.when(b.rlike(GERMAN_PLACE), "de").when(b.rlike(REMOTE_WORK) & ~b.rlike(FOREIGN_PLACE), "remote").otherwise("foreign")


# -- words ---------------------------------------------------------------------------------------


def words(col: Column) -> Column:
    """Lower-case words, no stemming and no stop words."""
    return F.filter(F.split(F.lower(blank(col)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def first_title(*cols: Column) -> Column:
    """The first that isn't blank, trimmed, else ''."""
    return F.coalesce(*[filled(strip(c)) for c in cols], F.lit(""))

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions import values as V


def column(spark, values, *cols):
    schema = ", ".join(f"c{i} string" for i in range(len(values[0])))
    return [r[0] for r in spark.createDataFrame(values, schema).select(*cols).collect()]


@pytest.mark.parametrize(("one", "two", "same"), [
    (("Data Engineer (m/w/d)", "Amberra GmbH"), ("data engineer", "amberra"), True),
    (("Consultant - Capco", "Capco"), ("Consultant", "Capco AG"), True),
    (("Manager", "Bewerbung als Manager"), ("Manager", ""), True),
    (("Engineer Berlin", "X"), ("Engineer Hamburg", "X"), False),
    (("Engineer", "Siemens"), ("Engineer", "Bosch"), False),
    (("Lead", "Nordlicht SE & Co. KG"), ("Lead", "Nordlicht"), True),
    (("Agile Coach", "Agentur"), ("Agile Coach", "entur"), False),
])
def test_content_hash(spark, one, two, same):
    a, b = column(spark, [one, two], T.content_hash(F.col("c0"), F.col("c1")))
    assert (a == b) is same and len(a) == 16


def test_null_and_blank_identity(spark):
    rows = [(None, None), ("", "")]
    assert len(set(column(spark, rows, T.content_hash(F.col("c0"), F.col("c1"))))) == 1


def test_stable_id(spark):
    rows = [("e", "u", "h"), ("", " u\t", "h"), (None, " ", "h")]
    assert column(spark, rows, T.stable_id(F.col("c0"), F.col("c1"), F.col("c2"))) == ["e", "u", "h"]


def test_white_space_is_unicode(spark):
    rows = [("  Ein\t Text\n",), (None,), (" ",)]
    assert column(spark, rows, T.strip(F.col("c0"))) == ["Ein\t Text", "", ""]
    assert column(spark, rows, T.collapsed(F.col("c0"))) == ["ein text", "", ""]


def test_feed_cleaning(spark):
    rows = [("Bewerbung als Pflegekraft", ""), ("Title – Capco", "Capco"), ("Title | c.a+po (x)", "C.a+po (x)"), ("Bewerbung  als: Koch", "Bewerbung als")]
    company = T.feed_company(F.col("c1"))
    assert column(spark, rows, T.feed_title(F.col("c0"), company)) == ["Pflegekraft", "Title", "Title", "Koch"]
    assert column(spark, rows, company)[3] == ""


def test_unaccented(spark):
    assert column(spark, [("München",), ("Straße",), ("Ñandú",), ("Ä",)], T.unaccented(F.col("c0"))) == ["munchen", "straße", "nandu", "a"]


def test_shingles(spark):
    got = column(spark, [("Aaa  bb",), ("ab",)], T.char_shingles(F.col("c0")))
    assert sorted(got[0]) == ["aa bb", "aaa b"] and got[1] == ["ab"]


def test_addresses(spark):
    urls = [("https://boards.greenhouse.io/acme/jobs/123?x=1",), ("ftp://x.example/a",), ("",), (None,), ("https://www.firm.de/x",), ("https://de.indeed.com/v",)]
    assert column(spark, urls, T.resolution_provider(F.col("c0"))) == ["greenhouse", "", "", "", "generic", "generic"]
    assert column(spark, urls, T.domain_of_url(F.col("c0"))) == ["acme.com", "x.example", "", "", "firm.de", ""]
    assert tuple(column(spark, urls, T.board_and_job(F.col("c0")))[0]) == ("acme", "123")
    assert column(spark, urls, T.host_blocked(F.col("c0"), ["indeed.com"])) == [False] * 5 + [True]


def test_location_category(spark):
    rows = [("Berlin, Germany",), ("Wilmington, DE",), ("Remote",), ("Remote - US, Texas",), ("Köln",), (None,), ("Ulmer Weg",)]
    assert column(spark, rows, T.location_category(F.col("c0"))) == ["de", "foreign", "remote", "foreign", "de", "foreign", "foreign"]


def test_block_pages(spark):
    assert column(spark, [("Please verify you are HUMAN",), ("a job",), (None,)], T.looks_blocked(F.col("c0"))) == [True, False, False]


def test_dates(spark):
    rows = [("2024-01-05T10:00:00Z",), ("2024-01-05T10:00:00.123456+02:00",), ("nonsense",), ("",), (None,), ("2024-01-05",)]
    got = [str(x) for x in column(spark, rows, V.iso_timestamp(F.col("c0")).cast("string"))]
    assert got == ["2024-01-05 10:00:00", "2024-01-05 10:00:00.123456", "None", "None", "None", "2024-01-05 00:00:00"]


def test_anchor(spark):
    df = spark.sql("SELECT timestamp'2024-01-31 05:00:00' AS a, timestamp'2024-01-31 07:00:00' AS b")
    assert [str(x) for x in df.select(V.anchor(F.col("a"), 6).cast("string"), V.anchor(F.col("b"), 6).cast("string")).first()] == ["2024-01-30 06:00:00", "2024-01-31 06:00:00"]


def test_geocode_and_distance(spark):
    assert V.geocode(" Berlin ") == V.CITIES["berlin"] and V.geocode("Berlin-Mitte") == V.CITIES["berlin"] and V.geocode("qqq") is None
    b, h = V.CITIES["berlin"], V.CITIES["hamburg"]
    km = spark.range(1).select(V.haversine_km(*[F.lit(x) for x in (*b, *h)])).first()[0]
    assert 250 < km < 260


def test_counter(spark):
    assert column(spark, [('{"a": 3}',), ('{"b": 1}',), (None,), ("{",)], V.counter(F.col("c0"), "a")) == [3, 0, 0, 0]

import gzip
import hashlib
import zlib
from collections import Counter

from tidewell.llm import warc


def expected(rows):
    """Of equal large payloads the largest page_id (null the least) is the response."""
    out, groups = [], {}
    for page_id, html in rows:
        body = (html or "").encode()
        groups.setdefault(body, []).append(page_id)
    for body, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0))
        for n, i in enumerate(ids):
            revisit = len(body) >= 1000 and n < len(ids) - 1
            out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", ids[-1] if revisit else None))
    return Counter(out)


def test_odd_pages(spark):
    big, other = "<p>é\r\n\r\nWARC/1.1\r\n\r\n" + "x" * 2000, "HTTP/1.1 200 OK\n" * 90
    rows = [(1, big), (2, big), (5, big), (5, big), (3, None), (4, ""), (6, "short"), (7, "short"), (None, big), (8, other), (9, other + " "), (10, other), (11, "\n" * 1500), (12, "\n" * 1500), (13, "y" * 3_000_000)]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://h/{i} a b", h, 1, "d") for i, h in rows], "page_id long, url string, html string, chunk int, digest string")
    got = warc.query(pages).collect()
    assert all(r.intact for r in got)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected(rows)
    assert warc.query(pages.limit(0)).collect() == []


def test_both_versions_and_compression():
    for version in (1, 2):
        records = [("http://a.example/x y", "20010203040506", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\nmore\n"), ("dns:a", "20010203040507", b""), ("http://b/", "20010203", b"no head")]
        raw = warc.arc_version_block(version, "f.arc", "20010203040506") + b"".join(warc.arc_record(version, u, d, c, 7, "f.arc") for u, d, c in records)
        single = warc.arc_version_block(version, "f.arc", "20010203040506")
        members = gzip.compress(single) + b"".join(gzip.compress(warc.arc_record(version, u, d, c, 7, "f.arc")) for u, d, c in records)
        for form in (raw, gzip.compress(raw), members):
            got = [(h["url"], h["date"], c) for h, c in warc.parse_arc(form)]
            assert got == records
    assert warc.split_http(records[0][2]) == (b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n", b"body\nmore\n")


def test_bytes_survive(spark, tmp_path, monkeypatch):
    """Latin-1, all byte values, payloads over 16 MB and several archives: what the ARC files hold is in the WARC files, each record a gzip member."""
    monkeypatch.setattr(warc, "ARC_BYTES", 100_000)
    every = bytes(range(256)) * 9
    rows = [(1, "http://a/é", "Grüße ".encode("latin-1") * 300), (2, "http://b/", every), (3, "http://c/", every), (4, "http://d/", b"\0" * (17 << 20)), (5, "http://e/", b"HTTP/1.1 200 OK\r\n\r\nx\0\0"), (6, None, every[:20])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html binary")
    arcs, out = str(tmp_path / "arcs"), str(tmp_path / "warcs")
    warc.write_arc(pages.repartition(3), arcs)
    dns = warc.arc_version_block(1, "f", "20010203") + b"dns:a.example 192.0.2.1 20010203040506 text/dns 12\nanswer \xe9\xff...\n"
    (tmp_path / "arcs" / "dns.arc").write_bytes(dns)
    warc.to_warc(spark, arcs, out)
    raw = [r.content for r in warc.files(spark, out).collect()]
    found = [x for one in raw for x in warc.parse_warc(one)]
    blocks = {h["warc-target-uri"]: b for h, b in found if h["warc-type"] != "warcinfo"}
    assert {u or "about:blank": h for _, u, h in rows if u != "http://b/"} == {u: warc.split_http(b)[1] for u, b in blocks.items() if u not in ("http://b/", "dns:a.example")}
    assert [(h["warc-type"], h["content-type"], h["warc-ip-address"], b) for h, b in found if h.get("warc-target-uri") == "dns:a.example"] == [("resource", "text/dns", "192.0.2.1", b"answer \xe9\xff...")]
    got = {r.page_id: r for r in warc.read_warc(warc.files(spark, out)).collect()}
    assert all(r.intact for r in got.values()) and (got[2].record_type, got[2].refers_to) == ("revisit", 3)
    assert {i: r.payload_digest for i, r in got.items() if i} == {i: hashlib.sha1(h).hexdigest() for i, _, h in rows}
    # Every member alone is a whole record.
    members = 0
    for one in raw:
        while one:
            z = zlib.decompressobj(31)
            record = z.decompress(one)
            assert z.eof and (not record or record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n"))
            members, one = members + bool(record), z.unused_data
    assert members == len(found)


def test_damage_is_told():
    raw = warc.arc_version_block(1, "f", "2001") + warc.arc_record(1, "http://a/", "2001", b"x" * 10, 0, "f")
    for bad in (raw[:-5], raw.replace(b"1 0 legacy", b"9 0 legacy")):
        try:
            list(warc.parse_arc(bad))
        except ValueError:
            continue
        raise AssertionError("damaged archives must not be read")

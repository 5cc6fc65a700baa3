import base64
import gzip
import hashlib

import pytest

from readloom.llm import queries, warc


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_versions_and_lengths():
    docs = [("http://a/ b", "20200102030405", "text/html", b"HTTP/1.1 200 OK\r\n\r\nline\n\nhttp://x 1 2 3 4\n"), ("http://c", "20200102030406", "text/plain", b"")]
    docs = [(warc.arc_url(u), d, m, b) for u, d, m, b in docs]
    for version in (1, 2):
        got = list(warc.parse_arc(warc.arc_member(version, docs, "f.arc")))
        assert [(h["URL"], h["Archive-date"], h["Content-type"], b) for h, b in got] == docs
        assert len(got[0][0]) == len(warc.ARC_FIELDS[version])
    bare = b"http://a 1.2.3.4 20200101000000 text/html 3\nabc\n"
    assert [b for _, b in warc.parse_arc(bare)] == [b"abc"]
    for bad in (b"no header\n", bare[:-3], bare.replace(b" 3\n", b" 2\n")):
        with pytest.raises(ValueError):
            list(warc.parse_arc(bad))


def verify(rows, pages):
    first = {}
    for i, html in pages:
        b = (html or "").encode()
        first[b] = min(first.get(b, i), i)
    assert len(rows) == len(pages)
    by = dict(pages)
    for r in rows:
        b = (by[r["page_id"]] or "").encode()
        assert (r["payload_bytes"], r["payload_digest"], r["intact"]) == (len(b), sha(b), True)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[b] == r["page_id"] else ("revisit", first[b]))


def test_query(spark, sf):
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    verify(queries.op9_warc(spark, sf).collect(), pages)


def test_odd_pages_and_empty_tables(spark, tmp_path):
    html = ["<p>same</p>", "<p>same</p>", None, "", "x\r\n\r\nWARC/1.0\r\n\r\n", "\u00e9" * 50_000, "<p>same</p>"]
    pages = [(i + 10, f"http://h/{i} \n\x01" if i else None, h, "clash", "clash") for i, h in enumerate(html)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string, digest string, payload string").repartition(3)
    verify(warc.convert(d).collect(), [(p[0], p[2]) for p in pages])
    again = d.unionByName(d.where("page_id = 10")).unionByName(spark.createDataFrame([(None, None, "<p>same</p>", "", "")], d.schema))
    rows = warc.convert(again, path=str(tmp_path / "w")).collect()
    assert sorted((r["page_id"] or -1, r["record_type"]) for r in rows if r["payload_bytes"] == 11) == [(-1, "revisit"), (10, "response"), (10, "response"), (11, "revisit"), (16, "revisit")]
    assert list((tmp_path / "w").glob("*.gz"))
    assert warc.convert(d.limit(0)).count() == 0


def test_small_payloads_may_all_be_responses(spark):
    d = spark.createDataFrame([(1, "http://a", "aa"), (2, "http://b", "aa"), (3, "http://c", "a" * 30), (4, "http://d", "a" * 30)], "page_id long, url string, html string")
    assert {r["page_id"]: r["refers_to"] for r in warc.convert(d, min_bytes=10).collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_archives_of_others(spark, tmp_path):
    """Addresses, documents that aren't http, headers without carriage returns, and stretches that can't be read."""
    def record(url, doc, ip="10.1.2.3", length=None):
        return f"{url} {ip} 20010203040506 text/html {len(doc) if length is None else length}\n".encode() + doc + b"\n"

    body = b"HTTP/1.0 200 OK\nX-Page-Id: 7\n\nbody"
    data = record("http://a", body) + record("dns:a", b"a. 60 IN A 10.1.2.3") + b"garbage \xff line\nmore\n" + record("http://b", b"HTTP/1.0 200 OK\r\nX-Page-Id: 3\r\n\r\nbody") + record("http://c", b"lost", length=999)
    with pytest.raises(ValueError):
        list(warc.parse_arc(data))
    arcs = spark.createDataFrame([(bytearray(gzip.compress(data)),), (bytearray(b""),), (bytearray(b"cut"),)], "data binary")
    back, bad = warc.to_warc(arcs, str(tmp_path / "w"))
    rows = sorted((r["record_type"], r["page_id"], r["payload_bytes"], r["refers_to"], r["payload_digest"], r["intact"]) for r in back.collect())
    assert rows == [("resource", None, 19, None, sha(b"a. 60 IN A 10.1.2.3"), True), ("response", 3, 4, None, sha(b"body"), True), ("revisit", 7, 4, 3, sha(b"body"), True)]
    assert sorted(bytes(r["payload"]) for r in bad.collect()) == [b"cut", b"garbage \xff line\nmore\n", record("http://c", b"lost", length=999)]
    heads = [h for f in (tmp_path / "w").glob("*.gz") for h, _ in warc.parse_warc(gzip.decompress(f.read_bytes()))]
    assert {h["WARC-IP-Address"] for h in heads} == {"10.1.2.3"}
    revisit = next(h for h in heads if h["WARC-Type"] == "revisit")
    assert (revisit["WARC-Refers-To-Target-URI"], revisit["WARC-Refers-To-Date"]) == ("http://b", "2001-02-03T04:05:06Z")


def test_files_are_bounded_by_bytes(spark, tmp_path):
    d = spark.createDataFrame([(i, f"http://h/{i}", f"{i} " * 3000) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    warc.convert(d, str(tmp_path / "w"), file_bytes=30_000)
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "w").glob("*.gz")]
    assert len(sizes) > 10 and max(sizes) < 45_000

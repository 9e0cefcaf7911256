"""Conversions hold the text that a reader sees."""

from __future__ import annotations

import gzip
import hashlib
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from tabmeld.llm import warc


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>&copy; 2024 A &middot; B</p>", "\u00a9 2024 A \u00b7 B"),
        ("&#169;&#xA9;&#XA9;&copy2", "\u00a9\u00a9\u00a9\u00a92"),
        ("&amp;copy; &amp;amp; &amp;#38;", "&copy; &amp; &#38;"),
        ("a &lt;b&gt; c &quot;d&quot; &#39;e&#39;&nbsp;f", "a <b> c \"d\" 'e' f"),
        ("&hellip;&mdash;&euro;&#128512;&NotEqualTilde;", "\u2026\u2014\u20ac\U0001f600\u2242\u0338"),
        ("AT&T & co &; &unknown; &#; 1&2", "AT&T & co &; &unknown; &#; 1&2"),
        ("x&#10;y&#9;z", "x y z"),
        (None, None),
    ],
)
def test_character_references_are_decoded(ready, page, text):
    pages = ready.createDataFrame([(page,)], "html string")
    assert pages.select(warc.plain_text(F.col("html"))).first()[0] == text


def test_every_name_is_decoded(ready):
    names = sorted(name for name in html5 if name.endswith(";") and not html5[name].isspace())
    pages = ready.createDataFrame([(name, f"<p>a&{name}b</p>") for name in names], "name string, html string")
    rows = pages.select("name", warc.plain_text(F.col("html")).alias("text")).collect()
    assert {r.name: r.text for r in rows} == {name: f"a{html5[name]}b" for name in names}


def test_no_given_page_keeps_a_reference(ready):
    pages = ready.read.parquet("/root/testdata/sf0.001/pages.parquet")
    made = warc.derive(warc.responses(pages, "url", "html", "page_id")).where("record_type = 'conversion'")
    assert made.count() == pages.count() and made.where(F.col("block").rlike("&(copy|middot);")).count() == 0


def test_files_to_derivatives(ready, tmp_path):
    """Responses read from a file keep all their headers in the metadata record."""
    body = "<p>caf\u00e9 &copy;</p>".encode("latin-1")
    http = (
        b"HTTP/1.1 404 Not Found\r\nDate: Mon, 01 Jan 2024 00:00:00 GMT\r\nServer: some\r\n thing\r\n"
        b"content-type:text/html; charset=ISO-8859-1\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nContent-Length: 7\r\n"
        b"Last-Modified: Sun, 31 Dec 2023 00:00:00 GMT\r\n\r\n"
    )

    def record(kind: str, number: int, content_type: str, block: bytes, *more: str) -> bytes:
        lines = [
            "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{number}>", "WARC-Date: 2024-01-01T00:00:00Z",
            f"Content-Type: {content_type}", *more, f"Content-Length: {len(block)}",
        ]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    data = record("warcinfo", 1, "application/warc-fields", b"software: x\r\n", "WARC-Filename: f.warc.gz")
    data += record("response", 2, "application/http; msgtype=response", http + body, "WARC-Target-URI: http://a/", "WARC-IP-Address: 10.0.0.1")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(data))
    records = warc.read_records(ready, str(tmp_path))
    info, response = sorted(records.collect(), key=lambda r: r.record_id)
    assert ("WARC-Filename", "f.warc.gz") in [tuple(f) for f in info.fields] and info.payload is None
    assert (response.warc_date, response.content_type) == ("2024-01-01T00:00:00Z", "application/http; msgtype=response")
    assert ("WARC-IP-Address", "10.0.0.1") in [tuple(f) for f in response.fields]
    assert response.http_headers.encode("latin-1") == http and bytes(response.payload) == body
    made = {r.record_type: r for r in warc.derive(warc.read_responses(records)).collect()}
    assert made["conversion"].block == "caf\u00e9 \u00a9"
    assert {(r.target_uri, r.warc_date, r.refers_to) for r in made.values()} == {("http://a/", "2024-01-01T00:00:00Z", "<urn:uuid:2>")}
    lines = made["metadata"].block.split("\r\n")
    assert lines[:-2] == [
        "source-payload-digest: sha256:" + hashlib.sha256(body).hexdigest(),
        "source-block-digest: sha256:" + hashlib.sha256(http + body).hexdigest(),
        f"source-payload-length: {len(body)}",
        "source-http-status: 404",
        "source-content-type: text/html; charset=ISO-8859-1",
        "source-header: Date: Mon, 01 Jan 2024 00:00:00 GMT",
        "source-header: Server: some thing",
        "source-header: Set-Cookie: a=1",
        "source-header: Set-Cookie: b=2",
        "source-header: Content-Length: 7",
        "source-header: Last-Modified: Sun, 31 Dec 2023 00:00:00 GMT",
    ]


def test_regions_that_never_end(ready):
    """Unclosed regions stay, and cost one look for their end."""
    import time

    began = time.process_time()
    assert warc._visible("<!-- a <script> b <p>c</p>") == "<!-- a  b\nc"
    assert warc._visible("<script>x</script >y<!--z-->w<STYLE>v</style>") == "y w"
    for kind in ("<!-- ", "<script ", "<style>", "<head ", "<", "< b> ", "&#", " \n "):
        warc._visible(kind * 40_000)
    assert time.process_time() - began < 5


def test_broken_records_get_a_status(ready, tmp_path):
    def record(head: str, block: str = "abc") -> bytes:
        return f"{head}\r\n\r\n{block}\r\n\r\n".encode()

    good = "WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:{}>\r\nContent-Length: 3"
    cases = {
        "length": record(good.format(1)) + record("WARC/1.1\r\nWARC-Type: resource") + record(good.format(2)),
        "bad_length": record("WARC/1.0\r\nContent-Length: x3") + record(good.format(3)),
        "version": b"nothing\r\n\r\nmore\r\n\r\n" + record(good.format(4)),
        "header": record(good.format(5)) + b"WARC/1.1\r\nContent-Len",
        "block": record(good.format(6)) + b"WARC/1.1\r\nContent-Length: 99\r\n\r\nabc",
        "empty": b"",
    }
    for name, data in cases.items():
        (tmp_path / f"{name}.warc").write_bytes(data)
    whole = gzip.compress(record(good.format(7)))
    (tmp_path / "cut.warc.gz").write_bytes(whole + gzip.compress(record(good.format(8)))[:10])
    (tmp_path / "junk.warc.gz").write_bytes(whole + b"junk")
    rows = warc.read_records(ready, str(tmp_path)).collect()
    sound = sorted(r.record_id for r in rows if r.status == "ok" and r.block == "abc" and r.content_length == 3)
    assert sound == sorted(["<urn:1>", "<urn:2>", "<urn:3>", "<urn:4>", "<urn:5>", "<urn:6>", "<urn:7>", "<urn:7>"])
    broken = sorted(r.status for r in rows if r.status != "ok")
    assert broken == sorted(["no content length", "no content length", "no version line", "header cut short", "block cut short",
                             "gzip member cut short", "not gzip after a member"])
    assert warc.read_responses(warc.read_records(ready, str(tmp_path))).count() == 0


def test_records_equal_plain_python(ready):
    """Whole records of the given pages, from their definition."""
    pages = ready.read.parquet("/root/testdata/sf0.001/pages.parquet")
    made = {(r.page_id, r.record_type): r for r in warc.derive(warc.responses(pages, "url", "html", "page_id")).collect()}
    sha = lambda text: "sha256:" + hashlib.sha256(text.encode()).hexdigest()

    def urn(*parts: str) -> str:
        h = hashlib.md5("\n".join(parts).encode()).hexdigest()
        return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"

    given = pages.collect()
    assert len(made) == 2 * len(given)
    for page in given:
        html, url = page.html or "", page.url or ""
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html.encode())}\r\n\r\n"
        source = urn("response", str(page.page_id), url, html)
        text, fields = made[page.page_id, "conversion"], made[page.page_id, "metadata"]
        assert fields.block == (
            f"source-payload-digest: {sha(html)}\r\nsource-block-digest: {sha(head + html)}\r\n"
            f"source-payload-length: {len(html.encode())}\r\nsource-http-status: 200\r\n"
            f"source-content-type: text/html; charset=utf-8\r\ntext-digest: {sha(text.block)}\r\n"
        )
        for row, kind in ((text, "text/plain"), (fields, "application/warc-fields")):
            assert (row.refers_to, row.target_uri, row.content_type) == (source, url, kind)
            assert (row.content_length, row.block_digest) == (len(row.block.encode()), sha(row.block))
            assert row.record_id == urn(row.record_type, source, row.block)

"""Derivative records of web archives: metadata and plain-text conversions of responses.

Every response record gives one ``metadata`` record about it and one ``conversion`` record with
its plain text. Both refer to the response by its record id and keep its URI and date; the
metadata block names the source's headers and digests. Record ids are derived from the source
id and the block, so reruns agree. All steps but the decoding of character references are column
expressions.
"""

from __future__ import annotations

import html as html_names
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "WARC/1.1"
TEXT_TYPE = "text/plain"
FIELDS_TYPE = "application/warc-fields"

BLOCK_TAGS = re.compile(
    r"</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|article|section|nav|header|footer|main|aside"
    r"|blockquote|pre|form|body|html)\b[^<>]*>",
    re.ASCII | re.IGNORECASE,
)
ANY_TAG = re.compile(r"<[a-zA-Z/!][^<>]*>")
BLANKS = re.compile(r"[ \t\r\n\f]+")
# Regions without visible text begin with these; a region that never ends is none.
REGION = re.compile(r"<!--|<(?:script|style|head)\b", re.ASCII | re.IGNORECASE)
REGION_END = {
    begin: re.compile(end, re.ASCII | re.IGNORECASE)
    for begin, end in (("<!--", "-->"), *((f"<{name}", rf"</{name}\s*>") for name in ("script", "style", "head")))
}


def digest(content: Column) -> Column:
    """Labelled SHA-256 of the UTF-8 bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def record_id(*parts: Column) -> Column:
    """A urn:uuid from the MD5 of the parts."""
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    pieces = [F.substring(h, begin, size) for begin, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,31};?)")


@lru_cache(1 << 14)
def _referred(reference: str) -> str:
    value = html_names.unescape(reference)
    return " " if value in ("\t", "\n", "\f", "\r", "\xa0") else value


def _without_regions(html: str) -> str:
    """The page with a blank for each hidden region, in one pass over it.

    Once no end of a kind is left, all further beginnings of that kind are passed over.
    """
    kept, at, seek, endless = [], 0, 0, set()
    while found := REGION.search(html, seek):
        kind = found[0].lower()
        end = None if kind in endless else REGION_END[kind].search(html, found.end())
        if end:
            kept += [html[at : found.start()], " "]
            at = seek = end.end()
        else:
            endless.add(kind)
            seek = found.start() + 1
    return "".join([*kept, html[at:]])


def _visible(html: str) -> str:
    text = BLANKS.sub(" ", _without_regions(html))
    text = ANY_TAG.sub("", BLOCK_TAGS.sub("\n", text))
    # All references once, from left to right; those of blanks give a blank.
    text = _REFERENCE.sub(lambda found: _referred(found[0]), text)
    lines = (line.strip(" ") for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def plain_text(html: Column) -> Column:
    """Visible text of a page: one line per block, blanks squeezed, no empty lines, all named and
    numeric character references of HTML decoded. Its work grows with a page's length, whatever it holds."""

    def visible(pages: pd.Series) -> pd.Series:
        return pages.map(_visible, na_action="ignore")

    return F.pandas_udf(visible, T.StringType())(html)


def responses(pages: DataFrame, uri: str, payload: str, identity: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages: the HTTP header block and the page as payload.

    A null URI or page counts as empty text.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    target = F.coalesce(F.col(uri), F.lit(""))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return pages.select(
        F.col(identity).alias("page_id"),
        record_id(F.lit("response"), F.col(identity), target, body).alias("record_id"),
        target.alias("target_uri"),
        F.lit(date).alias("warc_date"),
        http.alias("http_headers"),
        body.alias("payload"),
        digest(body).alias("payload_digest"),
    ).withColumn("block_digest", digest(F.concat("http_headers", "payload")))


def _as_text(payloads: pd.Series, headers: pd.Series) -> pd.Series:
    """Payload bytes as text, by the charset that the headers name, else as UTF-8."""
    def text(payload: bytes | None, header: str | None) -> str | None:
        named = re.search(r"(?im)^content-type:[^\r\n]*charset=[\"']?([A-Za-z0-9._:-]+)", header or "")
        try:
            return None if payload is None else payload.decode(named[1] if named else "utf-8", "replace")
        except (LookupError, UnicodeError):
            return payload.decode("utf-8", "replace")

    return pd.Series([text(*pair) for pair in zip(payloads, headers, strict=True)], dtype=object)


def _other_headers(http: Column, content_type: Column, length: Column) -> Column:
    """A field for every header line that no other field repeats, in their order; folded lines as one."""
    lines = F.split(F.regexp_replace(http, r"\r?\n[ \t]+", " "), r"\r?\n")

    def told(line: Column) -> Column:
        name = F.lower(F.trim(F.substring_index(line, ":", 1)))
        value = F.trim(F.regexp_replace(line, r"^[^:]*:", ""))
        return ((name == "content-type") & (value == content_type)) | ((name == "content-length") & (value == length))

    kept = F.filter(lines, lambda line, at: (at > 0) & (F.trim(line) != "") & ~told(line))
    return F.array_join(F.transform(kept, lambda line: F.concat(F.lit("\r\nsource-header: "), line)), "")


def derive(source: DataFrame) -> DataFrame:
    """Two records per response: page_id, record_type, the WARC headers as columns, and ``block``.

    The metadata block has a ``source-header`` field for each header line of the response but
    Content-Type, and Content-Length where it is the payload's, which have fields of their own.
    ``payload`` is text or bytes; transfer and content codings of bytes are not undone. Pages
    without visible text give an empty conversion record. Repeated responses give equal records;
    an empty table gives an empty table. Long pages take work in proportion to their length.
    """
    payload = F.col("payload")
    if isinstance(source.schema["payload"].dataType, T.BinaryType):
        payload = F.pandas_udf(_as_text, T.StringType())("payload", "http_headers")
    text = source.withColumn("_text", plain_text(payload))
    length = F.octet_length("payload").cast("string")
    content_type = F.trim(F.regexp_extract("http_headers", r"(?im)^content-type:([^\r\n]*)", 1))
    fields = F.concat(
        F.lit("source-payload-digest: "), F.col("payload_digest"),
        F.lit("\r\nsource-block-digest: "), F.col("block_digest"),
        F.lit("\r\nsource-payload-length: "), length,
        F.lit("\r\nsource-http-status: "), F.regexp_extract("http_headers", r"^HTTP/[0-9.]+ ([0-9]+)", 1),
        F.lit("\r\nsource-content-type: "), content_type,
        _other_headers(F.col("http_headers"), content_type, length),
        F.lit("\r\ntext-digest: "), digest(F.col("_text")),
        F.lit("\r\n"),
    )
    both = text.select(
        "page_id", "record_id", "target_uri", "warc_date",
        F.explode(
            F.array(
                F.struct(F.lit("metadata").alias("type"), F.lit(FIELDS_TYPE).alias("content"), fields.alias("block")),
                F.struct(F.lit("conversion").alias("type"), F.lit(TEXT_TYPE).alias("content"), F.col("_text").alias("block")),
            )
        ).alias("made"),
    )
    return both.select(
        "page_id",
        F.col("made.type").alias("record_type"),
        record_id(F.col("made.type"), F.col("record_id"), F.col("made.block")).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        F.col("made.content").alias("content_type"),
        F.octet_length("made.block").cast("long").alias("content_length"),
        digest(F.col("made.block")).alias("block_digest"),
        F.col("made.block").alias("block"),
    )


def _header_value(column: str) -> Column:
    """A header has one line: line breaks inside a value would end it."""
    return F.regexp_replace(F.col(column), r"[\r\n]+", " ")


def record_text(records: DataFrame) -> DataFrame:
    """Column ``value``: each record as it stands in a file, without the two line breaks that end it."""
    headers = (
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"),
        ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"),
        ("Content-Type", "content_type"),
    )
    lines = [part for name, column in headers for part in (F.lit(f"\r\n{name}: "), _header_value(column))]
    return records.select(
        F.concat(
            F.lit(VERSION), *lines, F.lit("\r\nContent-Length: "), F.col("content_length").cast("string"),
            F.lit("\r\n\r\n"), F.col("block"),
        ).alias("value")
    )


def write_records(records: DataFrame, path: str) -> None:
    """Gzipped WARC files, one per task."""
    record_text(records).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


# Columns of a record read from a file, by the header that each one holds.
_NAMED = {
    "record_type": "warc-type", "record_id": "warc-record-id", "refers_to": "warc-refers-to",
    "target_uri": "warc-target-uri", "warc_date": "warc-date", "block_digest": "warc-block-digest",
    "payload_digest": "warc-payload-digest", "content_type": "content-type",
}


def _fields(lines: list[str]) -> list[tuple[str, str]]:
    """(name, value) of header lines; a line that begins with a blank goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        else:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def _unzipped(content: bytes) -> tuple[bytes, str | None]:
    """Bytes of all gzip members, as far as they are sound, and what is wrong with the rest."""
    out = []
    while content:
        if content[:2] != b"\x1f\x8b":
            if out and not content.strip(b"\0"):  # padding
                break
            return b"".join(out) + (b"" if out else content), "not gzip after a member" if out else None
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(content))
        except zlib.error as error:
            return b"".join(out), str(error)
        if not member.eof:
            return b"".join(out), "gzip member cut short"
        content = member.unused_data
    return b"".join(out), None


def _record(data: bytes, at: int) -> tuple[list, int]:
    """One row, and where the next record begins."""
    end = data.find(b"\r\n\r\n", at)
    stop, status, fields = len(data), None, []
    if not data.startswith(b"WARC/", at):
        status = "no version line"
    elif end < 0:
        status = "header cut short"
    else:
        fields = _fields(data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
    named = {name.lower(): value for name, value in reversed(fields)}
    length = named.get("content-length", "")
    if status is None and not (length.isascii() and length.isdigit()):
        status = "no content length"
    begin = end + 4
    if status is None:
        stop = begin + int(length)
        status = "ok" if stop <= len(data) else "block cut short"
    if status in ("no version line", "no content length"):
        # The next record is the next one that shows itself.
        found = data.find(b"\r\n\r\nWARC/", at + 1)
        stop = found if found >= 0 else len(data)
    pairs = [{"name": name, "value": value} for name, value in fields]
    held = [named.get(name) for name in _NAMED.values()]
    if status != "ok":
        return [*held, None, pairs, None, None, None, status], stop + 4
    block, http, payload = data[begin:stop], None, None
    if named.get("content-type", "").lower().startswith("application/http"):
        border = re.search(rb"\r?\n\r?\n", block)
        cut = border.end() if border else len(block)
        http, payload = block[:cut].decode("latin-1"), block[cut:]
    return [*held, stop - begin, pairs, http, payload, block.decode("utf-8", "replace"), status], stop + 4


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [*_NAMED, "content_length", "fields", "http_headers", "payload", "block", "status"]
    for batch in batches:
        for content in batch["content"]:
            data, wrong = _unzipped(content)
            rows, at = [], 0
            while at < len(data):
                row, at = _record(data, at)
                rows.append(row)
            if wrong:
                rows.append([None] * (len(columns) - 1) + [wrong])
            yield pd.DataFrame(rows, columns=columns).astype({"content_length": "Int64"})


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, gzipped or not, cut by their Content-Length. Each file is held by one task.

    ``fields`` has all header lines as (name, value), and the named ones are columns too. Of HTTP
    messages, ``http_headers`` ends with the empty line and ``payload`` holds the bytes after it;
    they are null for other records. ``block`` is the block as UTF-8 text. ``status`` is "ok", or says
    why a record could not be read: such a row has no block, and reading goes on with the next
    record that begins after an empty line. A damaged gzip member ends its file with such a row.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(
        _parse,
        ", ".join(f"{name} string" for name in _NAMED)
        + ", content_length long, fields array<struct<name string, value string>>"
        ", http_headers string, payload binary, block string, status string",
    )


def read_responses(records: DataFrame) -> DataFrame:
    """The responses among records read from files, as ``derive`` takes them; the record id is the page_id.

    A digest that the file does not give is taken from the bytes.
    """
    head = F.encode("http_headers", "ISO-8859-1")
    return records.where((F.col("record_type") == "response") & F.col("payload").isNotNull()).select(
        F.col("record_id").alias("page_id"),
        "record_id",
        F.coalesce("target_uri", F.lit("")).alias("target_uri"),
        "warc_date",
        "http_headers",
        "payload",
        F.coalesce("payload_digest", digest(F.col("payload"))).alias("payload_digest"),
        F.coalesce("block_digest", digest(F.concat(head, F.col("payload")))).alias("block_digest"),
    )

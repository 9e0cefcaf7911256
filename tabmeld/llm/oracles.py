"""Equivalent SQL of the queries that SQL can express."""

from __future__ import annotations

from html.entities import html5


def _crc_steps(value: int, steps: int) -> int:
    """So many steps of the reflected CRC-32 division."""
    for _ in range(steps):
        value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
    return value


# CRC-32 goes over half bytes, the low one of each byte first.
_CRC_TABLE = ", ".join(f"{_crc_steps(half, 4)}::UBIGINT" for half in range(16))

SHARDING = f"""
WITH halves AS (
  SELECT doc_id, md5(coalesce(text, '')) AS digest, coalesce(octet_length(encode(text)), 0) AS bytes,
    list_transform(list_filter(string_split(regexp_replace(lower(hex(encode(coalesce(text, '')))), '(.)(.)', '\\2\\1', 'g'), ''),
      lambda digit: digit <> ''), lambda digit: (instr('0123456789abcdef', digit) - 1)::UBIGINT) AS half
  FROM documents
), crcs AS (
  SELECT doc_id, digest, (bytes + 8)::BIGINT AS size,
    xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, half),
      lambda c, h: xor(c >> 4, [{_CRC_TABLE}][((xor(c, h) & 15) + 1)::BIGINT])))::BIGINT AS text_crc32
  FROM halves
), summed AS (
  SELECT *, coalesce(sum(size) OVER place, 0) AS before_bytes, sum(size) OVER () AS total, count(*) OVER place AS rank
  FROM crcs WINDOW place AS (ORDER BY digest, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), grouped AS (
  SELECT *, CASE WHEN sum(size) OVER same * 96 <= total THEN min(before_bytes) OVER same ELSE before_bytes END AS start
  FROM summed WINDOW same AS (PARTITION BY digest)
), placed AS (
  SELECT *, least(23, (start * 24) // total)::INT AS shard FROM grouped
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (rank - min(rank) OVER (PARTITION BY shard))::BIGINT AS slot,
  NULL::INT AS grown_shard
FROM placed
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _record_id(*parts: str) -> str:
    h = f"md5(concat_ws(chr(10), {', '.join(parts)}))"
    pieces = " || '-' || ".join(f"substr({h}, {begin}, {size})" for begin, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || {pieces} || '>'"


# The page's markup in RE2, stated apart from the operator's own scan.
_REGIONS = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>"
_BLOCKS = (
    r"(?i)</?(?:p|div|br|hr|li|[uod]l|d[td]|h[1-6]|t[rdh]|table|article|section|nav|header|footer|main|aside"
    r"|blockquote|pre|form|body|html)\b[^<>]*>"
)
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,31};?)"

# HTML's names as rows; those that may stand without a semicolon are also prefixes of longer words.
_NAMES = ", ".join(f"({_quoted(name)}, {_quoted(value)})" for name, value in sorted(html5.items()))
# Numbers that stand for Windows-1252 bytes; the five that it leaves open stand for themselves.
_BYTES = ", ".join(f"({byte}, {ord(bytes([byte]).decode('cp1252', 'ignore') or chr(byte))})" for byte in range(0x80, 0xA0))


def _replaced(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {_quoted(pattern)}, {by}, 'g')"


def _tagless(html: str) -> str:
    text = _replaced(html, _REGIONS, "' '")
    text = _replaced(text, r"[ \t\r\n\f]+", "' '")
    text = _replaced(text, _BLOCKS, "chr(10)")
    return _replaced(text, r"<[a-zA-Z/!][^<>]*>", "''")


def _digest(text: str) -> str:
    return f"'sha256:' || sha256({text})"


_CRLF = "chr(13) || chr(10)"

WARC = f"""
WITH source AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages
), responses AS (
  SELECT *, {_record_id("'response'", "coalesce(page_id::VARCHAR, '')", 'target_uri', 'payload')} AS source_id,
    'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF} || 'Content-Length: '
      || octet_length(encode(payload)) || {_CRLF} || {_CRLF} AS http
  FROM source
), tagless AS (
  SELECT DISTINCT payload, {_tagless('payload')} AS text FROM source
), parts AS (
  SELECT payload, unnest(string_split_regex(text, {_quoted(_REFERENCE)})) AS before,
    generate_subscripts(string_split_regex(text, {_quoted(_REFERENCE)}), 1) AS place,
    regexp_extract_all(text, {_quoted(_REFERENCE)}) AS refs
  FROM tagless
), placed AS (
  SELECT payload, place, before, refs[place] AS ref FROM parts
), names(name, value) AS (VALUES {_NAMES}
), old_bytes(code, value) AS (VALUES {_BYTES}
), refs AS (
  SELECT DISTINCT ref, CASE WHEN ref[2] = '#' THEN coalesce(TRY_CAST(CASE WHEN lower(ref[3]) = 'x'
    THEN '0x' || rtrim(substr(ref, 4), ';') ELSE rtrim(substr(ref, 3), ';') END AS BIGINT), 1114112) END AS code
  FROM placed WHERE ref IS NOT NULL
), numbers AS (
  SELECT ref, CASE
    WHEN code IN (9, 10, 12, 13, 160) THEN ' '
    WHEN old_bytes.value IS NOT NULL THEN chr(old_bytes.value::INT)
    WHEN code = 0 OR code BETWEEN 55296 AND 57343 OR code > 1114111 THEN chr(65533)
    WHEN code < 32 OR code = 127 OR code BETWEEN 64976 AND 65007 OR code & 65534 = 65534 THEN ''
    ELSE chr(code::INT) END AS value
  FROM refs LEFT JOIN old_bytes USING (code) WHERE code IS NOT NULL
), begins AS (
  SELECT ref, unnest(range(2, len(ref))) AS size FROM refs WHERE code IS NULL
), named AS (
  SELECT ref, arg_max(names.value || substr(ref, size + 2), size) AS value
  FROM begins JOIN names ON names.name = substr(ref, 2, size) GROUP BY ref
), decoded AS (
  SELECT ref, value FROM numbers UNION ALL
  SELECT ref, CASE WHEN value IN (chr(9), chr(10), chr(160)) THEN ' ' ELSE value END FROM named
), plain AS (
  SELECT payload, string_agg(before || coalesce(value, ref, ''), '' ORDER BY place) AS text
  FROM placed LEFT JOIN decoded USING (ref) GROUP BY payload
), converted AS (
  SELECT responses.*, {_replaced(_replaced('plain.text', r" *\n[ \n]*", 'chr(10)'), r"^[ \n]+|[ \n]+$", "''")} AS plain
  FROM responses JOIN plain USING (payload)
), blocks AS (
  SELECT page_id, target_uri, source_id, 'conversion' AS record_type, 'text/plain' AS content_type, plain AS block FROM converted
  UNION ALL
  SELECT page_id, target_uri, source_id, 'metadata', 'application/warc-fields',
    'source-payload-digest: ' || {_digest('payload')} || {_CRLF}
    || 'source-block-digest: ' || {_digest('http || payload')} || {_CRLF}
    || 'source-payload-length: ' || octet_length(encode(payload)) || {_CRLF}
    || 'source-http-status: 200' || {_CRLF} || 'source-content-type: text/html; charset=utf-8' || {_CRLF}
    || 'text-digest: ' || {_digest('plain')} || {_CRLF}
  FROM converted
)
SELECT page_id, record_type, {_record_id('record_type', 'source_id', 'block')} AS record_id, source_id AS refers_to,
  target_uri, '1970-01-01T00:00:00Z' AS warc_date, content_type, octet_length(encode(block))::BIGINT AS content_length,
  {_digest('block')} AS block_digest, block
FROM blocks
"""

MIXING = """
WITH sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+')) AS size,
    greatest(0.1, 1.0::DOUBLE - 10.0::DOUBLE * CASE WHEN length(text) > 0
      THEN (length(text) - length(translate(text, '#*$%&|<>', '')))::DOUBLE / length(text) ELSE 0 END) AS quality,
    md5(coalesce(text, '')) AS text_md5
  FROM documents
), keyed AS (
  SELECT *, -ln((('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || text_md5), 1, 13))::BIGINT::DOUBLE + 0.5)
    / 4503599627370496.0::DOUBLE) / quality AS key
  FROM sized
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM sources
  WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, weight *
    (SELECT max(level) FROM levels WHERE 3.0::DOUBLE * source_size >= level * weight)) AS target
  FROM levels
), summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, text_md5
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_words
  FROM keyed
), joined AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
  FROM summed s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (epochs + CASE WHEN epochs < 3 AND before_words + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM joined
"""

"""WARC derivatives: linked metadata and plain-text conversion records of responses.

For each response the builder makes a metadata record (title, links, lengths) and a conversion record
(plain text); both carry the response's id in WARC-Refers-To, its target and date, the source headers
that it has, and digests of their own block. Pages are read in Arrow batches by patterns that never go back; ids,
digests and records are SQL expressions. Record ids are derived from content, so a lost task builds the
same ones again.

Plain text: comments, scripts and styles go first, each up to its own end tag (or the end, where that
is missing), then heads that end; a "<" begins a tag only before a letter, "/", "!" or "?", and a ">" inside a
quoted attribute does not end it, however many attributes there are; a tag that never ends takes the rest of the page and
is no link; ends of blocks break lines; character references, by number or by
one of the 252 names of HTML 4, are resolved once, others stay.

Defined cases: null html is an empty body; a null url gives an empty target; line breaks in a url are
escaped, those in a title are spaces; a response without header or date has none in its records;
repeated rows give equal records; extra columns are not carried, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from junctura.llm import blocks

_NAME = r"<[a-zA-Z/!?]"
_REST = r"""(?:[^>=]++|=[ \t\n\f\r]*+(?:"[^"]*+"|'[^']*+')?+)*+(?:>|\Z)"""
_ENDS = "br|hr|/p|/div|/li|/ul|/ol|/h[1-6]|/tr|/table|/nav|/title|/article|/section|/header|/footer|/blockquote|/pre"
#: Each finds its end, or takes the rest of the page, so a page is read once from left to right, whatever is wrong with it.
RAW = re.compile(r"<script\b[^>]*+(?:>|\Z).*?(?:</script[ \t\n\f\r]*+>|\Z)|<style\b[^>]*+(?:>|\Z).*?(?:</style[ \t\n\f\r]*+>|\Z)|<!--.*?(?:-->|\Z)", re.I | re.S | re.A)
BREAK = re.compile(rf"<(?:{_ENDS})\b[^>]*+(?:>|\Z)", re.I | re.A)
TAG = re.compile(_NAME + _REST)
ANCHOR = re.compile(r"<a[ \t\n\f\r/]", re.I | re.A)
HREF = re.compile(r"""[ \t\n\f\r"'/]href[ \t\n\f\r]*+=""", re.I | re.A)
#: Begin and end of what is looked for once at a time.
HEAD = re.compile(r"<head\b[^>]*+>", re.I | re.A), re.compile(r"</head[ \t\n\f\r]*+>", re.I | re.A)
TITLE = re.compile(r"<title\b[^>]*+>", re.I | re.A), re.compile(r"</title", re.I | re.A)
#: In the syntax that both Java and RE2 read. More digits than these, zeros in front aside, are no character.
REFERENCE = r"^(#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});"
#: Code points by name; a no-break space is a space in plain text.
NAMES = name2codepoint | {"nbsp": 32, "apos": 39}


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *parts).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def responses(pages: DataFrame) -> DataFrame:
    """page_id, record_id, target, date, http_header, body of each page as a response record.

    ``pages`` may have the response's own `http_header` and `warc_date`; nothing takes their place.
    """
    url, body = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    given = lambda name: (F.col(name) if name in pages.columns else F.lit(None)).cast("string")
    header = F.regexp_replace(given("http_header"), r"(\r?\n)+\z", "")
    record_id = _uuid(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, F.sha2(body.cast("binary"), 256))
    return pages.select("page_id", record_id.alias("record_id"), url.alias("target"), given("warc_date").alias("date"), header.alias("http_header"), body.alias("body"))


def _between(page: str, marks: tuple[re.Pattern, re.Pattern], at: int) -> tuple[re.Match, re.Match] | None:
    """The next begin from ``at`` on and the first end after it; None where there is no end, so none for any later begin either."""
    begin = marks[0].search(page, at)
    end = begin and marks[1].search(page, begin.end())
    return (begin, end) if end else None


def scanned(body: str) -> tuple[str, str, int]:
    """(visible text, title, number of links) of a page, with its character references as they stand."""
    page = RAW.sub(" ", body)
    tags = (m.group() for m in TAG.finditer(page))
    links = sum(ANCHOR.match(t) is not None and t.endswith(">") and HREF.search(t) is not None for t in tags)
    found = _between(page, TITLE, 0)
    title = page[found[0].end() : found[1].start()] if found else ""
    parts, at = [], 0
    while found := _between(page, HEAD, at):
        parts.append(page[at : found[0].start()])
        at = found[1].end()
    text = " ".join([*parts, page[at:]])
    return TAG.sub(" ", BREAK.sub("\n", text)), title, links


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in blocks.pieces(batch, "body"):
            found = [scanned(body or "") for body in piece.column("body").to_pylist()]
            kept = [c for c in piece.schema.names if c != "body"]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), *columns], [*kept, "visible", "raw_title", "n_links"])


def resolved(parts: Column) -> Column:
    """Text, split at every "&", with its character references resolved, each once; unknown ones stay."""
    codes = F.create_map(*(F.lit(v) for pair in NAMES.items() for v in pair))

    def one(part: Column) -> Column:
        name = F.regexp_extract(part, REFERENCE, 1)
        number = F.when(F.lower(F.substring(name, 1, 2)) == "#x", F.conv(F.substr(name, F.lit(3)), 16, 10)).when(F.substring(name, 1, 1) == "#", F.substr(name, F.lit(2))).cast("int")
        code = F.coalesce(number, F.try_element_at(codes, name))
        real = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(real, F.concat(char, F.substr(part, F.length(name) + 2))).otherwise(F.concat(F.lit("&"), part))

    more = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), one)
    return F.when(F.size(parts) > 1, F.concat(F.element_at(parts, 1), F.array_join(more, ""))).otherwise(F.element_at(parts, 1))


def plain_text(parts: Column) -> Column:
    text = F.regexp_replace(resolved(parts), r"[ \t\r]+", " ")
    return F.trim(F.regexp_replace(text, r" ?\n[ \n]*", "\n"))


def _record(kind: str, row_id: Column, target: Column, date: Column, refers: Column, content_type: str, block: Column) -> Column:
    size = F.octet_length(block).cast("string")
    lines = [
        F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), row_id), F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace(target, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))), F.concat(F.lit("WARC-Refers-To: "), refers), F.concat(F.lit("WARC-Block-Digest: "), digest(block)),
        F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), size),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n"))


def derivatives(responses: DataFrame) -> DataFrame:
    """One row per response: ids, digests and blocks of its two derived records, and the records themselves."""
    rows = responses.withColumn("payload_digest", digest(F.col("body")))
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "body"), T.StructField("visible", T.StringType()), T.StructField("raw_title", T.StringType()), T.StructField("n_links", T.IntegerType())])
    rows = rows.mapInArrow(blocks.released(_scan), schema)
    # Each step is a column, so that nothing is worked out twice.
    rows = rows.withColumn("parts", F.split("visible", "&")).withColumn("title_parts", F.split("raw_title", "&")).drop("visible", "raw_title")
    title = F.trim(F.regexp_replace(resolved(F.col("title_parts")), r"[ \t\r\n]+", " "))
    rows = rows.withColumn("text", plain_text(F.col("parts"))).withColumn("title", title).drop("parts", "title_parts")
    # A null line, such as a header that the response does not have, is left out.
    meta = F.concat_ws("\r\n", F.nullif("http_header", F.lit("")), F.concat(F.lit("source-payload-digest: "), F.col("payload_digest")), F.concat(F.lit("title: "), F.col("title")), F.concat(F.lit("links: "), F.col("n_links").cast("string")))
    rows = rows.withColumn("metadata_block", F.concat(meta, F.lit("\r\n")))
    rows = rows.withColumn("metadata_id", _uuid(F.lit("metadata"), F.col("record_id"))).withColumn("conversion_id", _uuid(F.lit("conversion"), F.col("record_id")))
    return rows.select(
        "page_id", "record_id", "target", "payload_digest", "title", "n_links", "metadata_id", "conversion_id", "text",
        digest(F.col("metadata_block")).alias("metadata_digest"), digest(F.col("text")).alias("text_digest"),
        _record("metadata", F.col("metadata_id"), F.col("target"), F.col("date"), F.col("record_id"), "application/warc-fields", F.col("metadata_block")).alias("metadata_record"),
        _record("conversion", F.col("conversion_id"), F.col("target"), F.col("date"), F.col("record_id"), "text/plain", F.col("text")).alias("conversion_record"),
    )


def write_records(derived: DataFrame, path: str) -> None:
    """The records as text files of WARC blocks, one metadata and one conversion record after the other."""
    derived.select(F.concat("metadata_record", "conversion_record").alias("value")).write.option("lineSep", "").text(path)


def op7_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    made = derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
    sizes = [F.octet_length(c).cast("long").alias(f"{c}_bytes") for c in ("metadata_record", "conversion_record")]
    return made.select("page_id", "record_id", "metadata_id", "conversion_id", F.col("record_id").alias("refers_to"), "target", "payload_digest", "metadata_digest", "text_digest", "title", F.col("n_links").cast("long").alias("n_links"), F.octet_length("text").cast("long").alias("text_bytes"), *sizes)


def reference_sql() -> str:
    """The same rows in SQL (for tables without headers and dates)."""
    uuid = lambda x: f"(SELECT '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' FROM (SELECT md5({x}) AS h))"
    quoted = lambda pattern: pattern.replace("'", "''")
    rest = r"""(?:[^>=]|=\s*(?:"[^"]*"|'[^']*')?)*(?:>|\z)"""
    raw = quoted(r"(?is)<script\b[^>]*(?:>|\z).*?(?:</script\s*>|\z)|<style\b[^>]*(?:>|\z).*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)")
    heads, breaks, title_of = r"(?is)<head\b[^>]*>.*?</head\s*>", rf"(?i)<(?:{_ENDS})\b[^>]*(?:>|\z)", r"(?is)<title\b[^>]*>(.*?)</title"
    tag, href = quoted("<[a-zA-Z/!?]" + rest), quoted(r"""(?i)[\s"'/]href\s*=""")
    codes = "MAP {" + ", ".join(f"'{n}': {c}" for n, c in NAMES.items()) + "}"
    name = f"regexp_extract(p, '{REFERENCE}', 1)"
    code = f"CASE WHEN lower({name}[1:2]) = '#x' THEN CAST('0x' || {name}[3:] AS INT) WHEN {name}[1:1] = '#' THEN CAST({name}[2:] AS INT) ELSE {codes}[{name}] END"
    one = f"CASE WHEN ({code}) BETWEEN 1 AND 55295 OR ({code}) BETWEEN 57344 AND 1114111 THEN chr({code}) || p[length({name}) + 2:] ELSE '&' || p END"
    plain = lambda text: f"(SELECT s[1] || array_to_string(list_transform(s[2:], lambda p: {one}), '') FROM (SELECT string_split({text}, '&') AS s))"
    text = f"regexp_replace(regexp_replace(page, '{heads}', ' ', 'g'), '{breaks}', chr(10), 'g')"
    text = plain(f"regexp_replace({text}, '{tag}', ' ', 'g')")
    text = rf"trim(regexp_replace(regexp_replace({text}, '[ \t\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ')"
    title = rf"trim(regexp_replace({plain(f"regexp_extract(page, '{title_of}', 1)")}, '[ \t\r\n]+', ' ', 'g'), ' ')"
    head = lambda kind, own, ctype, block: f"strlen('WARC/1.1' || nl || 'WARC-Type: {kind}' || nl || 'WARC-Record-ID: ' || {own} || nl || 'WARC-Target-URI: ' || replace(replace(target, chr(13), '%0D'), chr(10), '%0A') || nl || 'WARC-Refers-To: ' || record_id || nl || 'WARC-Block-Digest: sha256:' || sha256({block}) || nl || 'Content-Type: {ctype}' || nl || 'Content-Length: ' || strlen({block}) || nl || nl || {block} || nl || nl)"
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS target, coalesce(html, '') AS body, regexp_replace(coalesce(html, ''), '{raw}', ' ', 'g') AS page, chr(13) || chr(10) AS nl FROM pages),
b AS (SELECT *, {uuid("'response' || chr(10) || coalesce(CAST(page_id AS VARCHAR), '') || chr(10) || target || chr(10) || sha256(body)")} AS record_id,
  'sha256:' || sha256(body) AS payload_digest, {text} AS text, {title} AS title, len(list_filter(regexp_extract_all(page, '{tag}'), lambda t: t[-1:] = '>' AND regexp_matches(t, '(?i)^<a[ \\t\\n\\f\\r/]') AND regexp_matches(t, '{href}'))) AS n_links FROM a),
c AS (SELECT *, {uuid("'metadata' || chr(10) || record_id")} AS metadata_id, {uuid("'conversion' || chr(10) || record_id")} AS conversion_id,
  'source-payload-digest: ' || payload_digest || nl || 'title: ' || title || nl || 'links: ' || n_links || nl AS block FROM b)
SELECT page_id, record_id, metadata_id, conversion_id, record_id AS refers_to, target, payload_digest, 'sha256:' || sha256(block) AS metadata_digest, 'sha256:' || sha256(text) AS text_digest,
  title, n_links, CAST(strlen(text) AS BIGINT) AS text_bytes, CAST({head("metadata", "metadata_id", "application/warc-fields", "block")} AS BIGINT) AS metadata_record_bytes, CAST({head("conversion", "conversion_id", "text/plain", "text")} AS BIGINT) AS conversion_record_bytes
FROM c"""
